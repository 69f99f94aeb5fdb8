"""Drop rules as boolean expressions over facts, tried in a fixed order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankspark.config import RankConfig
from rankspark.constants import DROP_REASONS
from rankspark.functions.text import whole_word_pattern


def _lower_title() -> Column:
    return F.lower(F.coalesce("title", F.lit("")))


def _span() -> Column:
    """Career span of at least one month; null (not 1) when there are no dates."""
    return F.when(F.col("span_months").isNotNull(), F.greatest("span_months", F.lit(1)))


def domain_mismatch(cfg: RankConfig) -> Column:
    return F.rlike(_lower_title(), F.lit(whole_word_pattern(cfg.off_domain_words)))


def overlapping_timeline(cfg: RankConfig) -> Column:
    return F.col("tenure_months") > _span() * F.lit(float(cfg.overlap_ratio))


def experience_inflation(cfg: RankConfig) -> Column:
    stated = F.col("stated_years")
    return (stated >= 0) & (stated * 12 > _span() * F.lit(float(cfg.inflation_ratio)))


def fake_expert(cfg: RankConfig) -> Column:
    return F.col("has_expert") & (F.col("years") < F.lit(float(cfg.expert_min_years)))


def title_mismatch(cfg: RankConfig) -> Column:
    title = _lower_title()
    odd = F.lit(False)
    for part in cfg.non_tech_parts:
        odd = odd | F.contains(title, F.lit(part))
    return odd & F.col("has_ai_skill")


def rules(cfg: RankConfig) -> dict[str, Column]:
    tests = (
        domain_mismatch(cfg),
        overlapping_timeline(cfg),
        experience_inflation(cfg),
        fake_expert(cfg),
        title_mismatch(cfg),
    )
    return {name: F.coalesce(test, F.lit(False)) for name, test in zip(DROP_REASONS, tests)}


def drop_reason(cfg: RankConfig) -> Column:
    """Name of the first rule that fires; null for a candidate to keep."""
    return F.coalesce(*[F.when(test, F.lit(name)) for name, test in rules(cfg).items()])


def reason_counts(marked: DataFrame) -> DataFrame:
    """Rows per drop reason and job; kept rows are not counted."""
    return (
        marked.where(F.col("drop_reason").isNotNull())
        .groupBy("job_id", "drop_reason")
        .agg(F.count(F.lit(1)).alias("n_rows"))
    )


def funnel(recalled: DataFrame, marked: DataFrame, top_n: int) -> DataFrame:
    """Per job: recalled ids, ids without a record, dropped, kept and finally retained ones."""
    seen = marked.select("job_id", "candidate_id", F.col("drop_reason").isNotNull().alias("out"))
    return (
        recalled.select("job_id", "candidate_id")
        .join(seen, ["job_id", "candidate_id"], "left")
        .groupBy("job_id")
        .agg(
            F.count(F.lit(1)).alias("recalled"),
            F.count_if(F.col("out").isNull()).alias("missing"),
            F.count_if("out").alias("dropped"),
            F.count_if(~F.col("out")).alias("kept"),
        )
        .withColumn("retained", F.least(F.col("kept"), F.lit(top_n).cast("bigint")))
    )
