"""Behavioural factors and the final score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankspark.config import RankConfig


def consulting(cfg: RankConfig) -> Column:
    """Lower factor when every known employer is a consulting firm."""
    return F.when(F.col("only_consulting"), F.lit(cfg.consulting_factor)).otherwise(F.lit(1.0))


def hopper(cfg: RankConfig) -> Column:
    """Lower factor when roles last less than the threshold on average."""
    return F.when(F.col("mean_tenure_years") < cfg.hopper_years, F.lit(cfg.hopper_factor)).otherwise(F.lit(1.0))


def notice(cfg: RankConfig) -> Column:
    """Loss per started block of days beyond the free ones, not below 0."""
    days = F.col("notice_days")
    over = days.cast("bigint") - F.lit(cfg.notice_free_days)
    blocks = F.floor((over + F.lit(cfg.notice_step_days - 1)) / F.lit(cfg.notice_step_days))
    return F.when(
        days > cfg.notice_free_days,
        F.greatest(F.lit(0.0), F.lit(1.0) - F.lit(cfg.notice_step_loss) * blocks),
    ).otherwise(F.lit(1.0))


def _rate(name: str) -> Column:
    """A rate between 0 and 1; missing and negative ones count as 0."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.col(name), F.lit(0.0))))


def engagement(cfg: RankConfig) -> Column:
    return F.lit(1.0) + _rate("response_rate") * _rate("completion_rate")


def with_factors(facts: DataFrame, cfg: RankConfig) -> DataFrame:
    """Add the four factors, their product and the job-hopper mark."""
    return (
        facts.withColumns(
            {
                "f_consulting": consulting(cfg),
                "f_hopper": hopper(cfg),
                "f_notice": notice(cfg),
                "f_engagement": engagement(cfg),
            }
        )
        .withColumn(
            "multiplier",
            F.col("f_consulting") * F.col("f_hopper") * F.col("f_notice") * F.col("f_engagement"),
        )
        .withColumn("hopper", F.col("f_hopper") < 1.0)
    )


def rounded(c: Column, digits: int | None) -> Column:
    """Halves go up, computed on the double itself, so that every engine gets the same result."""
    if digits is None:
        return c
    scale = float(10**digits)
    return F.floor(c * F.lit(scale) + F.lit(0.5)) / F.lit(scale)


def with_score(df: DataFrame, cfg: RankConfig) -> DataFrame:
    """Similarity times multiplier. A penalty raises a negative similarity; that is meant so."""
    return df.withColumn("raw_score", rounded(F.col("sem_score") * F.col("multiplier"), cfg.score_digits))
