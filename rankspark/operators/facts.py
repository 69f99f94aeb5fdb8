"""Facts: the flat row per candidate that rules, factors and sentences read.

Columns: ``candidate_id, title, stated_years, years, span_months, tenure_months,
mean_tenure_years, only_consulting, notice_days, response_rate, completion_rate,
github, has_expert, has_ai_skill``.

They come either from ingested records, where everything lies in one row, or from
separate tables with one row per role, skill or candidate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankspark.config import RankConfig
from rankspark.functions import career, text
from rankspark.session import narrow

FACTS = (
    "candidate_id", "title", "stated_years", "years", "span_months", "tenure_months", "mean_tenure_years",
    "only_consulting", "notice_days", "response_rate", "completion_rate", "github", "has_expert", "has_ai_skill",
)


def is_consulting(company: Column, cfg: RankConfig) -> Column:
    return F.lower(text.strip(company)).isin(list(cfg.consulting_firms))


def from_records(records: DataFrame, cfg: RankConfig) -> DataFrame:
    """Facts of ingested records, plus their skill names. A projection: nothing is moved."""
    history = F.col("career_history")
    companies = career.companies_in(history)
    skills = text.nonempty_items(F.transform("skills", lambda s: s["name"]))
    signals = F.col("signals")
    wanted = F.array(*[F.lit(k) for k in cfg.ai_keywords])
    return (
        records.select(
            "candidate_id",
            F.col("profile.current_title").alias("title"),
            F.col("profile.years_of_experience").alias("stated_years"),
            career.span_in(history).alias("span_months"),
            career.tenure_in(history).alias("tenure_months"),
            career.mean_tenure_years_in(history).alias("mean_tenure_years"),
            F.when(F.size(companies) > 0, F.forall(companies, lambda c: is_consulting(c, cfg))).alias(
                "only_consulting"
            ),
            F.coalesce(signals["notice_period_days"], F.col("notice_period_days")).alias("notice_days"),
            signals["recruiter_response_rate"].alias("response_rate"),
            signals["interview_completion_rate"].alias("completion_rate"),
            career.known(signals["github_activity_score"]).alias("github"),
            F.coalesce(
                F.exists(F.map_values(signals["skill_assessment_scores"]), lambda v: v >= cfg.expert_score),
                F.lit(False),
            ).alias("has_expert"),
            F.coalesce(F.arrays_overlap(F.transform(skills, F.lower), wanted), F.lit(False)).alias("has_ai_skill"),
            F.coalesce(skills, F.array().cast("array<string>")).alias("skills"),
        )
        .withColumn("years", career.years_of_experience(F.col("stated_years"), F.col("tenure_months")))
        .select(*FACTS, "skills")
    )


def dated_roles(roles: DataFrame) -> DataFrame:
    """Roles with start, end and whole months as numbers; every date is parsed once."""
    parsed = roles.select(
        "candidate_id",
        "company",
        career.month_index(F.col("start_date")).alias("start"),
        career.month_index(F.col("end_date")).alias("stated_end"),
        career.role_months(F.col("duration_months")).alias("months"),
    )
    return parsed.withColumn("end", career.role_end(F.col("start"), F.col("stated_end"), F.col("months")))


def _span() -> Column:
    return (F.max("end") - F.min("start")).cast("bigint")


def career_span(roles: DataFrame) -> DataFrame:
    """Months between the first start and the last end, over the roles with a start."""
    return dated_roles(roles).groupBy("candidate_id").agg(_span().alias("span_months"))


def career_figures(roles: DataFrame, cfg: RankConfig) -> DataFrame:
    """All figures over the roles in one aggregation; partial sums are built before the shuffle."""
    consulting = F.when(F.col("company") != "", is_consulting(F.col("company"), cfg))
    return (
        dated_roles(roles)
        .groupBy("candidate_id")
        .agg(
            _span().alias("span_months"),
            F.sum("months").alias("tenure_months"),
            (F.sum("months") / F.count("months") / F.lit(12.0)).alias("mean_tenure_years"),
            F.bool_and(consulting).alias("only_consulting"),
        )
    )


def skill_flags(skills: DataFrame, cfg: RankConfig) -> DataFrame:
    return skills.groupBy("candidate_id").agg(
        F.bool_or(F.lower(text.strip(F.col("skill"))).isin(list(cfg.ai_keywords))).alias("has_ai_skill")
    )


def of_all(cand: DataFrame, roles: DataFrame, signals: DataFrame, skills: DataFrame, cfg: RankConfig) -> DataFrame:
    """Facts of all candidates of the tables."""
    return _joined(cand, roles, signals, skills, cfg)


def from_tables(
    ids: DataFrame,
    cand: DataFrame,
    roles: DataFrame,
    signals: DataFrame,
    skills: DataFrame,
    cfg: RankConfig,
) -> DataFrame:
    """Facts of the given ids from separate tables.

    Repeated ids do no harm. The large tables are first narrowed to these ids, then
    aggregated per candidate with partial sums, so that a candidate with very many rows does
    not load one task.
    """
    return _joined(*[narrow(t, ids, "candidate_id") for t in (cand, roles, signals, skills)], cfg)


def _joined(cand: DataFrame, roles: DataFrame, signals: DataFrame, skills: DataFrame, cfg: RankConfig) -> DataFrame:
    figures, flags = career_figures(roles, cfg), skill_flags(skills, cfg)
    return (
        cand.join(figures, "candidate_id", "left")
        .join(signals, "candidate_id", "left")
        .join(flags, "candidate_id", "left")
        .select(
            "candidate_id",
            F.col("current_title").alias("title"),
            F.col("years_of_experience").alias("stated_years"),
            career.years_of_experience(F.col("years_of_experience"), F.col("tenure_months")).alias("years"),
            "span_months",
            "tenure_months",
            "mean_tenure_years",
            "only_consulting",
            F.coalesce("notice_nested", "notice_top").alias("notice_days"),
            F.col("recruiter_response_rate").alias("response_rate"),
            F.col("interview_completion_rate").alias("completion_rate"),
            career.known(F.col("github_activity_score")).alias("github"),
            F.coalesce(F.col("max_assessment") >= cfg.expert_score, F.lit(False)).alias("has_expert"),
            F.coalesce("has_ai_skill", F.lit(False)).alias("has_ai_skill"),
        )
    )
