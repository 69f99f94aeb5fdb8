"""Final order, normalised scores, positions and tiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankspark.config import RankConfig


def final_order() -> list[Column]:
    """Score, then similarity, both from high to low, then id."""
    return [F.desc("raw_score"), F.desc("sem_score"), F.asc("candidate_id")]


def top_n(scored: DataFrame, cfg: RankConfig) -> DataFrame:
    """The N best rows per job with their position. Groups hold at most K rows."""
    w = Window.partitionBy("job_id").orderBy(*final_order())
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= cfg.top_n)


def normalize(ranked: DataFrame) -> DataFrame:
    """Scores in [0, 1]: divided by the best of the job; all 0 when the best is not positive."""
    best = F.max("raw_score").over(Window.partitionBy("job_id"))
    return (
        ranked.withColumn("best", best)
        .withColumn(
            "score",
            F.when(F.col("best") > 0, F.greatest(F.col("raw_score"), F.lit(0.0)) / F.col("best")).otherwise(
                F.lit(0.0)
            ),
        )
        .drop("best")
    )


def tier(rank: Column, cfg: RankConfig) -> Column:
    return (
        F.when(rank <= cfg.top_tier_until, F.lit("top"))
        .when(rank <= cfg.mid_tier_until, F.lit("mid"))
        .otherwise(F.lit("filler"))
    )
