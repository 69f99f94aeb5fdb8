"""Whole runs: from records or tables to ranked, explained rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankspark.config import RankConfig
from rankspark.functions.vectors import Encoder, HashedTokens, encode, model_name
from rankspark.operators import facts as facts_
from rankspark.operators import ranking, reasoning, rules, scoring, skills
from rankspark.operators.recall import top_matches
from rankspark.session import by_key, cut, narrow
from rankspark.sources.features import ModelMismatch


def embed_jobs(jobs: DataFrame, make_encoder: Callable[[], Encoder] = HashedTokens) -> DataFrame:
    """Add ``job_vec`` and ``job_model`` to jobs, with the encoder that made the candidate vectors."""
    made = encode(jobs, "jd_text", make_encoder, out="job_vec")
    return made.withColumn("job_model", F.lit(model_name(make_encoder)))


def require_same_model(vectors: DataFrame, jobs: DataFrame) -> None:
    """Vectors of candidates and jobs must come from one model, where both tables name it."""
    if "model" not in vectors.columns or "job_model" not in jobs.columns:
        return
    names = {r[0] for r in vectors.select("model").distinct().limit(2).collect()}
    names |= {r[0] for r in jobs.select("job_model").distinct().limit(2).collect()}
    if len(names) > 1:
        raise ModelMismatch(f"vectors of different models: {sorted(map(str, names))}")


def recall(vectors: DataFrame, jobs: DataFrame, cfg: RankConfig) -> DataFrame:
    """Top K per job, stored. K counts before any rule drops a row."""
    require_same_model(vectors, jobs)
    return cut(top_matches(vectors, jobs, cfg))


def mark(recalled: DataFrame, facts: DataFrame, cfg: RankConfig) -> DataFrame:
    """Recalled pairs with facts and drop reason; pairs without a record fall out here."""
    marked = facts.withColumn("drop_reason", rules.drop_reason(cfg))
    return marked.join(recalled, "candidate_id")


def score(marked: DataFrame, cfg: RankConfig) -> DataFrame:
    kept = marked.where(F.col("drop_reason").isNull())
    return scoring.with_score(scoring.with_factors(kept, cfg), cfg)


def best(marked: DataFrame, cfg: RankConfig) -> DataFrame:
    """Final N rows per job with rank, normalised score and tier."""
    top = ranking.normalize(ranking.top_n(score(marked, cfg), cfg))
    return top.withColumn("tier", ranking.tier(F.col("rank"), cfg))


def marked_tables(
    vectors: DataFrame,
    jobs: DataFrame,
    cand: DataFrame,
    roles: DataFrame,
    signals: DataFrame,
    skl: DataFrame,
    cfg: RankConfig,
) -> tuple[DataFrame, DataFrame]:
    """Marked pairs and recalled pairs, for data in separate tables."""
    recalled = recall(vectors, jobs, cfg)
    facts = facts_.from_tables(recalled, cand, roles, signals, skl, cfg)
    return mark(recalled, facts, cfg), recalled


def rank_tables(
    vectors: DataFrame,
    jobs: DataFrame,
    cand: DataFrame,
    roles: DataFrame,
    signals: DataFrame,
    skl: DataFrame,
    cfg: RankConfig,
) -> DataFrame:
    """Ranked rows with facts and named skills, ready for sentences, from separate tables."""
    recalled = recall(vectors, jobs, cfg)
    # the skills of recalled candidates serve the rules and the matches
    own = cut(narrow(skl, recalled, "candidate_id"))
    facts = facts_.from_tables(recalled, cand, roles, signals, own, cfg)
    top = cut(best(mark(recalled, facts, cfg), cfg))
    named = skills.named_skills(skills.matched_rows(top, jobs, own, cfg), cfg)
    return by_key(top.join(named, ["job_id", "candidate_id"], "left"), "job_id", top.count())


def rank_records(records: DataFrame, vectors: DataFrame, jobs: DataFrame, cfg: RankConfig) -> DataFrame:
    """The same from ingested records. Only the recalled records are read beyond their id."""
    recalled = recall(vectors, jobs, cfg)
    chosen = narrow(records, recalled, "candidate_id")
    top = cut(best(mark(recalled, facts_.from_records(chosen, cfg), cfg), cfg))
    own = top.select("candidate_id", "skills").dropDuplicates(["candidate_id"])
    skl = own.select("candidate_id", F.posexplode("skills").alias("pos", "skill"))
    named = skills.named_skills(skills.matched_rows(top, jobs, skl, cfg), cfg)
    return by_key(top.drop("skills").join(named, ["job_id", "candidate_id"], "left"), "job_id", top.count())


def explain_rows(ranked: DataFrame, cfg: RankConfig) -> DataFrame:
    """Add a sentence to every row, unique within its job."""
    return reasoning.unique_in_order(reasoning.with_sentence(ranked, cfg), cfg)


def output(explained: DataFrame) -> DataFrame:
    return explained.select("job_id", "candidate_id", "rank", "score", "reasoning")


def rank_candidates(records: DataFrame, vectors: DataFrame, jobs: DataFrame, cfg: RankConfig) -> DataFrame:
    """``job_id, candidate_id, rank, score, reasoning`` for ingested records, their vectors and jobs.

    ``jobs`` has ``job_id, jd_text, job_vec``; see ``embed_jobs``.
    """
    return output(explain_rows(rank_records(records, vectors, jobs, cfg), cfg))
