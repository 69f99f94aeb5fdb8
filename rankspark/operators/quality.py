"""Checks on ranked output. Each gives error rows ``check, job_id, row_no, candidate_id, detail``.

Input: ``job_id, row_no`` (position in the file), ``candidate_id, rank, score,
reasoning``; rank and score may be text as read from a file.

A check that a row and the rows of its job before it decide is a :class:`RowCheck`. Such a
check can run alone, but ``row_errors`` runs any number of them in one pass over the rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rankspark import constants as fixed
from rankspark.config import RankConfig
from rankspark.functions import career, text
from rankspark.session import cut, narrow
from rankspark.sources import ranked_csv

ERROR_COLUMNS = ("check", "job_id", "row_no", "candidate_id", "detail")
_SLACK = 1e-9


def _errors(rows: DataFrame, check: str, detail: Column) -> DataFrame:
    return rows.select(
        F.lit(check).alias("check"),
        F.col("job_id").cast("bigint").alias("job_id"),
        F.col("row_no").cast("bigint").alias("row_no"),
        "candidate_id",
        detail.alias("detail"),
    )


def _rank() -> Column:
    return F.col("rank").cast("string").try_cast("int")


def _score() -> Column:
    return F.col("score").cast("string").try_cast("double")


def header(found: list[str], wanted: tuple[str, ...]) -> str | None:
    """Message when the header of a file differs, else nothing."""
    return None if list(found) == list(wanted) else f"header {list(found)} instead of {list(wanted)}"


def row_count(ranked: DataFrame, jobs: DataFrame, cfg: RankConfig) -> DataFrame:
    """Jobs whose number of rows is not N, also those without any row."""
    counts = ranked.groupBy("job_id").agg(F.count(F.lit(1)).alias("n_rows"))
    wrong = (
        jobs.select("job_id")
        .join(counts, "job_id", "left")
        .withColumn("n_rows", F.coalesce("n_rows", F.lit(0)))
        .where(F.col("n_rows") != cfg.top_n)
        .withColumn("row_no", F.lit(None).cast("bigint"))
        .withColumn("candidate_id", F.lit(None).cast("string"))
    )
    return _errors(wrong, "row_count", F.concat(F.lit("rows "), F.col("n_rows").cast("string")))


@dataclass(frozen=True)
class RowCheck:
    """``fails`` marks the rows with the fault ``detail``; ``history`` names what both need of the rows before."""

    name: str
    fails: Column
    detail: Column
    history: tuple[str, ...] = ()


def _with_history(ranked: DataFrame, needed: set[str]) -> DataFrame:
    """``before``: the last readable score before a row; ``use_no``: how often its id has come within the job.

    Both need the rows of a job in order. The first deals rows out by job, which holds for
    the second as well, so the rows move once.
    """
    if "before" in needed:
        earlier = Window.partitionBy("job_id").orderBy("row_no").rowsBetween(Window.unboundedPreceding, -1)
        ranked = ranked.withColumn("before", F.last(_score(), ignorenulls=True).over(earlier))
    if "use_no" in needed:
        of_id = Window.partitionBy("job_id", "candidate_id").orderBy("row_no")
        ranked = ranked.withColumn("use_no", F.row_number().over(of_id))
    return ranked


def row_errors(ranked: DataFrame, checks: list[RowCheck]) -> DataFrame:
    """The errors of all ``checks``, found in one pass; a row gives one error per check that it fails."""
    rows = _with_history(ranked, {h for c in checks for h in c.history})
    faults = [F.when(c.fails, F.struct(F.lit(c.name).alias("check"), c.detail.alias("detail"))) for c in checks]
    found = F.explode(F.array_compact(F.array(*faults))).alias("fault")
    rows = rows.select("job_id", "row_no", "candidate_id", found)
    return rows.select(
        F.col("fault.check").alias("check"),
        F.col("job_id").cast("bigint").alias("job_id"),
        F.col("row_no").cast("bigint").alias("row_no"),
        "candidate_id",
        F.col("fault.detail").alias("detail"),
    )


def _four_fields() -> RowCheck:
    return RowCheck("columns", F.col("_corrupt").isNotNull(), F.lit("not four fields"))


def _one_row_per_id() -> RowCheck:
    empty = F.coalesce("candidate_id", F.lit("")) == ""
    detail = F.when(empty, F.lit("empty id")).otherwise(F.lit("repeated id"))
    return RowCheck("ids", empty | (F.col("use_no") > 1), detail, ("use_no",))


def _rank_is_position() -> RowCheck:
    shown = F.coalesce(F.col("rank").cast("string"), F.lit("missing"))
    return RowCheck(
        "contiguous", ~F.coalesce(_rank() == F.col("row_no"), F.lit(False)), F.concat(F.lit("rank "), shown)
    )


def _score_within_bounds() -> RowCheck:
    ok = _score().between(-_SLACK, 1.0 + _SLACK) & ~F.isnan(_score())
    return RowCheck("score_bounds", ~F.coalesce(ok, F.lit(False)), F.lit("score not in [0, 1]"))


def _score_not_rising() -> RowCheck:
    rising = _score() > F.col("before") + _SLACK
    return RowCheck("monotonic", rising, F.lit("score above the one before"), ("before",))


def _has_reasoning() -> RowCheck:
    blank = text.strip(F.coalesce("reasoning", F.lit(""))) == ""
    return RowCheck("reasoning_present", blank, F.lit("no reasoning"))


def columns(raw: DataFrame) -> DataFrame:
    """Rows of a raw file that do not have four fields."""
    return row_errors(raw, [_four_fields()])


def ids(ranked: DataFrame) -> DataFrame:
    """Empty ids, and every row of an id after its first within a job."""
    return row_errors(ranked, [_one_row_per_id()])


def contiguous(ranked: DataFrame) -> DataFrame:
    """Ranks that are not a whole number or differ from the position."""
    return row_errors(ranked, [_rank_is_position()])


def score_bounds(ranked: DataFrame) -> DataFrame:
    """Scores that are not a number between 0 and 1."""
    return row_errors(ranked, [_score_within_bounds()])


def monotonic(ranked: DataFrame) -> DataFrame:
    """Scores above the last readable score before them."""
    return row_errors(ranked, [_score_not_rising()])


def reasoning_present(ranked: DataFrame) -> DataFrame:
    """Rows whose reasoning is missing or blank."""
    return row_errors(ranked, [_has_reasoning()])


def row_checks(ranked: DataFrame) -> list[RowCheck]:
    """All checks that rows decide among themselves; those on fields only for rows as read from a file."""
    return [
        *([_four_fields()] if "_corrupt" in ranked.columns else []),
        _one_row_per_id(),
        _rank_is_position(),
        _score_within_bounds(),
        _score_not_rising(),
        _has_reasoning(),
    ]


def known_ids(ranked: DataFrame, candidates: DataFrame) -> DataFrame:
    """Ids of the records, narrowed to those of the ranked rows."""
    return narrow(candidates.select("candidate_id"), ranked, "candidate_id")


def existence(ranked: DataFrame, candidates: DataFrame) -> DataFrame:
    """Ids that no record has."""
    known = known_ids(ranked, candidates)
    return _errors(ranked.join(known, "candidate_id", "left_anti"), "existence", F.lit("id not found"))


def record_digits(facts: DataFrame) -> DataFrame:
    """``candidate_id, token``: digit runs of years, notice, score and title, one row per run."""
    shown = [
        F.col("years").cast("bigint").cast("string"),
        F.col("notice_days").cast("bigint").cast("string"),
        F.format_string("%.2f", career.known(F.col("github"))),
        F.col("title"),
    ]
    # format_string writes "null" for null, which holds no digit
    found = F.flatten(F.array(*[text.digit_runs(F.coalesce(c, F.lit(""))) for c in shown]))
    return facts.select("candidate_id", F.explode(F.array_distinct(found)).alias("token"))


def skill_digits(skills: DataFrame) -> DataFrame:
    """``candidate_id, token``: digit runs of all skills."""
    return skills.select("candidate_id", F.explode(text.digit_runs(F.col("skill"))).alias("token"))


def sentence_digits(ranked: DataFrame) -> DataFrame:
    """Digit runs of the sentences, less those of the id of the row: ``(ref <id>)`` may name it."""
    runs = F.array_except(
        text.digit_runs(F.coalesce("reasoning", F.lit(""))),
        text.digit_runs(F.coalesce("candidate_id", F.lit(""))),
    )
    return ranked.select("job_id", "row_no", "candidate_id", F.explode(runs).alias("token"))


def loose_digits(ranked: DataFrame, tokens: DataFrame) -> DataFrame:
    """Digit runs of sentences that the record does not hold, as rows.

    Tokens of a candidate are never collected: the few runs of the sentences look
    themselves up, so a record with very many skills costs no more memory.
    """
    return sentence_digits(ranked).join(tokens, ["candidate_id", "token"], "left_anti")


def named_skills(ranked: DataFrame, skills: DataFrame) -> DataFrame:
    """Skills named for a row that its record does not hold, in any case."""
    named = ranked.select("job_id", "row_no", "candidate_id", F.explode("named_skills").alias("skill"))
    named = named.withColumn("skill_lower", F.lower(text.strip(F.col("skill"))))
    held = narrow(skills, ranked, "candidate_id").select("candidate_id", F.lower(text.strip(F.col("skill"))).alias("skill_lower"))
    alien = named.join(held, ["candidate_id", "skill_lower"], "left_anti")
    return _errors(alien, "named_skills", F.concat(F.lit("skill not in the record: "), F.col("skill")))


def grounded(
    ranked: DataFrame, candidates: DataFrame, facts: DataFrame, skills: DataFrame
) -> DataFrame:
    """Sentences with an open placeholder or a number from nowhere, for ids that have a record.

    ``facts`` need to cover the ranked ids only.
    """
    tokens = record_digits(facts).unionByName(skill_digits(narrow(skills, ranked, "candidate_id")))
    loose = loose_digits(ranked, tokens).select("job_id", "row_no", "candidate_id")
    braces = ranked.where(F.contains("reasoning", F.lit("{")) | F.contains("reasoning", F.lit("}"))).select(
        "job_id", "row_no", "candidate_id"
    )
    bad = loose.unionByName(braces).distinct()
    known = known_ids(ranked, candidates)
    return _errors(bad.join(known, "candidate_id", "left_semi"), "grounded", F.lit("not grounded"))


def report(
    ranked: DataFrame,
    jobs: DataFrame,
    candidates: DataFrame,
    facts: DataFrame,
    skills: DataFrame,
    cfg: RankConfig,
) -> DataFrame:
    """All errors of all checks as one table; empty means that the output passes.

    Rows as read from a file bring ``_corrupt`` and are checked for their fields; rows that
    still have their ``named_skills`` are checked for these.

    The ranked rows, N per job, are stored first, and so are the known ones of their ids: what
    made the rows runs once, records are read once, and every part below starts from small tables.
    """
    ranked = cut(ranked)
    known = cut(known_ids(ranked, candidates))
    parts = [
        *([named_skills(ranked, skills)] if "named_skills" in ranked.columns else []),
        row_count(ranked, jobs, cfg),
        row_errors(ranked, row_checks(ranked)),
        existence(ranked, known),
        grounded(ranked, known, facts, skills),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def validate_file(
    spark: SparkSession,
    path: str,
    job_id: int,
    candidates: DataFrame,
    facts: DataFrame,
    skills: DataFrame,
    cfg: RankConfig,
) -> DataFrame:
    """All errors of one ranked CSV file of a job: header, fields and every check on its rows."""
    message = header(ranked_csv.header_of(spark, path), fixed.OUTPUT_COLUMNS)
    rows = ranked_csv.read_raw(spark, path).withColumn("job_id", F.lit(job_id).cast("bigint"))
    jobs = spark.createDataFrame([(job_id,)], "job_id bigint")
    errors = report(rows, jobs, candidates, facts, skills, cfg)
    if message is None:
        return errors
    first = spark.createDataFrame([("header", job_id, None, None, message)], errors.schema)
    return first.unionByName(errors)


def verdict(errors: DataFrame, show: int = 50) -> tuple[bool, int, list[str]]:
    """Pass or fail, number of errors, and the first of them as text."""
    n = errors.count()
    first = errors.orderBy("job_id", "row_no", "check").limit(show).collect()
    return n == 0, n, [f"job {r.job_id} row {r.row_no}: {r.check}: {r.detail} {r.candidate_id or ''}".strip() for r in first]
