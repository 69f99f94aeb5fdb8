"""Ranked output as CSV: one folder per job, one file in it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rankspark import constants as fixed
from rankspark.functions import text
from rankspark.schema import RANKED_CSV
from rankspark.session import cut


class ShortResult(RuntimeError):
    """A job has fewer rows than asked for."""


def output_rows(ranked: DataFrame) -> DataFrame:
    """Columns as they stand in the file; the placeholder where there is no sentence."""
    reason = F.coalesce(F.nullif(F.col("reasoning"), F.lit("")), F.lit(fixed.REASONING_PLACEHOLDER))
    return ranked.select(
        "job_id",
        "candidate_id",
        "rank",
        text.fixed_decimals(F.col("score"), 6).alias("score"),
        reason.alias("reasoning"),
    )


def require_full(ranked: DataFrame, jobs: DataFrame, n: int) -> None:
    """Fail unless every job has exactly n rows."""
    counts = ranked.groupBy("job_id").agg(F.count(F.lit(1)).alias("n_rows"))
    short = (
        jobs.select("job_id")
        .join(counts, "job_id", "left")
        .where(F.coalesce("n_rows", F.lit(0)) != n)
        .limit(5)
        .collect()
    )
    if short:
        raise ShortResult(f"{n} rows needed, found {[(r['job_id'], r['n_rows'] or 0) for r in short]}")


def csv_field(c: Column) -> Column:
    """A field with quotes only where it needs them, as in RFC 4180."""
    return F.when(F.rlike(c, F.lit('[,"\r\n]')), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)


def csv_lines(rows: DataFrame) -> DataFrame:
    """``job_id, rank, value``: the lines of the file of each job, with the header as rank 0."""
    fields = [csv_field(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in fixed.OUTPUT_COLUMNS]
    body = rows.select("job_id", F.col("rank").cast("int").alias("rank"), F.concat_ws(",", *fields).alias("value"))
    head = rows.select("job_id").distinct().select("job_id", F.lit(0).alias("rank"), F.lit(",".join(fixed.OUTPUT_COLUMNS)).alias("value"))
    return head.unionByName(body)


def write(ranked: DataFrame, path: str, jobs: DataFrame, n: int) -> None:
    """Write all jobs side by side, each job sorted by rank. Unless every job has n rows, nothing is written.

    Lines end with CRLF, line feeds within sentences stay as they are, and only fields that need quotes
    have them.
    """
    rows = cut(output_rows(ranked))
    require_full(rows, jobs, n)
    (
        csv_lines(rows)
        .repartition("job_id")
        .sortWithinPartitions("job_id", "rank")
        .select("job_id", "value")
        .write.mode("overwrite")
        .partitionBy("job_id")
        .option("lineSep", "\r\n")
        .text(path)
    )


def read(spark: SparkSession, path: str) -> DataFrame:
    """Typed rows of one file or of all jobs."""
    return (
        spark.read.schema(RANKED_CSV)
        .option("header", True)
        .option("escape", '"')
        .option("multiLine", True)
        .csv(path)
    )


def read_raw(spark: SparkSession, path: str) -> DataFrame:
    """Rows of files as text with their position, for checks: ``row_no``, the fields and ``_corrupt``.

    ``_corrupt`` holds the line when it has not four fields. See ``header_of`` for the header.
    """
    schema = "candidate_id string, rank string, score string, reasoning string, _corrupt string"
    rows = (
        spark.read.schema(schema)
        .option("header", True)
        .option("enforceSchema", True)
        .option("columnPruning", False)
        .option("multiLine", True)
        .option("escape", '"')
        .option("columnNameOfCorruptRecord", "_corrupt")
        .csv(path)
        .withColumn("file", F.col("_metadata.file_path"))
        .withColumn("at", F.monotonically_increasing_id())
    )
    w = Window.partitionBy("file").orderBy("at")
    return rows.withColumn("row_no", F.row_number().over(w)).drop("at")


def header_of(spark: SparkSession, path: str) -> list[str]:
    return spark.read.option("header", True).option("escape", '"').csv(path).columns


def search(ranked: DataFrame, query: str) -> DataFrame:
    """Rows whose id or sentence contains the text, in any case; the text is taken literally."""
    q = F.lower(F.lit(query))
    return ranked.where(F.contains(F.lower("candidate_id"), q) | F.contains(F.lower("reasoning"), q))


def metrics(ranked: DataFrame) -> DataFrame:
    return ranked.groupBy("job_id").agg(
        F.count(F.lit(1)).alias("n_ranked"), F.max("score").alias("top_score"), F.min("score").alias("cutoff_score")
    )


def preview(ranked: DataFrame, n: int = 5) -> DataFrame:
    """First and last n rows per job by rank."""
    last = F.max("rank").over(Window.partitionBy("job_id"))
    return (
        ranked.withColumn("last", last)
        .where((F.col("rank") <= n) | (F.col("rank") > F.col("last") - n))
        .drop("last")
    )
