"""Job descriptions from inline text, files or a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankspark.constants import SAMPLE_JOB_TEXT
from rankspark.functions import text


class EmptyJob(ValueError):
    """A job has no text."""


def resolve(jobs: DataFrame, sample: str = SAMPLE_JOB_TEXT) -> DataFrame:
    """``jd_text`` from the first of: inline text, file text, sample. Stripped.

    Reads ``job_id, inline_text, file_text``. An inline text that is empty counts as
    not given; a file that was read but holds nothing is an error for ``require_text``.
    """
    inline = F.nullif(F.col("inline_text"), F.lit(""))
    return jobs.withColumn("jd_text", text.strip(F.coalesce(inline, F.col("file_text"), F.lit(sample))))


def read_jobs(spark: SparkSession, path: str) -> DataFrame:
    """One job per text file; the id is the hash of the path. A missing path is an error."""
    return spark.read.text(path, wholetext=True).select(
        F.xxhash64(F.col("_metadata.file_path")).alias("job_id"),
        F.lit(None).cast("string").alias("inline_text"),
        F.col("value").alias("file_text"),
    )


def require_text(jobs: DataFrame) -> DataFrame:
    """Fail when a job has no text after stripping."""
    bad = jobs.where(F.coalesce(F.col("jd_text"), F.lit("")) == "").select("job_id").limit(5).collect()
    if bad:
        raise EmptyJob(f"jobs without text: {[r['job_id'] for r in bad]}")
    return jobs
