"""A corpus pipeline over the table ``documents``: five stages, each stored before the next one starts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankspark.llm import decontaminate, language_id, near_dedup, piece_codec, toxicity
from rankspark.llm.queries import HELD_LANGUAGE, HELD_TOXICITY, piece_model, table
from rankspark.session import scratch_path


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the classifier accepts; it learns from the labelled documents that are not held out."""
    model = language_id.fit(docs.where(language_id.learnable(F.col("doc_id"), *HELD_LANGUAGE)), candidate_id="doc_id")
    return language_id.with_language(docs, model)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted to be toxic; labels of documents that are not held out teach."""
    known = table(spark, sf_dir, "labels", "doc_id", "toxic").where(language_id.learnable(F.col("doc_id"), *HELD_TOXICITY))
    model = toxicity.fit(docs, known, candidate_id="doc_id")
    return toxicity.without_toxic(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, on shingles of five words."""
    return near_dedup.keep_one(docs, candidate_id="doc_id")


def drop_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    items = table(spark, sf_dir, "benchmark", "item_id", "text")
    return decontaminate.without_job_passages(docs, items, candidate_id="doc_id", job_id="item_id", jd_text="text")


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number of tokens and checksums of ids and decoded text per document."""
    made = piece_codec.codec_digests(docs, piece_model(), candidate_id="doc_id")
    return made.withColumnRenamed("candidate_id", "doc_id")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", keep_known_languages),
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_benchmark_passages),
    ("sentencepiece", encode_pieces),
]

# classifiers, the alignment and the encoder are not expressible in SQL
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``; each result is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
