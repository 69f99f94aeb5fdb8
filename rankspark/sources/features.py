"""Stored vectors: build, write, read, extend and summarise."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankspark.functions import vectors
from rankspark.functions.vectors import Encoder, HashedTokens
from rankspark.schema import FEATURES
from rankspark.sources.candidates import compose_text, keep_first


class EmptyFeatures(RuntimeError):
    """There is nothing to write."""


class MissingColumns(ValueError):
    """A stored table lacks columns."""


class ModelMismatch(ValueError):
    """Vectors of different models are compared."""


def with_text(records: DataFrame) -> DataFrame:
    """``candidate_id, text, text_hash``: the whole text the encoder reads."""
    return records.select("candidate_id", compose_text().alias("text")).withColumn("text_hash", F.sha2("text", 256))


def build(records: DataFrame, make_encoder: Callable[[], Encoder] = HashedTokens) -> DataFrame:
    """Unit vectors for all records with the name of the encoder that made them."""
    return encode_texts(with_text(records), make_encoder)


def encode_texts(texts: DataFrame, make_encoder: Callable[[], Encoder] = HashedTokens) -> DataFrame:
    """The same for rows that have their text and its hash already."""
    return vectors.encode(texts, "text", make_encoder).select(
        "candidate_id",
        "text_hash",
        F.lit(vectors.model_name(make_encoder)).alias("model"),
        "embedding",
        vectors.norm(F.col("embedding")).alias("norm"),
    )


def write(features: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Store vectors. An empty result is an error before anything is written; nothing stored is replaced by default."""
    if features.select("candidate_id").limit(1).count() == 0:
        raise EmptyFeatures(path)
    features.write.mode(mode).parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Stored vectors; a missing path or column is an error."""
    found = set(spark.read.parquet(path).columns)
    wanted = spark.createDataFrame([], FEATURES).columns
    lost = [c for c in wanted if c not in found]
    if lost:
        raise MissingColumns(f"{path}: {lost}")
    return spark.read.schema(FEATURES).parquet(path)


def todo(wanted: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``wanted`` whose keys are not in ``done``."""
    return wanted.join(done.select(*keys), keys, "left_anti")


def merge(old: DataFrame, new: DataFrame, key: str = "candidate_id") -> DataFrame:
    """Old rows, then new rows of other ids; the first row per id by position stays.

    Rows are not sorted: ids and positions are aggregated, and ids of old rows meet new ones.
    """
    fresh = keep_first(new, key).join(old.select(key), key, "left_anti")
    return keep_first(old, key).unionByName(fresh)


def manifest(features: DataFrame, key: str = "candidate_id") -> DataFrame:
    """One row about a set of vectors: number, dimensions and whether all have unit length."""
    size = F.size("embedding")
    unit = F.abs(vectors.norm(F.col("embedding")) - 1.0) < 1e-6
    return features.agg(
        F.count(F.lit(1)).alias("n_vectors"),
        F.min(size).cast("bigint").alias("min_dim"),
        F.max(size).cast("bigint").alias("max_dim"),
        F.count_if(F.col(key).isNull()).alias("n_without_id"),
        F.bool_and(unit).alias("normalized"),
    )


def consistency(candidates: DataFrame, features: DataFrame, key: str = "candidate_id") -> DataFrame:
    """Numbers that must agree between records and vectors: rows, distinct ids, ids on one side only.

    One row per id and side is enough, so both sides are reduced before they meet.
    """
    c = candidates.groupBy(key).agg(F.count(F.lit(1)).alias("c_rows"))
    f = features.groupBy(key).agg(F.count(F.lit(1)).alias("f_rows"))
    return c.join(f, key, "full").agg(
        F.coalesce(F.sum("c_rows"), F.lit(0)).cast("bigint").alias("record_rows"),
        F.count("c_rows").alias("record_ids"),
        F.coalesce(F.sum("f_rows"), F.lit(0)).cast("bigint").alias("vector_rows"),
        F.count("f_rows").alias("vector_ids"),
        F.count_if(F.col("f_rows").isNull()).alias("records_without_vector"),
        F.count_if(F.col("c_rows").isNull()).alias("vectors_without_record"),
    )
