"""Stored rows per id, dealt out into buckets by the hash of the id.

What is looked up or merged later meets the buckets where they stand: Spark moves the new rows to
the buckets' tasks and leaves the stored side, which is large, in place. Appending adds files to
buckets; ``compact`` makes one file per bucket of them again, without a shuffle either.

A store is a folder with one generation of data and a small file that names it and the number of
buckets; compaction writes the next generation beside it and then exchanges the file, so a failure
leaves the old one valid.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from rankspark.session import setting
from rankspark.sources.candidates import keep_first


class NoStore(ValueError):
    """The folder holds no bucketed store."""


class BucketedStore:
    """Rows with an id, in ``buckets`` by its hash. One writer at a time."""

    def __init__(self, spark: SparkSession, path: str, key: str, buckets: int, generation: str, schema: str) -> None:
        self.spark, self.path, self.key, self.buckets = spark, path, key, buckets
        self.generation, self.schema = generation, schema
        self.table = f"bucketed_{uuid.uuid4().hex}"
        self._register()

    # Where it stands

    @classmethod
    def create(cls, first: DataFrame, path: str, buckets: int, key: str = "candidate_id") -> BucketedStore:
        """A new store with its first rows."""
        store = cls(first.sparkSession, path, key, buckets, f"g-{uuid.uuid4().hex}", first.schema.json())
        store.append(first)
        store._point()
        return store

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> BucketedStore:
        try:
            rows = spark.read.text(f"{path}/_store").collect()  # one line
        except Exception as e:
            raise NoStore(path) from e
        return cls(spark, path, **json.loads(rows[0]["value"]))

    def _point(self) -> None:
        known = {"key": self.key, "buckets": self.buckets, "generation": self.generation, "schema": self.schema}
        line = self.spark.createDataFrame([(json.dumps(known),)], "value string")
        line.coalesce(1).write.mode("overwrite").text(f"{self.path}/_store")

    def _register(self) -> None:
        """Tell this session's catalog about the buckets; the data stay where they are."""
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in StructType.fromJson(json.loads(self.schema)))
        self.spark.sql(
            f"CREATE TABLE {self.table} ({columns}) USING parquet"
            f" CLUSTERED BY (`{self.key}`) INTO {self.buckets} BUCKETS LOCATION '{self.path}/{self.generation}'"
        )

    def close(self) -> None:
        """Forget the table in this session; data stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")

    # Rows

    def read(self) -> DataFrame:
        return self.spark.table(self.table)

    def append(self, rows: DataFrame) -> None:
        """Add rows; one file per bucket comes to those that are there."""
        names = self.read().columns
        self._write(rows.select(*names).repartition(self.buckets, self.key), self.table)

    def _write(self, rows: DataFrame, table: str) -> None:
        rows.write.format("parquet").bucketBy(self.buckets, self.key).mode("append").saveAsTable(table)

    def todo(self, wanted: DataFrame, same: tuple[str, ...] = ("model", "text_hash")) -> DataFrame:
        """Rows of ``wanted`` without a stored row of the same id and the same further columns (null equals nothing).

        The further columns are compared as ranges: as equalities they would become part of the
        join key, by which the buckets are not dealt out.
        """
        done = self.read().select(self.key, *same).alias("done")
        met = F.col(f"wanted.{self.key}") == F.col(f"done.{self.key}")
        for c in same:
            met = met & (F.col(f"wanted.{c}") <= F.col(f"done.{c}")) & (F.col(f"wanted.{c}") >= F.col(f"done.{c}"))
        return wanted.alias("wanted").join(done, met, "left_anti")

    def fresh(self, new: DataFrame, position: str = "source_pos") -> DataFrame:
        """First row per id of ``new`` whose id is not stored."""
        return keep_first(new, self.key, position).join(self.read().select(self.key), self.key, "left_anti")

    def merge(self, new: DataFrame, position: str = "source_pos") -> None:
        """Add the first row per new id; ids that are stored keep their row."""
        self.append(self.fresh(new, position))

    def compact(self) -> None:
        """One file per bucket again. Tasks copy their own bucket, so nothing is shuffled."""
        following = BucketedStore(self.spark, self.path, self.key, self.buckets, f"g-{uuid.uuid4().hex}", self.schema)
        # a plain copy needs no buckets, so Spark would read it by splits
        with setting(self.spark, "spark.sql.sources.bucketing.autoBucketedScan.enabled", "false"):
            following._write(self.read(), following.table)
        old, old_table = self.generation, self.table
        self.generation, self.table = following.generation, following.table
        self._point()
        self.spark.sql(f"DROP TABLE {old_table}")
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{old}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
