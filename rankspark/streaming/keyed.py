"""Ingest as a stream with a state: the first record per id, whatever has been stored already.

Spark keeps one entry per id it has seen in its RocksDB store, dealt out by id, and a batch looks up
the ids of its own lines only. Nothing that is stored is read again, so a batch costs what its
lines cost, however large the tables have grown. Each batch writes folders of its own, which a
repeated batch replaces: a run that stops in the middle goes on from its checkpoint and adds
nothing twice.

The state lives with the checkpoint. A target whose checkpoint is lost can be taken up by
``rankspark.streaming.ingest``, which compares every batch with the stored ids instead.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from rankspark.functions.vectors import Encoder, HashedTokens
from rankspark.session import cut, setting
from rankspark.sources import candidates, features

_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_LINE = "candidate_id string, value string, file string, block bigint, line bigint"


class FirstOfId(StatefulProcessor):
    """Hands on the first line of an id that has not been seen, and remembers where it stood."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("first_pos", "file string, block bigint, line bigint")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        if self.seen.exists():
            return
        first = min(rows, key=lambda r: (r["file"], r["block"], r["line"]))
        self.seen.update((first["file"], first["block"], first["line"]))
        yield Row(candidate_id=key[0], value=first["value"], file=first["file"], block=first["block"], line=first["line"])

    def close(self) -> None:
        pass


def numbered_lines(spark: SparkSession, source: str, files_per_batch: int) -> DataFrame:
    """New lines with file, block and a number that rises within the block."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = 0
        for batch in batches:
            numbers = pa.array(range(at, at + batch.num_rows), pa.int64())
            at += batch.num_rows
            yield pa.RecordBatch.from_arrays([*batch.columns, numbers], names=["value", "file", "block", "line"])

    lines = (
        spark.readStream.format("text")
        .option("maxFilesPerTrigger", files_per_batch)
        .load(source)
        .select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    )
    return lines.mapInArrow(run, "value string, file string, block bigint, line bigint")


def first_lines(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The first line per id over the whole stream, and all faulty lines. Lines without an id are left out."""
    parsed = candidates.parse(lines)
    identified = parsed.where(F.col("fault").isNull()).withColumn("candidate_id", F.try_variant_get("doc", "$.candidate_id", "string"))
    keyed = identified.where(F.col("candidate_id").isNotNull()).select("candidate_id", "value", "file", "block", "line")
    first = keyed.groupBy("candidate_id").transformWithState(
        statefulProcessor=FirstOfId(), outputStructType=_LINE, outputMode="Append", timeMode="None"
    )
    return first, parsed.where(F.col("fault").isNotNull()).select("value", "fault", "file", "block", "line")


def ingest_first(
    spark: SparkSession,
    source: str,
    target: str,
    progress: str,
    signals_field: str = "signals",
    make_encoder: Callable[[], Encoder] | None = HashedTokens,
    files_per_batch: int = 1000,
) -> StreamingQuery:
    """Read all new files below ``source``, then stop.

    ``target`` gets ``records``, ``features`` (unless ``make_encoder`` is None) and ``quarantine``, each in one
    folder per batch; ``candidate_id`` is unique over all of them. Of the lines of an id the one in the earliest
    batch stays and, within a batch, the one with the smallest file name, block and line. Files
    that come again, ids that come again and a batch that is repeated after a failure add nothing.
    Progress and the seen ids are kept in ``progress``, which must be as lasting as ``target``.
    """
    first, bad = first_lines(numbered_lines(spark, source, files_per_batch))
    rows = first.withColumn("fault", F.lit(None).cast("string")).unionByName(bad.withColumn("candidate_id", F.lit(None).cast("string")))

    def load(batch: DataFrame, batch_id: int) -> None:
        # the stateful step must run once a batch, so its rows are stored before they are used
        kept = cut(batch)

        def store(df: DataFrame, name: str) -> None:
            df.write.mode("overwrite").parquet(f"{target}/{name}/batch_id={batch_id}")

        store(kept.where(F.col("fault").isNotNull()).select("value", "fault"), "quarantine")
        lines = kept.where(F.col("fault").isNull()).select("value", F.struct("file", "block", "line").alias("source_pos"))
        store(candidates.records(candidates.parse(lines), signals_field).drop("source_pos"), "records")
        if make_encoder is not None:
            fresh = spark.read.parquet(f"{target}/records/batch_id={batch_id}")
            store(features.build(fresh, make_encoder), "features")

    # the query has a session of its own from here on
    with setting(spark, _STORE, _ROCKS):
        return rows.writeStream.option("checkpointLocation", progress).trigger(availableNow=True).foreachBatch(load).start()
