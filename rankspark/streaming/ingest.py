"""Incremental ingest of JSON lines: each run takes the new files and goes on where the last one stopped."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from rankspark.functions.vectors import Encoder, HashedTokens, model_name
from rankspark.schema import FEATURES
from rankspark.session import cut, narrow
from rankspark.sources import candidates, features


def new_rows(batch: DataFrame, stored: DataFrame) -> DataFrame:
    """Rows of a batch whose id is not stored yet; the stored ids are narrowed to those of the batch first."""
    known = narrow(stored.select("candidate_id"), batch, "candidate_id")
    return batch.join(known, "candidate_id", "left_anti")


def unfinished(batch: DataFrame, records: DataFrame, stored: DataFrame, model: str) -> DataFrame:
    """Stored records of a batch that have no vector of this model for the text they have."""
    texts = features.with_text(narrow(records, batch, "candidate_id")).withColumn("model", F.lit(model))
    keys = ["candidate_id", "model", "text_hash"]
    return features.todo(texts, narrow(stored.select(*keys), batch, "candidate_id"), keys)


def ingest(
    spark: SparkSession,
    source: str,
    target: str,
    progress: str,
    signals_field: str = "signals",
    make_encoder: Callable[[], Encoder] = HashedTokens,
    files_per_batch: int = 1000,
) -> StreamingQuery:
    """Read all new files below ``source``, then stop.

    ``target`` gets three tables: ``records``, ``features`` and ``quarantine``. Progress is
    kept in ``progress``. The first record per id stays, within a batch and over all
    batches. A batch that is run again after a failure adds nothing twice, because
    every table is compared with what is stored before rows are added. A record gets a new
    vector when it has none of this encoder's for its present text.
    """
    model = model_name(make_encoder)

    def table(name: str, schema) -> DataFrame:
        path = f"{target}/{name}"
        empty = spark.createDataFrame([], schema)
        empty.write.mode("ignore").parquet(path)
        return spark.read.schema(empty.schema).parquet(path)

    def load(batch: DataFrame, batch_id: int) -> None:
        position = F.struct("file", "block", F.monotonically_increasing_id().alias("line"))
        parsed = candidates.parse(batch.select("value", position.alias("source_pos")))
        bad = candidates.quarantine(parsed).select(
            "value", "fault", F.lit(batch_id).cast("bigint").alias("batch_id")
        )
        bad.write.mode("overwrite").parquet(f"{target}/quarantine/batch_id={batch_id}")

        # one scan gives the positions; a stored table keeps them for the second pass
        rows = cut(candidates.records(parsed, signals_field))
        good = candidates.keep_first(rows).drop("source_pos").persist()
        try:
            fresh = new_rows(good, table("records", good.schema))
            fresh.write.mode("append").parquet(f"{target}/records")
            bare = unfinished(good, table("records", good.schema), table("features", FEATURES), model)
            made = features.encode_texts(bare.drop("model"), make_encoder)
            made.write.mode("append").parquet(f"{target}/features")
        finally:
            good.unpersist()

    lines = (
        spark.readStream.format("text")
        .option("maxFilesPerTrigger", files_per_batch)
        .load(source)
        .select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    )
    return (
        lines.writeStream.option("checkpointLocation", progress)
        .trigger(availableNow=True)
        .foreachBatch(load)
        .start()
    )
