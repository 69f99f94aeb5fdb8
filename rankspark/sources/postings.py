"""Texts as sparse vectors of token counts, and an index of posting lists over them.

A posting list holds the texts with one token, the largest weight (share of the text's
length) first. It is stored in blocks of bounded size, each with the largest weight in
it, so the list of a very frequent token is many rows in many files, and a reader
takes only the blocks whose weights still matter.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankspark.functions.batches import by_bytes
from rankspark.session import cut

_TOKEN = re.compile(r"[^\W_]+")


class MissingIndex(ValueError):
    """A stored index lacks a table or a column."""


@dataclass(frozen=True)
class Index:
    """``vectors``: ``candidate_id, norm, terms (term, n)``; ``blocks``: ``term, block, size, max_weight, ids, weights``."""

    vectors: DataFrame
    blocks: DataFrame


@dataclass(frozen=True)
class PostingConfig:
    block_rows: int = 512
    rows_per_task: int = 2_000_000


def count_terms(df: DataFrame, key: str, text: str) -> DataFrame:
    """``key, norm, terms``: tokens of the whole text with their numbers, and the length of the vector.

    Tokens are runs of letters and digits in lower case. Texts without any, null texts
    included, have no terms and length 0.
    """
    kind = df.schema[key].dataType.simpleString()
    term = pa.struct([("term", pa.string()), ("n", pa.int64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for few in by_bytes(batches, text):
            found, numbers, ends, norms = [], [], [0], []
            for value in few.column(1):
                counts = Counter(_TOKEN.findall((value.as_py() or "").lower()))
                found.extend(counts.keys())
                numbers.extend(counts.values())
                ends.append(len(found))
                norms.append(float(np.sqrt(sum(n * n for n in counts.values()))))
            entries = pa.StructArray.from_arrays([pa.array(found, pa.string()), pa.array(numbers, pa.int64())], fields=list(term))
            terms = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), entries)
            yield pa.RecordBatch.from_arrays([few.column(0), pa.array(norms, pa.float64()), terms], names=[key, "norm", "terms"])

    slim = df.select(key, text)
    return slim.mapInArrow(run, f"{key} {kind}, norm double, terms array<struct<term: string, n: bigint>>")


def posting_blocks(vectors: DataFrame, cfg: PostingConfig = PostingConfig()) -> DataFrame:
    """Posting lists of sparse vectors in blocks, by falling weight.

    Postings are sorted by token and weight over as many tasks as their number is worth, a
    frequent token over several of them; a task then closes a block at every new token and
    after ``block_rows`` rows. No list is ever held as a whole.
    """
    kind = vectors.schema["candidate_id"].dataType.simpleString()
    rows = cut(
        vectors.select("candidate_id", "norm", F.explode("terms").alias("t")).select(
            "t.term", (F.col("t.n") / F.col("norm")).alias("weight"), "candidate_id"
        )
    )
    tasks = max(1, -(-rows.count() // cfg.rows_per_task))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, left = TaskContext.get().partitionId() << 40, None

        def closed(rows: pa.RecordBatch, starts: np.ndarray) -> pa.RecordBatch:
            """Blocks of ``rows`` that begin at ``starts``."""
            nonlocal block
            ends = np.append(starts[1:], rows.num_rows)
            numbers, at = np.arange(block, block + len(starts)), pa.array(starts, pa.int64())
            block += len(starts)
            offsets = pa.array(np.append(starts, rows.num_rows), pa.int32())
            ids, weights = (pa.ListArray.from_arrays(offsets, rows.column(c)) for c in ("candidate_id", "weight"))
            return pa.RecordBatch.from_arrays(
                [rows.column("term").take(at), pa.array(numbers, pa.int64()), pa.array(ends - starts, pa.int32()), rows.column("weight").take(at), ids, weights],
                names=["term", "block", "size", "max_weight", "ids", "weights"],
            )

        for batch in batches:
            if not batch.num_rows:
                continue
            # the rows of the block that is still open stand before those of the next batch
            rows = batch if left is None else pa.concat_batches([left, batch])
            term = rows.column("term")
            changes = pc.not_equal(term.slice(1), term.slice(0, len(term) - 1)).to_numpy(zero_copy_only=False)
            runs = np.append(0, np.flatnonzero(changes) + 1)
            within = np.arange(len(term)) - np.repeat(runs, np.diff(np.append(runs, len(term))))
            starts = np.flatnonzero(within % cfg.block_rows == 0)
            last = int(starts[-1])
            if last:
                yield closed(rows.slice(0, last), starts[:-1])
            left = pa.RecordBatch.from_arrays([c.take(pa.array(range(last, len(term)), pa.int64())) for c in rows.columns], schema=rows.schema)
        if left is not None:
            yield closed(left, np.zeros(1, dtype=np.int64))

    order = ("term", F.desc("weight"), "candidate_id")
    ordered = rows.repartitionByRange(tasks, *order).sortWithinPartitions(*order).select("term", "candidate_id", "weight")
    return ordered.mapInArrow(
        run, f"term string, block bigint, size int, max_weight double, ids array<{kind}>, weights array<double>"
    )


def write(texts: DataFrame, path: str, cfg: PostingConfig = PostingConfig()) -> None:
    """Store the index of ``candidate_id, text`` as the tables ``vectors`` and ``blocks`` below ``path``.

    Ids must be unique and not null (``keep_first`` sees to that for scanned records). An
    empty table gives an empty index.
    """
    spark = texts.sparkSession
    count_terms(texts, "candidate_id", "text").write.parquet(f"{path}/vectors")
    posting_blocks(spark.read.parquet(f"{path}/vectors"), cfg).write.parquet(f"{path}/blocks")


def read(spark: SparkSession, path: str) -> Index:
    """A stored index; a missing path or column is an error."""
    index = Index(spark.read.parquet(f"{path}/vectors"), spark.read.parquet(f"{path}/blocks"))
    wanted = {"vectors": ("candidate_id", "norm", "terms"), "blocks": ("term", "block", "size", "max_weight", "ids", "weights")}
    for name, columns in wanted.items():
        lost = [c for c in columns if c not in getattr(index, name).columns]
        if lost:
            raise MissingIndex(f"{path}/{name}: {lost}")
    return index


def list_summary(blocks: DataFrame) -> DataFrame:
    """One row per token: number of texts and the largest weight; blocks are not opened."""
    return blocks.groupBy("term").agg(
        F.sum("size").alias("n_texts"), F.max("max_weight").alias("max_weight"), F.count(F.lit(1)).alias("n_blocks")
    )
