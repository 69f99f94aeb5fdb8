"""Helpers of this subpackage: columns, words, hashes, state of a Python worker and connected components."""

from __future__ import annotations

import gc
import sys
import types
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankspark.session import cut, setting


class MissingColumn(ValueError):
    """A table lacks a column that the operator reads."""


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """The named columns under the names of the operator; all others stay out, so their names cannot clash."""
    lost = [c for c in columns.values() if c not in df.columns]
    if lost:
        raise MissingColumn(f"{lost} not in {df.columns}")
    return df.select(*[df[c].alias(name) for name, c in columns.items()])


def _kept_by_worker() -> dict[str, Any]:
    return sys.modules.setdefault("_kept_by_worker", types.ModuleType("_kept_by_worker")).__dict__.setdefault("objects", {})


def forget_earlier_stages() -> None:
    """Drop what tasks of earlier stages left in this Python worker."""
    kept = _kept_by_worker()
    if kept:
        kept.clear()
        gc.collect()  # memos refer to methods of their owner


def per_worker(key: str, make: Callable[[], Any]) -> Any:
    """An object made once per Python worker process and kept for its later tasks, until another one is asked for.

    A worker serves tasks of many stages: what an earlier one remembered does not stay beside what a later one needs.
    """
    kept = _kept_by_worker()
    if key not in kept:
        forget_earlier_stages()
        kept[key] = make()
    return kept[key]


@contextmanager
def many_small_objects() -> Iterator[None]:
    """Without the cycle collector, which would walk a large memo again and again; nothing made here has cycles."""
    gc.disable()
    try:
        yield
    finally:
        gc.enable()


class Memo(dict):
    """Values computed on first use; emptied when it holds ``limit`` of them, so memory stays bounded."""

    def __init__(self, make: Callable[[Any], Any], limit: int = 100_000) -> None:
        super().__init__()
        self.make, self.limit = make, limit

    def __missing__(self, key: Any) -> Any:
        if len(self) >= self.limit:
            self.clear()
        found = self[key] = self.make(key)
        return found


class Recent(dict):
    """Values computed on first use, of which the last ``limit`` to twice as many stay.

    When ``limit`` are held, they become the elder generation and those of the one before are dropped; a value
    that is used again moves to the younger one. So what is used often is not computed anew.
    """

    def __init__(self, make: Callable[[Any], Any], limit: int) -> None:
        super().__init__()
        self.make, self.limit = make, limit
        self.elder: dict = {}

    def __missing__(self, key: Any) -> Any:
        found = self.elder.pop(key, None)
        if found is None:
            found = self.make(key)
        if len(self) >= self.limit:
            self.elder = dict(self)
            self.clear()
        self[key] = found
        return found


def slices(batches: Iterable[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The same rows in small batches, and unused memory handed back at the end: workers serve many tasks."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
    pa.default_memory_pool().release_unused()


def slices_by_bytes(batch: pa.RecordBatch, column: str, most_bytes: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches whose texts have about ``most_bytes`` bytes, one row at least."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        before = int(ends[at - 1]) if at else 0
        until = max(at + 1, int(np.searchsorted(ends, before + most_bytes, side="right")))
        yield batch.slice(at, until - at)
        at = until
    pa.default_memory_pool().release_unused()


def byte_strings(column: pa.Array) -> Iterator[bytes | None]:
    """UTF-8 bytes of a text column, one value in Python's memory at a time."""
    for x in column.cast(pa.large_binary()):
        yield x.as_py()


def words(text: bytes) -> list[bytes]:
    """Words between the six ASCII white space characters, A-Z in lower case."""
    return text.lower().split()


def word_hashes(text: bytes, memo: Memo) -> np.ndarray:
    found = words(text)
    return np.fromiter(map(memo.__getitem__, found), dtype=np.uint64, count=len(found))


def hash_memo() -> Memo:
    return per_worker("word hashes", lambda: Memo(xxhash.xxh3_64_intdigest))


_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit numbers (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


def shingles(hashes: np.ndarray, size: int) -> np.ndarray:
    """Distinct hashes of all runs of ``size`` words, sorted; the whole text is one run if it has fewer words."""
    n = len(hashes)
    if n == 0:
        return hashes
    width = min(size, n)
    total = np.zeros(n - width + 1, dtype=np.uint64)
    for k in range(width):
        total = mix(total + hashes[k : n - width + 1 + k] + np.uint64(k + 1))
    return np.unique(total)


def batches_of(rows: Iterable[tuple], schema: pa.Schema, size: int = 2000) -> Iterator[pa.RecordBatch]:
    """Row tuples as Arrow batches of bounded length."""
    part: list[tuple] = []
    for row in rows:
        part.append(row)
        if len(part) == size:
            yield _batch(part, schema)
            part = []
    if part:
        yield _batch(part, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(column, field.type) for column, field in zip(zip(*rows), schema, strict=True)], schema=schema
    )


def is_empty(df: DataFrame) -> bool:
    return df.limit(1).count() == 0


def first_rows(rows: DataFrame, group: str, most: int) -> DataFrame:
    """The first ``most`` rows of each group by a hash of ``candidate_id``; rows of one id by their text. Stored.

    Every task keeps at most ``most`` rows of a group before any are shuffled, so a group or
    an id that holds most of the rows does not gather in one task.
    """
    keys = [F.xxhash64("candidate_id"), F.col("candidate_id")]
    if "text" in rows.columns:
        keys += [F.xxhash64("text"), F.col("text")]
    order = Window.partitionBy(group).orderBy(*keys)
    with setting(rows.sparkSession, "spark.sql.optimizer.windowGroupLimitThreshold", str(max(1000, most))):
        return cut(rows.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= most).drop("nth"))


def crc_remainder(id_column: Column, parts: int) -> Column:
    """``crc32`` of the id written as text, modulo ``parts``; null for a null id."""
    return F.pmod(F.crc32(id_column.cast("string").cast("binary")), F.lit(parts))


def connected(edges: DataFrame) -> DataFrame:
    """``v, root``: the connected component of every end ``a`` or ``b`` (long) of the edges.

    Every round each vertex joins the smallest of its neighbours and itself, and the graph
    is contracted. The order is that of the ids in one round and random in the next: the
    first settles stars at once, the second shrinks any chain by a constant share, so the
    number of rounds grows with the logarithm of the largest component. All of it is
    aggregations and joins over stored tables.
    """
    left = cut(edges.where("a <> b").select("a", "b").distinct())
    labels: DataFrame | None = None
    at = 0
    while not is_empty(left):
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        if at % 2 == 0:
            lower = both.groupBy("a").agg(F.min("b").alias("b"))
            target = F.least("a", "b")
        else:
            by = lambda c: F.xxhash64(c, F.lit(at))
            lower = both.groupBy("a").agg(F.min_by("b", by("b")).alias("b"))
            target = F.when(by("b") < by("a"), F.col("b")).otherwise(F.col("a"))
        step = cut(lower.select(F.col("a").alias("v"), target.alias("to")))
        one = step.select(F.col("v").alias("a"), F.col("to").alias("to_a"))
        two = step.select(F.col("v").alias("b"), F.col("to").alias("to_b"))
        left = cut(
            left.join(one, "a")
            .join(two, "b")
            .where("to_a <> to_b")
            .select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b"))
            .distinct()
        )
        if labels is None:
            labels = step.select("v", F.col("to").alias("root"))
        else:
            moved = step.select(F.col("v").alias("root"), "to")
            labels = cut(labels.join(moved, "root", "left").select("v", F.coalesce("to", "root").alias("root")))
        at += 1
    if labels is None:
        return edges.sparkSession.createDataFrame([], "v bigint, root bigint")
    return labels
