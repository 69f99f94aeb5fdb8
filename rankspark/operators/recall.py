"""Exact recall: the K most similar candidates for every job.

Every job vector is compared with every candidate vector, but the pairs are never
written out. A task multiplies its Arrow batches with the matrix of job vectors
and keeps only the K best rows per job; these few rows are then shuffled and
merged. Job vectors travel as a block of bounded size. More jobs than one block
holds mean more passes over the vectors, each with as much arithmetic per byte
read as one task can hold, so the result is whole for any number of jobs.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

from rankspark.config import RankConfig
from rankspark.functions.vectors import unit_rows
from rankspark.session import cut, tasks_of


class DuplicateJob(ValueError):
    """Two jobs share an id."""


class MissingVector(ValueError):
    """A job has no vector, so it would be missing from the result."""


def query_blocks(queries: DataFrame, cfg: RankConfig) -> Iterator[tuple[list, np.ndarray]]:
    """Job vectors in blocks small enough for one task, as (ids, matrix of unit rows)."""
    size = max(1, cfg.recall_state_rows // cfg.recall_k)
    slim = queries.select("job_id", "job_vec")
    first = slim.limit(size + 1).collect()
    if len(first) <= size:
        parts = [first]
    else:
        slim = cut(slim)  # or every block would make the job vectors again
        n = -(-2 * slim.count() // size)
        parts = (slim.where(F.pmod(F.xxhash64("job_id"), F.lit(n)) == b).collect() for b in range(n))
    for rows in parts:
        if len({r["job_id"] for r in rows}) < len(rows):
            raise DuplicateJob("job ids must be unique")
        if any(r["job_vec"] is None for r in rows):
            raise MissingVector(f"jobs without a vector: {[r['job_id'] for r in rows if r['job_vec'] is None]}")
        rows = sorted(rows, key=lambda r: r["job_id"])
        if rows:
            yield [r["job_id"] for r in rows], unit_rows(np.array([r["job_vec"] for r in rows]))


def matrix_of(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    """Array column as a matrix, without going through Python lists."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(flat) != len(column) * dim:
        raise ValueError(f"vectors of length {dim} expected")
    return flat.reshape(len(column), dim).astype(np.float64)


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k rows with the highest score; equal scores in order of id."""
    if len(scores) > k:
        limit = np.partition(scores, len(scores) - k)[len(scores) - k]
        close = scores >= limit
        scores, ids = scores[close], ids[close]
        order = np.lexsort((ids, -scores))[:k]
        scores, ids = scores[order], ids[order]
    return scores, ids


class BestRows:
    """The K best rows per job that a task has seen; ``bounds`` has a score per job below which none is wanted."""

    def __init__(self, jobs: list, k: int, bounds: dict) -> None:
        self.jobs, self.k = jobs, k
        self.kept: list = [(np.empty(0), np.empty(0, dtype=object)) for _ in jobs]
        self.floor = np.array([bounds.get(j, -np.inf) for j in jobs])

    def add(self, ids: pa.Array, scores: np.ndarray) -> None:
        """Scores of all jobs (one line each) with the rows of these ids."""
        hit = scores >= self.floor[:, None]
        winners = np.flatnonzero(hit.any(axis=0))
        if not len(winners):
            return
        names = np.empty(len(winners), dtype=object)
        names[:] = ids.take(pa.array(winners)).to_pylist()
        scores, hit = scores[:, winners], hit[:, winners]
        for j in np.flatnonzero(hit.any(axis=1)):
            cols = np.flatnonzero(hit[j])
            held = np.concatenate((self.kept[j][0], scores[j, cols]))
            self.kept[j] = _best(held, np.concatenate((self.kept[j][1], names[cols])), self.k)
            if len(self.kept[j][0]) == self.k:
                self.floor[j] = max(self.floor[j], self.kept[j][0].min())

    def batches(self, job_type: pa.DataType, id_type: pa.DataType) -> Iterator[pa.RecordBatch]:
        for job, (scores, ids) in zip(self.jobs, self.kept, strict=True):
            if len(scores):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([job] * len(scores), job_type), pa.array(ids.tolist(), id_type), pa.array(scores, pa.float64())],
                    names=["job_id", "candidate_id", "sem_score"],
                )


def similarities(batch: pa.RecordBatch, queries: np.ndarray, digits: int, cells: int = 1_000_000):
    """Cosine of all rows of a batch with all queries, in slices of bounded size: their ids, still in Arrow, and scores."""
    dim = queries.shape[1]
    batch = batch.filter(pc.is_valid(batch.column(1)))
    step = max(1, cells // max(len(queries), dim))
    for at in range(0, batch.num_rows, step):
        part = batch.slice(at, step)
        m = unit_rows(matrix_of(part.column(1), dim))
        s = queries @ m.T
        yield part.column(0), np.floor(s * 10.0**digits + 0.5) / 10.0**digits


def _candidate_vectors(vectors: DataFrame) -> DataFrame:
    # rows without a vector are left out by the tasks: a filter here would run an encoder twice
    return vectors.select("candidate_id", F.col("embedding").cast("array<float>"))


def _kinds(vectors: DataFrame, queries: DataFrame) -> tuple[DataType, DataType]:
    """Types of the ids of jobs and candidates: any that Spark can sort."""
    return queries.schema["job_id"].dataType, vectors.schema["candidate_id"].dataType


def _local_best(
    vectors: DataFrame, shared: Broadcast, kinds: tuple[DataType, DataType], k: int, cfg: RankConfig, bounds: dict | None = None
) -> DataFrame:
    """K best rows per job and task. ``shared`` holds job ids and their matrix, ``kinds`` the types of ids.

    ``bounds`` has a score per job below which no row can be among the best K of all tasks.
    """
    bounds = bounds or {}
    digits = cfg.score_digits
    job_type, id_type = map(to_arrow_type, kinds)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        jobs, q = shared.value
        best = BestRows(jobs, k, bounds)
        for batch in batches:
            for ids, s in similarities(batch, q, digits):
                best.add(ids, s)
        yield from best.batches(job_type, id_type)

    return _candidate_vectors(vectors).mapInArrow(run, _schema(kinds))


def _schema(kinds: tuple[DataType, DataType]) -> str:
    job, candidate = (k.simpleString() for k in kinds)
    return f"job_id {job}, candidate_id {candidate}, sem_score double"


def best_per_job(rows: DataFrame, k: int, order: list, salts: int = 1) -> DataFrame:
    """First k rows per job in the given order.

    With salts, groups of a job are cut down in parallel before the last step, so
    that a single job over very many tasks is not merged by one task alone.
    """
    if salts > 1:
        salt = F.pmod(F.xxhash64("candidate_id"), F.lit(salts))
        inner = Window.partitionBy("job_id", "salt").orderBy(*order)
        rows = (
            rows.withColumn("salt", salt)
            .withColumn("rn", F.row_number().over(inner))
            .where(F.col("rn") <= k)
            .drop("rn", "salt")
        )
    outer = Window.partitionBy("job_id").orderBy(*order)
    return rows.withColumn("recall_rank", F.row_number().over(outer)).where(F.col("recall_rank") <= k)


def top_matches(vectors: DataFrame, queries: DataFrame, cfg: RankConfig) -> DataFrame:
    """``(job_id, candidate_id, sem_score, recall_rank)``: exact top K per job, ties by id.

    ``vectors`` has ``candidate_id, embedding`` and ``queries`` has ``job_id, job_vec``; ids may be of any type.
    Jobs of different blocks have nothing in common, so with more than one block each
    pass is finished and stored before the next block is fetched.
    """
    order = [F.desc("sem_score"), F.asc("candidate_id")]
    tasks, kinds = tasks_of(vectors), _kinds(vectors, queries)

    def one_pass(block: tuple[list, np.ndarray]) -> tuple[DataFrame, Broadcast]:
        shared = vectors.sparkSession.sparkContext.broadcast(block)
        bounds = _bounds(vectors, shared, kinds, tasks, order, cfg)
        rows = _local_best(vectors, shared, kinds, cfg.recall_k, cfg, bounds)
        return best_per_job(rows, cfg.recall_k, order, -(-tasks // cfg.tasks_per_merge)), shared

    blocks = query_blocks(queries, cfg)
    first, second = next(blocks, None), next(blocks, None)
    if first is None:
        return vectors.sparkSession.createDataFrame(
            [], f"{_schema(kinds)}, recall_rank int"
        )
    if second is None:
        return one_pass(first)[0]
    found = []
    for block in chain((first, second), blocks):
        best, shared = one_pass(block)
        found.append(cut(best))
        shared.destroy()
    return reduce(DataFrame.unionByName, found)


def _bounds(
    vectors: DataFrame, shared: Broadcast, kinds: tuple[DataType, DataType], tasks: int, order: list, cfg: RankConfig
) -> dict:
    """The K-th best score per job over a share of the candidates: a bound for the K-th best of all.

    With few tasks their own K rows per job are few enough, and nothing is computed.
    """
    if tasks < cfg.bound_from_tasks:
        return {}
    share = vectors.where(F.pmod(F.xxhash64("candidate_id"), F.lit(64)) == 0)
    best = best_per_job(_local_best(share, shared, kinds, cfg.recall_k, cfg), cfg.recall_k, order, -(-tasks // cfg.tasks_per_merge))
    last = best.where(F.col("recall_rank") == cfg.recall_k).select("job_id", "sem_score")
    return {r["job_id"]: r["sem_score"] for r in last.collect()}  # one number per job of the block


def score_summary(vectors: DataFrame, queries: DataFrame, cfg: RankConfig) -> DataFrame:
    """Per job: how many candidates were compared, and the lowest, highest and mean similarity."""
    sc = vectors.sparkSession.sparkContext
    job_kind = queries.schema["job_id"].dataType
    job_type = to_arrow_type(job_kind)
    schema = f"job_id {job_kind.simpleString()}, n bigint, low double, high double, total double"

    def one_pass(block: tuple[list, np.ndarray]) -> tuple[DataFrame, Broadcast]:
        shared = sc.broadcast(block)

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            jobs, m = shared.value
            n, total = 0, np.zeros(len(jobs))
            low, high = np.full(len(jobs), np.inf), np.full(len(jobs), -np.inf)
            for batch in batches:
                for _, s in similarities(batch, m, cfg.score_digits):
                    n += s.shape[1]
                    total += s.sum(axis=1)
                    low, high = np.minimum(low, s.min(axis=1)), np.maximum(high, s.max(axis=1))
            if n:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(jobs, job_type), pa.array([n] * len(jobs), pa.int64())]
                    + [pa.array(x, pa.float64()) for x in (low, high, total)],
                    names=["job_id", "n", "low", "high", "total"],
                )

        return _candidate_vectors(vectors).mapInArrow(run, schema), shared

    # a block is finished before the next one is fetched: one set of job vectors is held at a time
    parts = []
    for block in query_blocks(queries, cfg):
        made, shared = one_pass(block)
        parts.append(cut(made))
        shared.destroy()
    rows = reduce(DataFrame.unionByName, parts, vectors.sparkSession.createDataFrame([], schema))
    return rows.groupBy("job_id").agg(
        F.sum("n").alias("n_scored"),
        F.min("low").alias("min_score"),
        F.max("high").alias("max_score"),
        (F.sum("total") / F.sum("n")).alias("mean_score"),
    )


def missing_records(recalled: DataFrame, candidates: DataFrame) -> DataFrame:
    """Recalled ids without a record."""
    return recalled.join(candidates.select("candidate_id"), "candidate_id", "left_anti")
