"""Near-duplicate candidate vectors by an exact join in passes over vectors that are stored once.

Unit vectors whose cosine is at least ``c`` are no further apart than the angle ``acos(c)``.
Vectors go to the nearest of some drawn ones (pivots); those of a pivot are divided into
small cells around centres, and the cells are stored one after the other. Nothing is
shuffled after that: in a pass every task holds a bounded run of cells, sent to all
executors, and reads the cells from there on. So disk follows the number of vectors, not
that of pairs.

A vector meets the vectors of a cell only if its angle to the centre is at most theirs and
``acos(c)`` more. Pairs are first multiplied on the principal dimensions; with the lengths
of what is left of both, this bounds the cosine from above. What remains is multiplied in
full, and in double precision near the limit. All of these are bounds, so nothing is lost.

A task reports numbers of links per vector and a spanning forest of its links, never the
links themselves: its result is as small as what it holds and reads.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, fields

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from rankspark.llm.common import connected, is_empty, per_worker, pick
from rankspark.session import cut, scratch_path, setting


@dataclass(frozen=True)
class GridConfig:
    """A cell has at most ``block`` vectors, and ``fan_out`` bounds if it has so many; ``leading`` principal
    dimensions bound a pair before it is multiplied in full. A task holds cells of about ``held_bytes`` and compares
    ``at_a_time`` vectors with them in one step. At most about ``pivots`` vectors are drawn. No size changes the result."""

    cosine: float = 0.95
    leading: int = 23
    block: int = 512
    fan_out: int = 16
    rows_per_task: int = 20_000
    at_a_time: int = 32_768
    pivots: int = 1024
    held_bytes: int = 32 << 20

    def __post_init__(self) -> None:
        sizes = (self.leading, self.block, self.rows_per_task, self.at_a_time, self.pivots, self.held_bytes)
        if not 0 < self.cosine <= 1 or min(sizes) <= 0 or self.fan_out < 2:
            raise ValueError("cosine must be in (0, 1], sizes positive and fan_out at least 2")

    @property
    def angle(self) -> float:
        return math.acos(self.cosine)


#: Bytes of vectors that are compared or divided into cells at a time, and of an Arrow batch of cells.
AT_A_TIME = 8 << 20
IN_A_BATCH = 4 << 20


def kind_of(vectors: DataFrame) -> str:
    """How a component is stored: four bytes where the table has no more."""
    t = vectors.schema["embedding"].dataType
    return "<f4" if isinstance(t, ArrayType) and isinstance(t.elementType, FloatType) else "<f8"


def _matrix(column: pa.Array, kind: str, dims: int) -> np.ndarray:
    """Bodies of one length as rows, without a copy."""
    ends = np.frombuffer(column.buffers()[1], np.int64 if pa.types.is_large_binary(column.type) else np.int32)
    ends = ends[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[ends[0] : ends[-1]].view(kind).reshape(-1, dims)


def _units(m: np.ndarray) -> np.ndarray:
    """Rows of unit length in double precision; scaled first, so that squares neither overflow nor vanish."""
    m = np.asarray(m, dtype=np.float64)
    m = m / np.abs(m).max(axis=1, keepdims=True)
    return m / np.sqrt((m * m).sum(axis=1, keepdims=True))


def _short_units(m: np.ndarray, rows: int = 4096) -> np.ndarray:
    """The same in single precision."""
    out = np.empty(m.shape, np.float32)
    for at in range(0, len(m), rows):
        out[at : at + rows] = _units(m[at : at + rows])
    return out


def _margin(dims: int) -> float:
    """More than products of unit vectors in single precision can be wrong by."""
    return (dims + 16) * 1.2e-7


def _nearest(u: np.ndarray, centres: np.ndarray, rows: int = 2048) -> np.ndarray:
    parts = [(u[at : at + rows] @ centres.T).argmax(axis=1) for at in range(0, len(u), rows)]
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)


def _good(column: pa.Array, kind: str) -> tuple[np.ndarray, list[np.ndarray]]:
    """Places of the vectors that can have links, and their components; of one matrix if all have one length."""
    lengths = column.value_lengths()
    values = column.flatten()
    if len(column) and not column.null_count and not values.null_count and len(lengths.unique()) == 1 and lengths[0].as_py():
        m = values.to_numpy(zero_copy_only=False).reshape(len(column), -1) + 0.0
        at = np.flatnonzero(np.isfinite(m).all(axis=1) & m.any(axis=1))
        return at, list(m[at].astype(kind))
    at, found = [], []
    for i, x in enumerate(column):
        if not x.is_valid or len(x.values) == 0 or x.values.null_count:
            continue
        v = x.values.to_numpy(zero_copy_only=False) + 0.0
        if np.isfinite(v).all() and v.any():
            at.append(i)
            found.append(v.astype(kind))
    return np.array(at, np.int64), found


def usable(vectors: DataFrame, pivots: np.ndarray | None = None) -> DataFrame:
    """``candidate_id, dims, home, body``: vectors that can have links, as bytes, and their nearest pivot.

    Null and empty vectors, and those that are zero or hold a null, NaN or infinite
    component, are left out; -0.0 is 0.0. Vectors as long as no pivot have home 0.
    """
    id_kind, kind = vectors.schema["candidate_id"].dataType.simpleString(), kind_of(vectors)
    shared = None if pivots is None else vectors.sparkSession.sparkContext.broadcast(pivots)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, found = _good(batch.column("embedding"), kind)
            dims = np.array([len(v) for v in found], np.int32)
            home = np.zeros(len(found), np.int32)
            if shared is not None:
                same = np.flatnonzero(dims == shared.value.shape[1])
                if len(same):
                    home[same] = _nearest(_short_units(np.stack([found[i] for i in same])), shared.value)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("candidate_id").take(pa.array(at, pa.int64())),
                    pa.array(dims),
                    pa.array(home),
                    pa.array([v.tobytes() for v in found], pa.binary()),
                ],
                names=["candidate_id", "dims", "home", "body"],
            )

    return vectors.select("candidate_id", "embedding").mapInArrow(run, f"candidate_id {id_kind}, dims int, home int, body binary")


def pivots_of(vectors: DataFrame, cfg: GridConfig) -> np.ndarray | None:
    """Unit vectors drawn by a hash of the components: they decide how vectors are dealt out, never what is compared."""
    n = vectors.count()
    if n == 0:
        return None
    wanted = min(cfg.pivots, max(1, n // cfg.block))
    drawn = vectors.where(F.pmod(F.xxhash64("embedding"), F.lit(n)) < wanted).select("embedding").distinct()
    found = usable(drawn.select(F.lit(0).alias("candidate_id"), "embedding")).select("dims", "body").toArrow()
    if not found.num_rows:
        return None
    dims = found.column("dims").to_numpy()
    usual = int(np.bincount(dims).argmax())
    bodies = found.column("body").take(pa.array(np.flatnonzero(dims == usual))).to_pylist()
    return _short_units(np.stack([np.frombuffer(b, kind_of(vectors)) for b in sorted(bodies)]))


def principal(reps: DataFrame, dims: int, k: int, kind: str) -> np.ndarray:
    """The ``k`` leading principal directions of all unit vectors with ``dims`` components.

    Every task adds up its rows; what reaches the driver has ``dims`` squared numbers, whatever the input.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, first, second = 0, np.zeros(dims), np.zeros((dims, dims))
        for batch in batches:
            if batch.num_rows:
                m = _units(_matrix(batch.column("body"), kind, dims))
                n, first, second = n + len(m), first + m.sum(axis=0), second + m.T @ m
        if n:
            values = np.concatenate(([n], first, second[np.triu_indices(dims)]))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(values))), pa.array(values)], names=["at", "x"])

    sums = reps.where(F.col("dims") == dims).select("body").mapInArrow(run, "at bigint, x double")
    rows = sums.groupBy("at").agg(F.sum("x").alias("x")).orderBy("at").toArrow()
    values = rows.column("x").to_numpy()
    n, first = values[0], values[1 : dims + 1]
    second = np.zeros((dims, dims))
    second[np.triu_indices(dims)] = values[dims + 1 :]
    second = second + second.T - np.diag(np.diag(second))
    mean = first / n
    _, directions = np.linalg.eigh(second / n - np.outer(mean, mean))
    return np.ascontiguousarray(directions[:, ::-1][:, : min(k, dims)])


def _shadow(u: np.ndarray, directions: np.ndarray) -> np.ndarray:
    """Unit vectors on the leading directions, and the length of the rest: products of these are no smaller than cosines.

    Vectors of another length are cut or filled, which enlarges no distance.
    """
    d = directions.shape[0]
    m = u[:, :d] if u.shape[1] >= d else np.pad(u, ((0, 0), (0, d - u.shape[1])))
    p = m @ directions.astype(np.float32)
    rest = np.maximum(1 - (p * p).sum(axis=1), 0) + 4 * _margin(max(u.shape[1], d))
    return np.concatenate([p, np.sqrt(rest)[:, None]], axis=1, dtype=np.float32)


def _runs(batches: Iterable[pa.RecordBatch], kind: str) -> Iterator[tuple[int, pa.Table]]:
    """``dims`` and rows of one length and one pivot, at most about ``AT_A_TIME`` bytes of them."""
    now, held, size = None, [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        key = np.stack([batch.column(c).to_numpy() for c in ("dims", "home")], axis=1)
        cuts = np.flatnonzero((np.diff(key, axis=0) != 0).any(axis=1)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(key)], strict=True):
            if held and (tuple(key[a]) != now or size >= AT_A_TIME):
                yield int(now[0]), pa.Table.from_batches(held).combine_chunks()
                held, size = [], 0
            now = tuple(key[a])
            held.append(batch.slice(a, b - a))
            size += (b - a) * int(now[0]) * np.dtype(kind).itemsize
    if held:
        yield int(now[0]), pa.Table.from_batches(held).combine_chunks()


def _means(u: np.ndarray, home: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Directions of the means of the rows of each home; the one before where there is none."""
    order = np.argsort(home, kind="stable")
    there, starts = np.unique(home[order], return_index=True)
    sums = np.add.reduceat(u[order], starts, axis=0)
    lengths = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
    made = before.copy()
    made[there] = np.where(lengths > 1e-3, sums / np.maximum(lengths, 1e-3), before[there])
    return made


def _cells(u: np.ndarray, most: int, rounds: int = 3) -> Iterator[np.ndarray]:
    """Rows in cells around their means, half of ``most`` in one on average, the closest to the mean first."""
    k = max(1, round(2 * len(u) / most))
    centres = u[np.linspace(0, len(u) - 1, k).astype(np.int64)]
    home = np.zeros(len(u), np.int64)
    for _ in range(rounds if k > 1 else 0):
        home = _nearest(u, centres)
        centres = _means(u, home, centres)
    centres = _means(u, home, centres)
    order = np.lexsort((-np.einsum("ij,ij->i", u, centres[home]), home))
    for rows in np.split(order, np.flatnonzero(np.diff(home[order])) + 1):
        yield from np.array_split(rows, -(-len(rows) // most))


def cells_of(reps: DataFrame, parts: int, kind: str, cfg: GridConfig) -> DataFrame:
    """The cells one after the other: ``at, size, dims, vs, ns, body``, one row each; all their vectors have one length."""
    order = ["dims", "home", "v"]
    # vectors go to ranges of the sequence by a stored table, so a lost task finds the same ones again
    sequence = reps.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    schema = pa.schema(
        [
            ("at", pa.int64()),
            ("size", pa.int64()),
            ("dims", pa.int32()),
            ("vs", pa.list_(pa.int64())),
            ("ns", pa.list_(pa.int64())),
            ("body", pa.binary()),
        ]
    )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId() << 32
        for dims, rows in _runs(batches, kind):
            vs, ns = (rows.column(c).to_numpy() for c in ("v", "n"))
            m = _matrix(rows.column("body").combine_chunks(), kind, dims)
            for cell in _cells(_short_units(m), cfg.block):
                body = m[cell].tobytes()
                row = [[at], [len(body)], [dims], [vs[cell]], [ns[cell]], [body]]
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(row, schema, strict=True)], schema=schema)
                at += 1

    return sequence.select("v", "n", "dims", "home", "body").mapInArrow(
        run, "at bigint, size bigint, dims int, vs array<bigint>, ns array<bigint>, body binary"
    )


def _exact(x: np.ndarray, y: np.ndarray) -> float:
    """Cosine of two vectors with correctly rounded sums, for pairs at the very limit."""
    x, y = x.astype(np.float64), y.astype(np.float64)
    dot = math.fsum(a * b for a, b in zip(x.tolist(), y.tolist(), strict=True))
    return dot / math.sqrt(math.fsum(a * a for a in x.tolist()) * math.fsum(b * b for b in y.tolist()))


def _decide(x: np.ndarray, y: np.ndarray, cosine: float, rows: int = 4096) -> np.ndarray:
    """Whether rows of ``x`` and ``y`` at the same place are linked, in double precision."""
    out = np.zeros(len(x), bool)
    for at in range(0, len(x), rows):
        a, b = x[at : at + rows], y[at : at + rows]
        m = np.einsum("ij,ij->i", _units(a), _units(b))
        out[at : at + rows] = m >= cosine
        for i in np.flatnonzero(np.abs(m - cosine) < 1e-12):
            out[at + i] = _exact(a[i], b[i]) >= cosine
    return out


def _find(parent: np.ndarray, ids: np.ndarray) -> np.ndarray:
    roots = parent[ids]
    while True:
        up = parent[roots]
        if (up == roots).all():
            parent[ids] = roots
            return roots
        roots = parent[up]


@dataclass
class Vectors:
    """Vectors of one length in the order of the sequence."""

    dims: int
    raw: np.ndarray
    vs: np.ndarray
    ns: np.ndarray
    ats: np.ndarray
    starts: np.ndarray

    @classmethod
    def of(cls, cells: pa.Table, dims: int, kind: str) -> Vectors:
        """From rows of cells with ``dims`` components, in their order."""
        raw = np.concatenate([_matrix(c, kind, dims) for c in cells.column("body").chunks if len(c)])
        vs, ns = (cells.column(c).combine_chunks().flatten().to_numpy() for c in ("vs", "ns"))
        counts = cells.column("vs").combine_chunks().value_lengths().to_numpy()
        return cls(dims, raw, vs, ns, cells.column("at").to_numpy(), np.concatenate([[0], np.cumsum(counts)[:-1]]))

    def plain(self) -> tuple:
        """Numbers and arrays only, for a broadcast."""
        return tuple(getattr(self, f.name) for f in fields(self))


class Held:
    """Cells that a worker holds, with what decides which vectors meet them."""

    def __init__(self, vectors: Vectors, directions: np.ndarray, cfg: GridConfig) -> None:
        self.vectors, self.cfg = vectors, cfg
        self.margin = _margin(max(vectors.dims, directions.shape[0]))
        u = _short_units(vectors.raw)
        self.shadow = _shadow(u, directions)
        self.ends = np.append(vectors.starts[1:], len(u))
        cell = np.repeat(np.arange(len(self.ends)), self.ends - vectors.starts)
        self.centres = _means(u, cell, u[vectors.starts])
        to_centre = np.einsum("ij,ij->i", u, self.centres[cell])
        place = np.arange(len(u)) - vectors.starts[cell]
        self.parts = np.flatnonzero(place % -(-cfg.block // cfg.fan_out) == 0)
        widest = np.arccos(np.clip(np.minimum.reduceat(to_centre, self.parts) - self.margin, -1, 1)) + cfg.angle
        self.bounds = (np.cos(np.minimum(widest, np.pi)) - 4 * self.margin).astype(np.float32)
        self.first_part = np.append(np.searchsorted(self.parts, vectors.starts), len(self.parts))
        self.part_ends = np.append(self.parts[1:], len(u))


class Met:
    """What a task finds among the vectors it holds and those it reads: numbers of links and a spanning forest."""

    def __init__(self, held: Held) -> None:
        self.held = held
        self.n = np.zeros(len(held.vectors.raw), np.int64)
        self.parent = np.arange(len(self.n))

    def read(self, right: Vectors, directions: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
        """Links of vectors of the same or later cells: pairs ``v, n`` of those read, and edges (marked)."""
        held, left, cfg = self.held, self.held.vectors, self.held.cfg
        size = len(left.raw)
        # a vector that is held has the same number on both sides, so each pair is met once
        where = np.minimum(np.searchsorted(left.ats, right.ats), len(left.ats) - 1)
        begin = np.where(left.ats[where] == right.ats, left.starts[where] - right.starts, size)
        counts = np.append(right.starts[1:], len(right.raw)) - right.starts
        self.number = np.arange(len(right.raw)) + np.repeat(begin, counts)
        self.parent = np.concatenate([self.parent[:size], np.arange(size, size + len(right.raw))])
        self.right, self.u = right, _short_units(right.raw)
        self.shadow, self.right_n, self.edges = _shadow(self.u, directions), np.zeros(len(right.raw), np.int64), []
        last, group = int(self.number.max()), max(1, AT_A_TIME // (4 * len(self.u)))
        floor = np.float32(cfg.cosine - 4 * held.margin)
        until = int(np.searchsorted(left.starts, last))  # cells that begin after the last one read have met it before
        for at in range(0, until, group):
            to_centre = held.centres[at : min(at + group, until)] @ self.u.T
            for cell, near_by in enumerate(to_centre, at):
                for part in range(held.first_part[cell], held.first_part[cell + 1]):
                    some = np.flatnonzero(near_by >= held.bounds[part])
                    if len(some):
                        a, b = int(held.parts[part]), int(held.part_ends[part])
                        most = self.shadow.take(some, axis=0) @ held.shadow[a:b].T
                        if most.max() >= floor:
                            self._meet(a, b, some, np.flatnonzero(most >= floor))
        linked = np.flatnonzero(self.right_n)
        if len(linked):
            yield right.vs[linked], self.right_n[linked], False
        for v, other in self.edges:
            yield v, other, True

    def _meet(self, a: int, b: int, some: np.ndarray, pairs: np.ndarray) -> None:
        """Vectors ``a`` to ``b`` of those held and ``some`` of those read; ``pairs`` of these, numbered row by row, may be linked."""
        left, right, cosine = self.held.vectors, self.right, self.held.cfg.cosine
        j, i = np.divmod(pairs, b - a)
        i, j = i + a, some[j]
        later = self.number[j] > i
        pairs, i, j = pairs[later], i[later], j[later]
        if len(pairs) <= 256:
            linked = _decide(left.raw[i], right.raw[j], cosine)
        else:
            x = _short_units(left.raw[a:b])
            if len(pairs) * 8 > len(some) * len(x):
                m = (self.u.take(some, axis=0) @ x.T).take(pairs)
            else:
                m = np.einsum("ij,ij->i", x.take(i - a, axis=0), self.u.take(j, axis=0))
            linked = m >= cosine
            close = np.flatnonzero(np.abs(m - cosine) <= self.held.margin)
            linked[close] = _decide(left.raw[i[close]], right.raw[j[close]], cosine)
        i, j = i[linked], j[linked]
        np.add.at(self.n, i, right.ns[j])
        np.add.at(self.right_n, j, left.ns[i])
        while len(i):
            one, two = _find(self.parent, i), _find(self.parent, self.number[j])
            apart = one != two
            i, j, one, two = i[apart], j[apart], one[apart], two[apart]
            # a root gets one lower root, so no circle arises
            root, chosen = np.unique(np.maximum(one, two), return_index=True)
            self.parent[root] = np.minimum(one, two)[chosen]
            if len(chosen):
                self.edges.append((left.vs[i[chosen]], right.vs[j[chosen]]))

    def of_held(self) -> tuple[np.ndarray, np.ndarray]:
        linked = np.flatnonzero(self.n)
        return self.held.vectors.vs[linked], self.n[linked]


def _by_length(cells: pa.Table, kind: str) -> dict[int, Vectors]:
    dims = cells.column("dims").to_numpy()
    return {int(d): Vectors.of(cells.take(np.flatnonzero(dims == d)), int(d), kind) for d in np.unique(dims)}


def _gathered(batches: Iterable[pa.RecordBatch], most_rows: int) -> Iterator[pa.Table]:
    """Rows of cells until there are enough vectors to compare."""
    held, rows, size = [], 0, 0
    for batch in batches:
        for at, n in enumerate(batch.column("size").to_pylist()):
            if held and (rows >= most_rows or size + n > AT_A_TIME):
                yield pa.Table.from_batches(held).combine_chunks()
                held, rows, size = [], 0, 0
            held.append(batch.slice(at, 1))
            rows += len(batch.column("vs")[at])
            size += n
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _ranges(cells: DataFrame, cfg: GridConfig) -> tuple[list[tuple[int, int]], int]:
    """First and last cell of every pass, and the bytes of the largest cell; the driver gets two numbers per cell."""
    known = cells.select("at", "size").toArrow().sort_by("at")
    ats, sizes = known.column("at").to_numpy(), known.column("size").to_numpy()
    found, first, total = [], 0, 0
    for at, size in enumerate(sizes.tolist()):
        if at > first and total + size > cfg.held_bytes:
            found.append((int(ats[first]), int(ats[at - 1])))
            first, total = at, 0
        total += size
    return [*found, (int(ats[first]), int(ats[-1]))], int(sizes.max())


def joined(cells: DataFrame, directions: np.ndarray, kind: str, cfg: GridConfig) -> DataFrame:
    """``v, n, other``: numbers of links per vector (``other`` null) and links of a spanning forest (``n`` null). Stored.

    A pass is finished before its cells give way to the next ones; it reads the cells from there on.
    """
    spark = cells.sparkSession
    schema = pa.schema([("v", pa.int64()), ("n", pa.int64()), ("other", pa.int64())])
    path = scratch_path(spark, "links")

    def one_pass(first: int, last: int) -> None:
        kept = cells.where(F.col("at").between(first, last)).toArrow().sort_by("at")
        shared = spark.sparkContext.broadcast(([v.plain() for v in _by_length(kept, kind).values()], uuid.uuid4().hex))
        del kept

        def held() -> dict[int, Held]:
            return {x[0]: Held(Vectors(*x), directions, cfg) for x in shared.value[0]}

        def row(v: np.ndarray, x: np.ndarray, is_edge: bool) -> pa.RecordBatch:
            none, x = pa.nulls(len(v), pa.int64()), pa.array(x, pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(v, pa.int64()), *((none, x) if is_edge else (x, none))], schema=schema)

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            here = per_worker(f"cells {shared.value[1]}", held)
            met = {d: Met(h) for d, h in here.items()}
            for some in _gathered(batches, cfg.at_a_time):
                for dims, right in _by_length(some, kind).items():
                    if dims in met:
                        for made in met[dims].read(right, directions):
                            yield row(*made)
            for m in met.values():
                yield row(*m.of_held(), False)
            pa.default_memory_pool().release_unused()

        made = cells.where(F.col("at") >= first).mapInArrow(run, "v bigint, n bigint, other bigint")
        made.hint("rebalance").write.mode("append").parquet(path)
        shared.destroy()

    passes, largest = _ranges(cells, cfg)
    with setting(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", str(max(1, IN_A_BATCH // largest))):
        for first, last in passes:
            one_pass(first, last)
    return spark.read.schema("v bigint, n bigint, other bigint").parquet(path)


def near_duplicate_vectors(
    vectors: DataFrame, cfg: GridConfig = GridConfig(), candidate_id: str = "candidate_id", embedding: str = "embedding"
) -> DataFrame:
    """``candidate_id, n_links, component_id, kept`` for every row of ``vectors``.

    Two rows are linked if the cosine of their vectors, in double precision, reaches the
    limit. ``n_links`` counts the other rows linked directly, equal vectors included, and
    ``component_id`` is the smallest candidate id that links reach; ``kept`` marks the rows
    whose id it is. Labels and other columns are not read.

    A vector that is null, empty or zero or holds a null, NaN or infinite component is linked
    with nothing, and so are vectors of different lengths with each other. A row with a null
    id takes part as any other and gets the smallest id of its component. Rows that repeat
    an id are rows of their own. An empty table gives an empty result.
    """
    rows = pick(vectors, candidate_id=candidate_id, embedding=embedding)
    spark, kind = rows.sparkSession, kind_of(rows)
    stored = cut(usable(rows, pivots_of(rows, cfg)).withColumn("v", F.monotonically_increasing_id()))
    named = _named(stored)
    found = stored.groupBy("dims").agg(F.count(F.lit(1)).alias("n")).agg(
        F.max_by("dims", F.struct("n", -F.col("dims"))).alias("usual"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("dims")).alias("numbers")
    ).first()
    if found["usual"] is None:
        return _with_unusable(rows, named.select("candidate_id", (F.col("n") - 1).alias("n_links"), F.col("first_id").alias("component_id")))
    directions = principal(stored, found["usual"], cfg.leading, kind)
    cores = spark.sparkContext.defaultParallelism
    parts = max(
        -(-found["n"] // cfg.rows_per_task),
        -(-found["numbers"] * np.dtype(kind).itemsize // AT_A_TIME),
        min(2 * cores, -(-found["n"] // cfg.block)),
    )
    # only vectors with equal ones are looked up: the others stand for themselves
    copies = cut(named.where("n > 1").select("v", F.when(F.col("v") == F.col("rep"), F.col("n")).otherwise(F.lit(0)).alias("n")))
    reps = stored.drop("candidate_id").join(copies, "v", "left").withColumn("n", F.coalesce("n", F.lit(1).cast("bigint"))).where("n > 0")
    made = joined(cut(cells_of(reps, parts, kind, cfg)), directions, kind, cfg)
    links = made.where("n is not null").groupBy("v").agg(F.sum("n").alias("n_other"))
    edges = made.where("other is not null").select(F.col("v").alias("a"), F.col("other").alias("b"))
    if is_empty(edges):
        linked = named.select("candidate_id", (F.col("n") - 1).alias("n_links"), F.col("first_id").alias("component_id"))
        return _with_unusable(rows, linked)
    rooted = cut(connected(edges).join(links, "v"))
    firsts = named.where("v = rep").select("v", "first_id")
    smallest = rooted.select("v", "root").join(firsts, "v").groupBy("root").agg(F.min("first_id").alias("smallest"))
    per_rep = rooted.join(smallest, "root").select(F.col("v").alias("rep"), "n_other", "smallest")
    linked = named.join(per_rep, "rep", "left").select(
        "candidate_id",
        (F.col("n") - 1 + F.coalesce("n_other", F.lit(0))).alias("n_links"),
        F.when(F.col("n_other").isNull(), F.col("first_id")).otherwise(F.col("smallest")).alias("component_id"),
    )
    return _with_unusable(rows, linked)


def _named(stored: DataFrame) -> DataFrame:
    """``v, candidate_id, rep, n, first_id``: the vector that stands for all equal ones, how many they are and their smallest id.

    Equal vectors meet by their SHA-256, so no vector is shuffled. Stored.
    """
    keyed = stored.select("v", "candidate_id", "dims", F.unhex(F.sha2("body", 256)).alias("digest"))
    equal = keyed.groupBy("dims", "digest").agg(
        F.count(F.lit(1)).alias("n"), F.min("v").alias("rep"), F.min("candidate_id").alias("first_id")
    )
    several = cut(equal.where("n > 1"))
    alone = F.col("n").isNull()
    return cut(
        keyed.join(several, ["dims", "digest"], "left").select(
            "v",
            "candidate_id",
            F.coalesce("rep", "v").alias("rep"),
            F.when(alone, F.col("candidate_id")).otherwise(F.col("first_id")).alias("first_id"),
            F.coalesce("n", F.lit(1).cast("bigint")).alias("n"),
        )
    )


def _with_unusable(rows: DataFrame, linked: DataFrame) -> DataFrame:
    v = F.col("embedding")
    whole = F.size(v) > 0
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) != float("inf")))
    other = F.exists(v, lambda x: x != 0)
    alone = rows.where(~F.coalesce(whole & fine & other, F.lit(False))).select(
        "candidate_id", F.lit(0).cast("bigint").alias("n_links"), F.col("candidate_id").alias("component_id")
    )
    both = linked.unionByName(alone)
    return both.withColumn("kept", F.col("candidate_id").eqNullSafe(F.col("component_id")))
