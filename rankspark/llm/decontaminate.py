"""Candidate texts that contain passages of job texts, found by the q-gram lemma and verified by alignment.

A window of a job text begins at each of its characters. A passage within ``e`` edits of a
window of ``m`` characters shares at least ``m + 1 - q (e + 1)`` of its q-grams, on diagonals
that differ by ``e`` at most. The q-grams of job texts are indexed once, not per window:
shared ones are counted in overlapping bands of diagonals, wide enough that one band holds
all of a passage's, and along a band a sliding count finds the windows that reach the bound.
A banded alignment decides those. The bound loses nothing: every passage within the edit
budget of a window is found, wherever in the job text it begins.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankspark.llm.common import forget_earlier_stages, pick, slices
from rankspark.session import cut


@dataclass(frozen=True)
class DecontaminationConfig:
    """Passages of ``window`` characters; ``edit_share`` of one may differ; ``block`` pieces of job texts per broadcast."""

    q: int = 10
    window: int = 50
    edit_share: float = 0.07
    block: int = 100_000

    def __post_init__(self) -> None:
        if min(self.q, self.window, self.block) <= 0 or not 0 <= self.edit_share < 1:
            raise ValueError("q, window and block must be positive and edit_share in [0, 1)")
        if self.bound(self.window) < 1:
            raise ValueError("the lemma gives no bound for this q and edit_share")

    def budget(self, length: int) -> int:
        """Edits allowed in a window: its share, as far as the lemma still asks for a common q-gram."""
        return max(0, min(int(length * self.edit_share), (length - self.q) // self.q))

    def bound(self, length: int) -> int:
        return length + 1 - self.q * (self.budget(length) + 1)


def normal(text: str) -> str:
    """Lower case, each run of white space one space."""
    return " ".join(text.lower().split())


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def grams(points: np.ndarray, q: int) -> np.ndarray:
    """A 64-bit number for every run of q code points."""
    n = len(points) - q + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    base = np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        power, factor, width = points.astype(np.uint64) + np.uint64(1), base, 1
        total, done = None, 0
        bits = q
        while bits:  # runs of 1, 2, 4, ... code points, put together to one of q
            if bits & 1:
                if total is None:
                    total = power
                else:
                    keep = len(points) - (done + width) + 1
                    total = total[:keep] * factor + power[done : done + keep]
                done += width
            bits >>= 1
            if bits:
                power = power[: len(power) - width] * factor + power[width:]
                factor, width = factor * factor, width * 2
    return total[:n]


# windows of a piece: those found of one piece are the bits of one number
PIECE = 64
# stands for no character, before and after a text
OUTSIDE = np.uint32(0xFFFFFFFF)


def pieces_of(text: str | None, cfg: DecontaminationConfig) -> list[tuple[str, int]]:
    """``piece, length``: all runs of ``length`` characters in the pieces are the windows of a text.

    Windows have ``cfg.window`` characters. A text that is shorter is one window, and so is a
    text of up to two windows besides, as its edits may all be in what its windows share.
    """
    whole = normal(text or "")
    n, m = len(whole), cfg.window
    found = [(whole[at : min(at + PIECE, n - m + 1) + m - 1], m) for at in range(0, n - m + 1, PIECE)]
    return found + [(whole, n)] if 0 < n < 2 * m and n != m else found


def windows_of(text: str | None, cfg: DecontaminationConfig) -> list[str]:
    """All windows of a text, in the order of its pieces."""
    return [p[at : at + m] for p, m in pieces_of(text, cfg) for at in range(len(p) - m + 1)]


def edits_within(windows: np.ndarray, regions: np.ndarray, most: int) -> np.ndarray:
    """Smallest number of edits from each window to any part of its region; ``most + 1`` stands for more.

    Windows and regions are rows of equal length. Row ``i`` of a table holds diagonals only: its
    cells are ``region position = i + d``. Insertions run along a row and are taken by a running minimum.
    """
    many, length = windows.shape
    width = regions.shape[1] - length + 2 * most + 1
    padded = np.full((many, regions.shape[1] + 2 * most + 1), OUTSIDE, dtype=np.uint32)
    padded[:, most : most + regions.shape[1]] = regions
    steps = np.arange(width, dtype=np.int32)
    row = np.zeros((many, width), dtype=np.int32)
    edits, left = np.full(many, most + 1, dtype=np.int64), np.arange(many)
    for i in range(length):
        new = row + (padded[left, i : i + width] != windows[left, i, None])
        new[:, :-1] = np.minimum(new[:, :-1], row[:, 1:] + 1)
        row = np.minimum.accumulate(new - steps, axis=1) + steps
        if i % 8 == 7:
            open_ = row.min(axis=1) <= most
            if not open_.all():
                left, row = left[open_], row[open_]
            if not len(left):
                return edits
    edits[left] = np.minimum(row.min(axis=1), most + 1)
    return edits


class Index:
    """q-grams of a block of pieces and where they stand; windows are numbered through all pieces."""

    def __init__(
        self, pieces: list[str], owner: list[int], cfg: DecontaminationConfig, lengths: list[int] | None = None, bits: int = 20
    ) -> None:
        """``lengths`` of the windows in each piece; without them, every piece is one window."""
        self.cfg, self.owner, self.bits = cfg, owner, bits
        self.texts = pieces
        self.points = [code_points(p) for p in pieces]
        self.lengths = np.array([len(p) for p in pieces] if lengths is None else lengths, dtype=np.int64)
        self.budget = np.array([cfg.budget(int(m)) for m in self.lengths], dtype=np.int64)
        self.bound = np.array([cfg.bound(int(m)) for m in self.lengths], dtype=np.int64)
        self.many = np.array([len(p) for p in pieces], dtype=np.int64) - self.lengths + 1
        self.base = np.cumsum(self.many) - self.many
        each = [grams(p, cfg.q) for p in self.points]
        values = np.concatenate(each) if each else np.empty(0, dtype=np.uint64)
        piece = np.repeat(np.arange(len(each), dtype=np.int32), [len(x) for x in each])
        position = np.concatenate([np.arange(len(x), dtype=np.int32) for x in each]) if each else np.empty(0, dtype=np.int32)
        order = np.argsort(values, kind="stable")
        self.piece, self.position = piece[order], position[order]
        self.values, first = np.unique(values[order], return_index=True)
        self.first = np.append(first, len(values))
        self.seen = np.zeros(1 << bits, dtype=bool)
        self.seen[self._slot(self.values)] = True
        indexed = self.lengths >= cfg.q
        self.least = int(self.bound[indexed].min()) if indexed.any() else 0
        self.longest = max(map(len, pieces), default=0)
        self.reach = int((self.lengths + self.budget).max()) if pieces else 0
        # texts that are shorter than a q-gram, by length and hash
        self.short: dict[int, dict[int, list[int]]] = {}
        for k in np.flatnonzero(~indexed).tolist():
            by_hash = self.short.setdefault(len(pieces[k]), {})
            by_hash.setdefault(int(grams(self.points[k], len(pieces[k]))[0]), []).append(k)

    def _slot(self, values: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (values * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - self.bits)

    def search(self, text: str) -> Iterator[tuple[int, int, int]]:
        """``(window, edits, start)`` of every window found in the normalised text; the best place of each."""
        if not self.texts or not text:
            return
        points = code_points(text)
        if self.short:
            yield from self._short(text, points)
        if not self.least:
            return
        found = grams(points, self.cfg.q)
        hit = self.seen[self._slot(found)] if len(found) else np.empty(0, dtype=bool)
        near = np.flatnonzero(hit)
        if len(near) < self.least:
            return
        # a region holds the bound's number of hits within the longest window and its budget
        close = np.flatnonzero(near[self.least - 1 :] - near[: len(near) - self.least + 1] <= self.reach)
        if not len(close):
            return
        steps = np.zeros(len(near) + 1, dtype=np.int64)
        steps[close] += 1
        steps[close + self.least] -= 1
        near = near[np.cumsum(steps[:-1]) > 0]
        slot = np.searchsorted(self.values, found[near])
        slot[slot == len(self.values)] = 0
        real = self.values[slot] == found[near]
        near, slot = near[real], slot[real]
        if not len(near):
            return
        many = self.first[slot + 1] - self.first[slot]
        start = np.repeat(self.first[slot], many)
        offset = np.arange(len(start)) - np.repeat(np.cumsum(many) - many, many)
        piece, position = self.piece[start + offset].astype(np.int64), self.position[start + offset].astype(np.int64)
        diagonal = np.repeat(near, many) - position + self.longest  # not negative
        yield from self._verify(text, points, *self._reaching(piece, position, diagonal))

    def pieces_in(self, text: str) -> dict[int, tuple[int, int, int]]:
        """Per piece with windows in the text: those windows as bits, the fewest edits and the first start."""
        made: dict[int, tuple[int, int, int]] = {}
        for w, edits, at in self.search(text):
            k = int(np.searchsorted(self.base, w, side="right")) - 1
            mask, least, first = made.get(k, (0, edits, at))
            made[k] = (mask | 1 << (w - int(self.base[k])), min(least, edits), min(first, at))
        return made

    def _short(self, text: str, points: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """Texts of fewer than q characters, where they stand as whole words."""
        for m, by_hash in self.short.items():
            found = grams(points, m)
            todo = dict(by_hash)
            for at in np.flatnonzero(np.isin(found, np.fromiter(by_hash, dtype=np.uint64))).tolist():
                if text[at - 1 : at].isalnum() or text[at + m : at + m + 1].isalnum():
                    continue
                same = [k for k in todo.get(int(found[at]), ()) if self.texts[k] == text[at : at + m]]
                if same:
                    yield from ((int(self.base[k]), 0, at) for k in same)
                    todo[int(found[at])] = [k for k in todo[int(found[at])] if k not in same]

    def _reaching(self, piece, position, diagonal) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``piece, start, band`` of every window whose q-grams in a band of diagonals reach its bound."""
        # bands of 2 (e + 1) diagonals, one starting every e + 1: diagonals that differ by e share one
        band = diagonal // (self.budget[piece] + 1)
        span, row = int(band.max()) + 2, self.longest + 1
        keys = np.concatenate((piece * span + band, (piece * span + band - 1)[band > 0]))
        at = np.concatenate((position, position[band > 0]))
        pairs = np.unique(keys * row + at)  # a q-gram of the piece counts once in a band
        region, at = pairs // row, pairs % row
        piece = region // span
        last = np.arange(len(pairs)) + self.bound[piece] - 1
        inside = last < len(pairs)
        last[~inside] = 0
        reach = self.lengths[piece] - self.cfg.q  # from the first q-gram of a window to its last
        good = np.flatnonzero(inside & (region[last] == region) & (at[last] - at <= reach))
        low = np.maximum(at[last[good]] - reach[good], 0)
        high = np.minimum(at[good], self.many[piece[good]] - 1)
        many = np.maximum(high - low + 1, 0)
        start = np.repeat(low, many) + np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
        chosen = np.unique(np.repeat(region[good], many) * row + start)
        region = chosen // row
        return region // span, chosen % row, region % span

    def _verify(self, text, points, piece, start, band, rows: int = 4096) -> Iterator[tuple[int, int, int]]:
        best: dict[int, tuple[int, int]] = {}
        e, m = self.budget[piece], self.lengths[piece]
        low = band * (e + 1) - self.longest + start - e
        size = m + 4 * e + 2
        left = []
        for k, (p, s, a, n) in enumerate(zip(piece.tolist(), start.tolist(), low.tolist(), size.tolist(), strict=True)):
            w = int(self.base[p]) + s
            if w in best:
                continue
            # an alignment without edits needs no table
            same = text.find(self.texts[p][s : s + int(m[k])], max(0, a), max(0, a + n))
            if same >= 0:
                best[w] = (0, same)
            elif e[k]:
                left.append(k)
        left = [k for k in left if int(self.base[piece[k]]) + int(start[k]) not in best]
        if left:
            pad = int(size.max()) + self.longest
            padded = np.full(len(points) + 2 * pad, OUTSIDE, dtype=np.uint32)
            padded[pad : pad + len(points)] = points
            by_length: dict[int, list[int]] = {}
            for k in left:
                by_length.setdefault(int(m[k]), []).append(k)
            for length, chosen in by_length.items():
                for part in range(0, len(chosen), rows):
                    some = chosen[part : part + rows]
                    windows = np.stack([self.points[piece[k]][start[k] : start[k] + length] for k in some])
                    regions = padded[(low[some] + pad)[:, None] + np.arange(int(size[some[0]]))]
                    for k, edits in zip(some, edits_within(windows, regions, int(e[some[0]])).tolist(), strict=True):
                        w = int(self.base[piece[k]]) + int(start[k])
                        if edits <= e[k] and (w not in best or edits < best[w][0]):
                            best[w] = (edits, max(0, int(low[k])))
        for w, (edits, at) in best.items():
            yield w, edits, at


def job_pieces(jobs: DataFrame, cfg: DecontaminationConfig) -> DataFrame:
    """``job_id, piece_no, length, piece``: pieces of all job texts, each with up to ``PIECE`` windows."""
    kind = jobs.schema["job_id"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                found = pieces_of(batch.column("jd_text")[at].as_py(), cfg)
                ids = pa.array([batch.column("job_id")[at].as_py()] * len(found), batch.schema.field("job_id").type)
                yield pa.RecordBatch.from_arrays(
                    [
                        ids,
                        pa.array(range(len(found)), pa.int64()),
                        pa.array([m for _, m in found], pa.int64()),
                        pa.array([p for p, _ in found], pa.string()),
                    ],
                    names=["job_id", "piece_no", "length", "piece"],
                )

    return jobs.mapInArrow(run, f"job_id {kind}, piece_no bigint, length bigint, piece string")


def _blocks(pieces: DataFrame, cfg: DecontaminationConfig) -> Iterator[list]:
    """Pieces in blocks of about ``cfg.block``, so that what is broadcast is bounded however many jobs there are."""
    parts = -(-pieces.count() // cfg.block)
    for part in range(parts):
        chosen = pieces.where(F.pmod(F.xxhash64("job_id", "piece_no"), F.lit(parts)) == part) if parts > 1 else pieces
        yield chosen.orderBy("job_id", "piece_no").collect()


FOUND = "candidate_id {}, job_id {}, piece_no bigint, found bigint, edits bigint, start bigint"


def _search(texts: DataFrame, shared: Broadcast, cfg: DecontaminationConfig, job_kind: str) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_earlier_stages()
        rows = shared.value
        index = Index([r[3] for r in rows], list(range(len(rows))), cfg, [r[2] for r in rows])
        for batch in slices(batches):
            owner, job, number, bits, edits, start = [], [], [], [], [], []
            for at in range(batch.num_rows):
                text = batch.column("text")[at].as_py()
                if text:
                    for k, (mask, e, s) in index.pieces_in(normal(text)).items():
                        owner.append(at)
                        job.append(rows[k][0])
                        number.append(rows[k][1])
                        bits.append(mask)
                        edits.append(e)
                        start.append(s)
            if owner:
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("candidate_id").take(pa.array(owner)),
                        pa.array(job),
                        pa.array(number, pa.int64()),
                        pa.array(np.array(bits, dtype=np.uint64).view(np.int64)),
                        *[pa.array(x, pa.int64()) for x in (edits, start)],
                    ],
                    names=["candidate_id", "job_id", "piece_no", "found", "edits", "start"],
                )

    kind = texts.schema["candidate_id"].dataType.simpleString()
    return texts.mapInArrow(run, FOUND.format(kind, job_kind))


def job_passages(
    candidates: DataFrame,
    jobs: DataFrame,
    cfg: DecontaminationConfig = DecontaminationConfig(),
    candidate_id: str = "candidate_id",
    text: str = "text",
    job_id: str = "job_id",
    jd_text: str = "jd_text",
) -> DataFrame:
    """``candidate_id, job_id, n_windows, edits, start``: candidates whose text contains passages of a job text.

    One row per candidate and job that share a passage: how many windows of the job were
    found (one begins at each of its characters), the fewest edits in one of them and where the
    first region begins in the normalised candidate text. A passage of ``window`` characters
    of a job text, beginning anywhere, or a whole shorter job text, is found if it is within
    the edit budget; a shorter passage of a longer job text is none. A job text of fewer than
    ``q`` characters is found where it stands unchanged as whole words.

    Null and empty texts share nothing. Rows that repeat a candidate or job id count as one; rows without an id
    on either side are read as one candidate or job without an id. Empty tables give an empty result, and
    other columns are not read. Texts are read whole.
    """
    texts = pick(candidates, candidate_id=candidate_id, text=text)
    wanted = pick(jobs, job_id=job_id, jd_text=jd_text)
    pieces = cut(job_pieces(wanted, cfg))
    job_kind = wanted.schema["job_id"].dataType.simpleString()
    spark = texts.sparkSession
    found: DataFrame | None = None
    for rows in _blocks(pieces, cfg):
        shared = spark.sparkContext.broadcast([tuple(r) for r in rows])
        part = cut(_search(texts, shared, cfg, job_kind))
        shared.destroy()
        found = part if found is None else found.unionByName(part)
    if found is None:
        kind = texts.schema["candidate_id"].dataType.simpleString()
        found = spark.createDataFrame([], FOUND.format(kind, job_kind))
    of_pieces = found.groupBy("candidate_id", "job_id", "piece_no").agg(
        F.bit_or("found").alias("found"), F.min("edits").alias("edits"), F.min("start").alias("start")
    )
    return of_pieces.groupBy("candidate_id", "job_id").agg(
        F.sum(F.bit_count("found").cast("bigint")).alias("n_windows"), F.min("edits").alias("edits"), F.min("start").alias("start")
    )


def without_job_passages(
    candidates: DataFrame,
    jobs: DataFrame,
    cfg: DecontaminationConfig = DecontaminationConfig(),
    candidate_id: str = "candidate_id",
    text: str = "text",
    job_id: str = "job_id",
    jd_text: str = "jd_text",
) -> DataFrame:
    """The rows of ``candidates`` whose text shares no passage with a job text, all columns as they were.

    Each row is judged by its own text: of rows that repeat an id or have none, only those
    with a passage go. Rows with a null or empty text stay, rows that repeat both id and
    text go or stay together, and an empty table on either side leaves all rows as they are.

    Job texts of one block, the usual case, are looked for where the rows stand: nothing is
    shuffled or stored, and the search runs when the result is read. With more blocks the rows
    with a passage are found block by block and meet ``candidates`` in a join.
    """
    pieces = cut(job_pieces(pick(jobs, job_id=job_id, jd_text=jd_text), cfg))
    if pieces.count() <= cfg.block:
        rows = next(_blocks(pieces, cfg), None)
        return candidates if rows is None else _clean_rows(candidates, rows, cfg, text)
    picked = pick(candidates, candidate_id=candidate_id, text=text)
    by_row = picked.select(F.struct("candidate_id", F.sha2("text", 256).alias("digest")).alias("row"), "text")
    found = job_passages(by_row, jobs, cfg, "row", "text", job_id, jd_text)
    gone = found.select(F.col("candidate_id.candidate_id").alias("gone_id"), F.col("candidate_id.digest").alias("gone_text"))
    gone = cut(gone.distinct())  # its real size decides whether whole texts are shuffled for the join
    same = candidates[candidate_id].eqNullSafe(gone["gone_id"]) & (F.sha2(candidates[text], 256) == gone["gone_text"])
    return candidates.join(gone, same, "left_anti")


def _clean_rows(candidates: DataFrame, rows: list, cfg: DecontaminationConfig, text: str) -> DataFrame:
    """The rows whose text has no passage of these pieces."""
    shared = candidates.sparkSession.sparkContext.broadcast([tuple(r) for r in rows])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_earlier_stages()
        own = shared.value
        index = Index([r[3] for r in own], list(range(len(own))), cfg, [r[2] for r in own])
        for batch in slices(batches):
            keep = [not any(True for _ in index.search(normal(x.as_py() or ""))) for x in batch.column(text)]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return candidates.mapInArrow(run, candidates.schema)
