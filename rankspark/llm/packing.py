"""Candidate texts as token ids, packed into windows of equal length with next to no padding.

Sum-of-squares online packing. ``levels[h]`` is the number of open windows that hold ``h`` tokens.
Each text, as it comes, goes to the level that leaves the smallest sum of squares of these
counts, an unopened window (level 0) being one of the choices: levels then stay evenly
and thinly filled, so that a later text finds a window that it fills exactly. A text
longer than a window fills whole windows first; its rest is placed.

Every task packs its own texts, so nothing is shuffled and a lost task is repeated alone. The
windows a task still has open at its end are completed from each other: texts of the emptiest
are cut to fill the fullest. What is left, less than one window, is cut into sequences whose
lengths are powers of two, which need no padding.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from rankspark.llm.common import many_small_objects, pick, slices_by_bytes
from rankspark.llm.token_output import tokenizer


@dataclass(frozen=True)
class PackConfig:
    """``open_windows`` bounds the memory of a task: beyond it, open windows are completed from each other."""

    window_tokens: int = 4096
    end_id: int = 2
    open_windows: int = 4096
    bytes_per_batch: int = 8 << 20


class Piece(NamedTuple):
    """``length`` tokens of a candidate's text from ``start`` on; ``ids`` are those of the whole text."""

    candidate_id: object
    ids: memoryview
    start: int
    length: int

    def split(self, length: int) -> tuple[Piece, Piece]:
        return self._replace(length=length), self._replace(start=self.start + length, length=self.length - length)


class Levels:
    """The level array: how many open windows hold how many tokens, and which."""

    def __init__(self, size: int) -> None:
        self.size = size
        self.clear()

    def clear(self) -> None:
        self.count = np.zeros(self.size + 1, dtype=np.int64)
        self.windows: list[list[list[Piece]]] = [[] for _ in range(self.size)]
        self.open = 0

    def best(self, length: int) -> int:
        """The level (0: a new window) whose use for ``length`` more tokens leaves the least sum of squares.

        A window that moves from level h to h + length changes the sum by 2 (N[h + length] - N[h]) + 2, and by
        1 - 2 N[h] if that fills it; a new one by 2 N[length] + 1. Of equal choices the fullest window wins.
        """
        here = self.count[1 : self.size - length + 1]
        if not len(here):
            return 0
        change = 2 * (self.count[length + 1 :] - here) + 2
        change[-1] -= 1
        change[here == 0] = np.iinfo(np.int64).max
        at = len(change) - 1 - int(np.argmin(change[::-1]))
        return at + 1 if change[at] <= 2 * self.count[length] + 1 else 0

    def put(self, piece: Piece) -> list[Piece] | None:
        """Place a piece of at most one window; the window if that fills it."""
        level = self.best(piece.length)
        window = [piece]
        if level:
            window = self.windows[level].pop()
            window.append(piece)
            self.count[level] -= 1
            self.open -= 1
        level += piece.length
        if level == self.size:
            return window
        self.windows[level].append(window)
        self.count[level] += 1
        self.open += 1
        return None

    def settle(self) -> Iterator[list[Piece]]:
        """Close all open windows without padding: full ones, and sequences of powers of two.

        A window at a power of two is left as it is.
        """
        held = [(level, w) for level in range(self.size - 1, 0, -1) for w in self.windows[level]]
        self.clear()
        yield from (w for level, w in held if level & (level - 1) == 0)
        rest = [(level, w) for level, w in held if level & (level - 1)]
        first, last = 0, len(rest) - 1
        while first < last:
            level, window = rest[first]
            missing = self.size - level
            while missing and first < last:
                _, giver = rest[last]
                piece = giver.pop()
                if piece.length > missing:
                    stays, piece = piece.split(piece.length - missing)
                    giver.append(stays)
                window.append(piece)
                missing -= piece.length
                if not giver:
                    last -= 1
            if not missing:
                yield window
                first += 1
            else:
                rest[first] = (self.size - missing, window)
        if first == last:
            yield from powers_of_two(rest[first][1])


def powers_of_two(pieces: list[Piece]) -> Iterator[list[Piece]]:
    """The pieces in sequences whose lengths are the binary digits of their sum, the longest first."""
    left = list(reversed(pieces))
    total = sum(p.length for p in pieces)
    for bit in range(total.bit_length() - 1, -1, -1):
        if not total >> bit & 1:
            continue
        missing, sequence = 1 << bit, []
        while missing:
            piece = left.pop()
            if piece.length > missing:
                piece, rest = piece.split(missing)
                left.append(rest)
            sequence.append(piece)
            missing -= piece.length
        yield sequence


@dataclass
class Packer:
    """Sequences of a stream of texts, each given out as soon as it is complete."""

    cfg: PackConfig
    levels: Levels = field(init=False)

    def __post_init__(self) -> None:
        if self.cfg.window_tokens < 1:
            raise ValueError("window_tokens must be positive")
        self.levels = Levels(self.cfg.window_tokens)

    def add(self, candidate_id: object, ids: bytes) -> Iterator[list[Piece]]:
        size, rest = self.cfg.window_tokens, Piece(candidate_id, memoryview(ids), 0, len(ids) // 4)
        while rest.length >= size:
            full, rest = rest.split(size)
            yield [full]
        if rest.length:
            done = self.levels.put(rest)
            if done:
                yield done
        if self.levels.open > self.cfg.open_windows:
            yield from self.levels.settle()

    def end(self) -> Iterator[list[Piece]]:
        yield from self.levels.settle()


def pack_candidates(
    candidates: DataFrame,
    definition: str,
    cfg: PackConfig = PackConfig(),
    candidate_id: str = "candidate_id",
    text: str = "text",
) -> DataFrame:
    """``candidate_id, start, length, ids, candidate_tokens, sequence_id, offset``: one row per piece of a text.

    ``ids`` are the token ids of the piece (little-endian unsigned 32-bit numbers), ``start`` its place
    among the ``candidate_tokens`` ids of its text, end id included, and ``offset`` its place in its
    sequence. A sequence holds ``window_tokens`` ids or, at the end of a task, a power of two of
    them; pieces follow each other without gaps, and every id lies in exactly one piece. Only texts
    longer than a window, and those in windows still open at the end of a task, are cut.

    ``definition`` is the content of a tokenizer file. Null and empty texts have the end id
    alone. Rows with repeated or null ids are texts of their own; very long texts are packed
    whole. An empty table gives no rows. Other columns are not read, so their names cannot clash.
    Numbers of sequences are unique, not consecutive. Which texts share a sequence depends on the
    splits of the input; store the result before it is read twice.
    """
    texts = pick(candidates, candidate_id=candidate_id, text=text)
    shared = texts.sparkSession.sparkContext.broadcast(definition)
    kind = texts.schema["candidate_id"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, packer, end = tokenizer(shared.value), Packer(cfg), np.asarray([cfg.end_id], dtype="<u4")
        sequence, schema = TaskContext.get().partitionId() << 40, None
        rows: list[tuple] = []
        held = 0

        def batch_of() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

        def sequences() -> Iterator[list[Piece]]:
            nonlocal schema
            for batch in batches:
                if schema is None:
                    schema = pa.schema(
                        [("candidate_id", batch.schema.field("candidate_id").type), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary())]
                        + [(n, pa.int64()) for n in ("candidate_tokens", "sequence_id", "offset")]
                    )
                for few in slices_by_bytes(batch, "text", cfg.bytes_per_batch):
                    with many_small_objects():
                        found = encode(few.column("text"))
                    for name, ids in zip(few.column("candidate_id").to_pylist(), found, strict=True):
                        yield from packer.add(name, np.append(ids, end).astype("<u4").tobytes())
            yield from packer.end()

        for pieces in sequences():
            offset = 0
            for p in pieces:
                ids = bytes(p.ids[4 * p.start : 4 * (p.start + p.length)])
                rows.append((p.candidate_id, p.start, p.length, ids, len(p.ids) // 4, sequence, offset))
                offset += p.length
                held += len(ids)
            sequence += 1
            if held >= cfg.bytes_per_batch or len(rows) >= 10_000:
                yield batch_of()
                rows, held = [], 0
        if rows:
            yield batch_of()

    return texts.mapInArrow(
        run,
        f"candidate_id {kind}, start bigint, length bigint, ids binary, candidate_tokens bigint, sequence_id bigint, offset bigint",
    )
