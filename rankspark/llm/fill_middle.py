"""Candidate texts rearranged for training on the middle between a given beginning and end.

A text is cut at two of the boundaries between its lines. The boundaries are a compressed set
of code-point offsets, in containers by their upper bits: a sorted array where few of a container's
offsets are set, a bitmap where many are, runs where they follow each other. Cumulative
cardinalities over the containers lead to the one with the k-th boundary by binary search, and a
select within it gives the offset. The hash of the candidate's id chooses k, and the form.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankspark.llm.common import byte_strings, pick

PLAIN, PSM, SPM = "plain", "psm", "spm"


@dataclass(frozen=True)
class FillConfig:
    """``fill_percent`` of the texts are rearranged, ``suffix_first_percent`` of those with the end before the beginning."""

    prefix_mark: str = "<P>"
    suffix_mark: str = "<S>"
    middle_mark: str = "<M>"
    seed: int = 7
    fill_percent: int = 100
    suffix_first_percent: int = 50
    bytes_per_batch: int = 8 << 20


# Containers: each holds offsets below 2**16 and finds the k-th of them

_BITS = 16
_SPAN = 1 << _BITS


class ArrayContainer:
    """Sorted offsets of 16 bits."""

    def __init__(self, low: np.ndarray) -> None:
        self.low = low.astype(np.uint16)

    @staticmethod
    def bytes_for(low: np.ndarray) -> int:
        return 2 * len(low)

    def select(self, k: int) -> int:
        return int(self.low[k])


class BitmapContainer:
    """One bit per offset, with the number of bits set before each word."""

    def __init__(self, low: np.ndarray) -> None:
        bits = np.zeros(_SPAN, dtype=bool)
        bits[low] = True
        self.words = np.packbits(bits, bitorder="little").view("<u8")
        counts = np.bitwise_count(self.words)
        self.before = np.cumsum(counts) - counts

    @staticmethod
    def bytes_for(low: np.ndarray) -> int:
        return _SPAN // 8

    def select(self, k: int) -> int:
        at = int(np.searchsorted(self.before, k, side="right")) - 1
        word = int(self.words[at])
        for _ in range(k - int(self.before[at])):
            word &= word - 1  # clears the lowest bit
        return 64 * at + (word & -word).bit_length() - 1


class RunContainer:
    """First offsets and lengths of runs of consecutive offsets, with the number of offsets before each run."""

    def __init__(self, low: np.ndarray) -> None:
        first = np.flatnonzero(np.diff(low, prepend=-2) != 1)
        self.first = low[first]
        self.before = first

    @staticmethod
    def bytes_for(low: np.ndarray) -> int:
        return 2 + 4 * int(np.count_nonzero(np.diff(low, prepend=-2) != 1))

    def select(self, k: int) -> int:
        at = int(np.searchsorted(self.before, k, side="right")) - 1
        return int(self.first[at]) + k - int(self.before[at])


class Boundaries:
    """A set of offsets that answers which is the k-th."""

    def __init__(self, offsets: np.ndarray) -> None:
        """``offsets`` are ascending and distinct."""
        offsets = np.asarray(offsets, dtype=np.int64)
        high = offsets >> _BITS
        first = np.flatnonzero(np.diff(high, prepend=-1))
        self.high = high[first]
        self.containers = [self._smallest(low) for low in np.split(offsets & (_SPAN - 1), first[1:])] if len(offsets) else []
        self.before = first  # cumulative cardinalities
        self.n = len(offsets)

    @staticmethod
    def _smallest(low: np.ndarray) -> ArrayContainer | BitmapContainer | RunContainer:
        return min((ArrayContainer, BitmapContainer, RunContainer), key=lambda kind: kind.bytes_for(low))(low)

    def select(self, k: int) -> int:
        if not 0 <= k < self.n:
            raise IndexError(k)
        at = int(np.searchsorted(self.before, k, side="right")) - 1
        return (int(self.high[at]) << _BITS) + self.containers[at].select(k - int(self.before[at]))


def line_boundaries(text: str) -> Boundaries:
    """Offsets at which a line of the text may end or begin: 0, after every line feed, and the end."""
    points = np.frombuffer(text.encode("utf-32-le"), dtype="<u4")
    ends = np.flatnonzero(points == 10) + 1
    last = [len(points)] if len(points) and (not len(ends) or ends[-1] != len(points)) else []
    return Boundaries(np.concatenate([[0], ends, last]).astype(np.int64))


# Forms


def arranged(text: str, key: str, cfg: FillConfig) -> tuple[int, str, int | None, int | None, str]:
    """Number of lines, form, code points of beginning and middle, and the rearranged text."""
    cuts = line_boundaries(text)
    n = cuts.n - 1
    digest = hashlib.sha256(f"{cfg.seed}:{key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * i : 8 * i + 8], 16) for i in range(4))
    marked = any(m in text for m in (cfg.prefix_mark, cfg.suffix_mark, cfg.middle_mark))
    if not text or marked or h3 % 100 >= cfg.fill_percent:
        return n, PLAIN, None, None, text
    first, last = (cuts.select(k) for k in sorted((h1 % (n + 1), h2 % (n + 1))))
    prefix, middle, suffix = text[:first], text[first:last], text[last:]
    if h4 % 100 < cfg.suffix_first_percent:
        made = f"{cfg.suffix_mark}{suffix}{cfg.prefix_mark}{prefix}{cfg.middle_mark}{middle}"
        return n, SPM, first, last - first, made
    return n, PSM, first, last - first, f"{cfg.prefix_mark}{prefix}{cfg.suffix_mark}{suffix}{cfg.middle_mark}{middle}"


def restored(output: Column | str, form: Column | str, cfg: FillConfig = FillConfig()) -> Column:
    """The exact text from a rearranged one and its form, as a Column expression.

    Rearranged texts held no mark before, so the first one of each kind is where a part begins.
    """
    output, form = (F.col(c) if isinstance(c, str) else c for c in (output, form))

    def cut(mark: str) -> Column:
        return F.locate(mark, output)

    def part(after: str, until: str | None) -> Column:
        start = cut(after) + len(after)
        stop = cut(until) if until else F.length(output) + 1
        return F.substring(output, start, stop - start)

    p, s, m = cfg.prefix_mark, cfg.suffix_mark, cfg.middle_mark
    psm = F.concat(part(p, s), part(m, None), part(s, m))
    spm = F.concat(part(p, m), part(m, None), part(s, p))
    return F.when(form == PSM, psm).when(form == SPM, spm).otherwise(output)


def fill_in_middle(
    candidates: DataFrame,
    cfg: FillConfig = FillConfig(),
    candidate_id: str = "candidate_id",
    text: str = "text",
) -> DataFrame:
    """``candidate_id, n_lines, form, prefix_chars, middle_chars, output``: each text cut at two line ends.

    With the form ``psm`` the beginning comes first, then the end, then the middle; with ``spm`` the
    end comes first. A text that is empty, holds one of the marks, or is not among the
    ``fill_percent`` stays as it is (``plain``, without numbers of characters). Lines keep their
    line feeds; a text of n lines has n + 1 places to cut. The id alone decides places and form, so
    repeated ids with different texts get their places by the same hash, and rows that are
    equal in both come out equal; a null id counts as an empty one. Null texts are empty. Very
    long texts are cut as a whole. An empty table gives no rows. Other columns are not
    read, so their names cannot clash. Every row is worked on by itself: nothing is shuffled.
    """
    texts = pick(candidates, candidate_id=candidate_id, text=text)
    keyed = texts.select("candidate_id", "text", F.coalesce(F.col("candidate_id").cast("string"), F.lit("")).alias("key"))
    kind = texts.schema["candidate_id"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields = [("n_lines", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.string())]
        for batch in batches:
            ids, rows, held, first = batch.column("candidate_id"), [], 0, 0

            def few(until: int) -> pa.RecordBatch:
                columns = [pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), fields, strict=True)]
                return pa.RecordBatch.from_arrays([ids.slice(first, until - first), *columns], names=["candidate_id", *[n for n, _ in fields]])

            keys = batch.column("key").to_pylist()
            for at, (key, raw) in enumerate(zip(keys, byte_strings(batch.column("text")), strict=True)):
                rows.append(arranged((raw or b"").decode(), key, cfg))
                held += len(raw or b"")
                if held >= cfg.bytes_per_batch:
                    yield few(at + 1)
                    rows, held, first = [], 0, at + 1
            if rows:
                yield few(batch.num_rows)

    return keyed.mapInArrow(
        run, f"candidate_id {kind}, n_lines bigint, form string, prefix_chars bigint, middle_chars bigint, output string"
    )
