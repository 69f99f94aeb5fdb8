"""Arrow batches of bounded size."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def cuts_by_bytes(texts: pa.Array, most_bytes: int) -> Iterator[tuple[int, int]]:
    """``(at, length)`` of runs of texts with about ``most_bytes`` bytes, one text at least."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(texts):
        before = int(ends[at - 1]) if at else 0
        until = max(at + 1, int(np.searchsorted(ends, before + most_bytes, side="right")))
        yield at, until - at
        at = until


def by_bytes(batches: Iterable[pa.RecordBatch], text: str, most_bytes: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches by the bytes of a text column; unused memory is handed back at the end."""
    for batch in batches:
        for at, length in cuts_by_bytes(batch.column(text), most_bytes):
            yield batch.slice(at, length)
    pa.default_memory_pool().release_unused()
