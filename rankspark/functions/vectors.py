"""Vector expressions and encoders."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankspark.functions.batches import cuts_by_bytes

Encoder = Callable[[list[str]], np.ndarray]


def dot(a: Column, b: Column) -> Column:
    pairs = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def l2_normalize(v: Column) -> Column:
    """Scale to unit length; a zero vector stays as it is."""
    length = norm(v)
    return F.when(length == 0, v.cast("array<double>")).otherwise(F.transform(v, lambda x: x.cast("double") / length))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors, 0 when one of them has no length."""
    scale = norm(a) * norm(b)
    return F.when(scale > 0, dot(a, b) / scale).otherwise(F.lit(0.0))


def unit_rows(m: np.ndarray) -> np.ndarray:
    """Rows of a matrix scaled to unit length; zero rows stay zero."""
    m = np.asarray(m, dtype=np.float64)
    length = np.sqrt(np.einsum("ij,ij->i", m, m))
    length[length == 0] = 1.0
    return m / length[:, None]


_TOKEN = re.compile(r"[^\W_]+")


def model_name(make_encoder: Callable[[], Encoder]) -> str:
    """The name an encoder gives itself, or that of its class."""
    encoder = make_encoder()
    return getattr(encoder, "name", None) or type(encoder).__name__


def encode_whole(encoder: Encoder, texts: list[str]) -> np.ndarray:
    """Vectors of whole texts.

    An encoder with a limited input names it as ``max_chars``. Longer texts are then cut into
    pieces of that length, all of them are encoded, and their vectors are added up with
    their lengths as weights.
    """
    most = getattr(encoder, "max_chars", None)
    if not most or all(len(t) <= most for t in texts):
        return np.asarray(encoder(texts), dtype=np.float64)
    pieces = [[t[at : at + most] for at in range(0, max(1, len(t)), most)] for t in texts]
    rows = np.asarray(encoder([p for few in pieces for p in few]), dtype=np.float64)
    weight = np.array([max(1, len(p)) for few in pieces for p in few], dtype=np.float64)
    first = np.cumsum([0, *[len(few) for few in pieces[:-1]]])
    return np.add.reduceat(rows * weight[:, None], first, axis=0) / np.add.reduceat(weight, first)[:, None]


class HashedTokens:
    """Built-in encoder: counts of hashed tokens over the whole text.

    Needs no model and gives the same vector on every machine. Any other callable
    from a list of texts to a matrix can take its place.
    """

    def __init__(self, dim: int = 384, memo: int = 100_000) -> None:
        self.dim = dim
        self.memo = memo
        self.name = f"hashed-tokens-{dim}"
        self._buckets: dict[str, int] = {}

    def bucket(self, token: str) -> int:
        found = self._buckets.get(token)
        if found is None:
            found = int(hashlib.sha256(token.encode("utf-8")).hexdigest()[:16], 16) % self.dim
            if len(self._buckets) < self.memo:
                self._buckets[token] = found
        return found

    def __call__(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim), dtype=np.float32)
        for row, text in enumerate(texts):
            hits = [self.bucket(t) for t in _TOKEN.findall(text.lower())]
            if hits:
                out[row] = np.bincount(hits, minlength=self.dim)
        return out


def encode(
    df: DataFrame,
    text: str,
    make_encoder: Callable[[], Encoder],
    out: str = "embedding",
    normalize: bool = True,
    batch: int = 512,
    bytes_per_batch: int = 2 << 20,
) -> DataFrame:
    """Add a vector column. The encoder is made once per task and called with batches of texts, bounded in rows and bytes."""

    @F.arrow_udf("array<float>")
    def vectors(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = make_encoder()
        for part in parts:
            rows, width = [np.empty(0, dtype=np.float32)], [np.empty(0, dtype=np.int64)]
            for first, length in cuts_by_bytes(part, bytes_per_batch):
                for at in range(first, first + length, batch):
                    texts = pc.fill_null(part.slice(at, min(batch, first + length - at)), "").to_pylist()
                    m = encode_whole(encoder, texts)
                    m = (unit_rows(m) if normalize else m).astype(np.float32)
                    rows.append(m.ravel())
                    width.append(np.full(len(m), m.shape[1]))
            offsets = np.cumsum(np.append(0, np.concatenate(width)))
            yield pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(rows)))
        pa.default_memory_pool().release_unused()

    return df.withColumn(out, vectors(F.col(text)))
