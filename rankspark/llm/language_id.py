"""Language of candidate texts by nearest centroid.

A text is a TF-IDF vector of hashed character n-grams of unit length. Each language has
several centroids, found by clustering its labelled texts by cosine; a text gets the
language of the nearest centroid, and is rejected when even that is further away than
nearly all labelled texts of that language are from theirs.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankspark.llm.common import crc_remainder, first_rows, forget_earlier_stages, pick, slices
from rankspark.session import cut

UNDETERMINED = "und"
_NOT_LETTERS = re.compile(r"[\W\d_]+")


@dataclass(frozen=True)
class LanguageConfig:
    """``texts_per_language`` bounds the labelled sample; a text beyond ``reject_share`` of the spread of its language goes."""

    sizes: tuple[int, ...] = (1, 2, 3)
    dims: int = 8192
    clusters: int = 4
    texts_per_language: int = 400
    rounds: int = 12
    reject_quantile: float = 0.01
    reject_share: float = 0.5

    def __post_init__(self) -> None:
        if min(self.dims, self.clusters, self.texts_per_language, self.rounds, *self.sizes) <= 0:
            raise ValueError("sizes and counts must be positive")


@dataclass(frozen=True)
class LanguageModel:
    """Centroids (rows of unit length, IDF weights, the language of each and the smallest cosine it accepts)."""

    cfg: LanguageConfig
    idf: np.ndarray
    centroids: np.ndarray
    languages: list[str]
    accepts: np.ndarray


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def counts(text: str, cfg: LanguageConfig, slice_: int = 1 << 20) -> np.ndarray:
    """Counts of hashed n-grams over the words of the whole text, in lower case; all but letters counts as space.

    Long texts are worked through in slices that overlap by the longest n-gram, so memory stays bounded.
    """
    points = np.frombuffer(_NOT_LETTERS.sub(" ", f" {text.lower()} ").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    total = np.zeros(cfg.dims, dtype=np.float64)
    for n in cfg.sizes:
        for at in range(0, len(points) - n + 1, slice_):
            part = points[at : at + slice_ + n - 1].astype(np.uint64)
            h = np.full(len(part) - n + 1, n, dtype=np.uint64)
            for k in range(n):
                h = (h * np.uint64(0x100000001B3)) ^ part[k : len(part) - n + 1 + k]
            h = (h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)
            total += np.bincount((h % np.uint64(cfg.dims)).astype(np.int64), minlength=cfg.dims)
    return total


def unit(rows: np.ndarray) -> np.ndarray:
    length = np.sqrt((rows * rows).sum(axis=-1, keepdims=True))
    return np.divide(rows, length, out=np.zeros_like(rows), where=length > 0)


def cluster(rows: np.ndarray, k: int, rounds: int) -> np.ndarray:
    """Centroids by cosine: farthest-first start from the mean, then a fixed number of rounds."""
    chosen = [int(np.argmax(rows @ unit(rows.mean(axis=0))))]
    nearest = rows @ rows[chosen[0]]
    while len(chosen) < min(k, len(rows)):
        chosen.append(int(np.argmin(nearest)))
        nearest = np.maximum(nearest, rows @ rows[chosen[-1]])
    centroids = rows[chosen]
    for _ in range(rounds):
        owner = np.argmax(rows @ centroids.T, axis=1)
        centroids = np.stack([unit(rows[owner == j].mean(axis=0)) if (owner == j).any() else c for j, c in enumerate(centroids)])
    return centroids


def _sample(labelled: DataFrame, cfg: LanguageConfig) -> DataFrame:
    """Up to ``texts_per_language`` rows of each language, chosen by a hash of the id.

    Ids are chosen without their texts; the bound is then held on rows, as an id may have many.
    """
    ids = labelled.where("candidate_id is not null and lang is not null and text is not null").select("candidate_id", "lang")
    chosen = first_rows(ids, "lang", cfg.texts_per_language).select(F.col("candidate_id").alias("chosen_id"))
    rows = labelled.join(chosen, F.col("candidate_id") == F.col("chosen_id"), "left_semi").where("lang is not null and text is not null")
    return first_rows(rows, "lang", cfg.texts_per_language)


def fit(
    labelled: DataFrame,
    cfg: LanguageConfig = LanguageConfig(),
    candidate_id: str = "candidate_id",
    text: str = "text",
    lang: str = "lang",
) -> LanguageModel:
    """Learn from labelled candidate texts. Rows without an id, a text, a letter or a label teach nothing.

    Of rows that repeat an id each counts for the bound on rows per language, and teaches within it.
    """
    rows = _sample(pick(labelled, candidate_id=candidate_id, text=text, lang=lang), cfg)

    def vectors(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [(a.as_py(), t.as_py()) for a, t in zip(batch.column("lang"), batch.column("text"), strict=True)]
            kept = [(a, counts(t, cfg).astype(np.float32).tobytes()) for a, t in kept if has_letter(t)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([a for a, _ in kept], pa.string()), pa.array([v for _, v in kept], pa.binary())],
                names=["lang", "counts"],
            )

    counted = cut(rows.select(F.col("lang").cast("string").alias("lang"), "text").mapInArrow(vectors, "lang string, counts binary"))

    def document_frequency(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, df = 0, np.zeros(cfg.dims, dtype=np.int64)
        for batch in batches:
            for v in batch.column("counts"):
                df += np.frombuffer(v.as_py(), dtype=np.float32) > 0
                n += 1
        if n:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(-1, cfg.dims)), pa.array(np.append(n, df))], names=["slot", "n"]
            )

    summed = counted.mapInArrow(document_frequency, "slot bigint, n bigint").groupBy("slot").agg(F.sum("n").alias("n"))
    slots = {r["slot"]: r["n"] for r in summed.collect()}  # one number per dimension
    n = slots.get(-1, 0)
    idf = np.log((1 + n) / (1 + np.array([slots.get(j, 0) for j in range(cfg.dims)], dtype=np.float64))) + 1

    def per_language(table: pa.Table) -> pa.Table:
        m = np.stack([np.frombuffer(v.as_py(), dtype=np.float32) for v in table.column("counts")])
        # equal order of rows on every run, whatever order they arrive in
        m = m[np.lexsort(m[:, :16].T)].astype(np.float64)
        m = weigh(m, idf)
        centroids = cluster(m, cfg.clusters, cfg.rounds)
        near = np.quantile((m @ centroids.T).max(axis=1), cfg.reject_quantile) * cfg.reject_share
        name = table.column("lang")[0].as_py()
        k = len(centroids)
        return pa.table({"lang": [name] * k, "accepts": [float(near)] * k, "centroid": [c.tobytes() for c in centroids]})

    made = counted.groupBy("lang").applyInArrow(per_language, "lang string, accepts double, centroid binary").collect()
    made = sorted(made, key=lambda r: (r["lang"], bytes(r["centroid"])))  # clusters x languages rows
    centroids = np.array([np.frombuffer(r["centroid"], dtype=np.float64) for r in made]).reshape(len(made), cfg.dims)
    return LanguageModel(cfg, idf, centroids, [r["lang"] for r in made], np.array([r["accepts"] for r in made]))


def weigh(counted: np.ndarray, idf: np.ndarray) -> np.ndarray:
    return unit(np.log1p(counted) * idf)


def predict(
    candidates: DataFrame, model: LanguageModel, candidate_id: str = "candidate_id", text: str = "text"
) -> DataFrame:
    """``candidate_id, lang_pred, score, rejected`` for every row.

    ``lang_pred`` is a learned language and ``score`` the cosine (0 to 1) to its nearest
    centroid; the first language in order wins ties. A null text or one without a letter
    gets ``und`` with score 0 and is rejected, as is every text if nothing was learned.
    Other texts keep their nearest language, and ``rejected`` tells whether it is too far away.
    Repeated rows give repeated results; other columns are not read.
    """
    texts = pick(candidates, candidate_id=candidate_id, text=text)
    spark = texts.sparkSession
    shared = spark.sparkContext.broadcast(model)  # clusters x languages x dims numbers

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_earlier_stages()
        m = shared.value
        for batch in slices(batches):
            names, scores, rejected = [], [], []
            for x in batch.column("text"):
                t = x.as_py()
                if t is None or not m.languages or not has_letter(t):
                    names.append(UNDETERMINED)
                    scores.append(0.0)
                    rejected.append(True)
                    continue
                near = m.centroids @ weigh(counts(t, m.cfg), m.idf)
                best = int(np.argmax(near))
                names.append(m.languages[best])
                scores.append(float(min(1.0, max(0.0, near[best]))))
                rejected.append(bool(near[best] < m.accepts[best]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("candidate_id"), pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())],
                names=["candidate_id", "lang_pred", "score", "rejected"],
            )

    kind = texts.schema["candidate_id"].dataType.simpleString()
    return texts.mapInArrow(run, f"candidate_id {kind}, lang_pred string, score double, rejected boolean")


def with_language(candidates: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """The rows whose language the model accepts, all columns as they were."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_earlier_stages()
        m = shared.value
        for batch in slices(batches):
            keep = []
            for x in batch.column(text):
                t = x.as_py()
                if t is None or not m.languages or not has_letter(t):
                    keep.append(False)
                    continue
                near = m.centroids @ weigh(counts(t, m.cfg), m.idf)
                best = int(np.argmax(near))
                keep.append(bool(near[best] >= m.accepts[best]))
            yield batch.filter(pa.array(keep, pa.bool_()))

    shared = candidates.sparkSession.sparkContext.broadcast(model)
    return candidates.mapInArrow(run, candidates.schema)


def learnable(id_column: Column, parts: int, held: int) -> Column:
    """Rows that may teach: those whose id's checksum leaves another remainder than the held-out one."""
    return F.coalesce(crc_remainder(id_column, parts) != held, F.lit(False))
