"""Toxicity of candidate texts by multiple-instance learning.

A text is a bag of sentences. A sentence is toxic with a probability that a logistic model
gives from its words and their beginnings; the text is toxic unless none of its sentences
is (noisy-or). Only labels of whole texts are known in training: the gradient goes through
the noisy-or, so the model finds out which sentences are to blame, and names them later.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankspark.llm.common import Memo, first_rows, forget_earlier_stages, pick, slices
from rankspark.session import cut

_SENTENCE = re.compile(r"[^.!?\n]+")
_WORD = re.compile(r"\w+")


@dataclass(frozen=True)
class ToxicityConfig:
    """``texts_per_label`` and ``train_bytes`` bound the labelled sample that the classifier is fitted on."""

    texts_per_label: int = 3000
    train_bytes: int = 20_000
    prefixes: tuple[int, ...] = (3, 4, 5, 6, 7)
    least_texts: int = 3
    features: int = 20_000
    rounds: int = 150
    rate: float = 0.15
    least_signal: float = 8.0
    shrink: float = 1e-5
    threshold: float = 0.5

    def __post_init__(self) -> None:
        if min(self.texts_per_label, self.train_bytes, self.least_texts, self.features, self.rounds) <= 0:
            raise ValueError("sizes and rounds must be positive")


@dataclass(frozen=True)
class ToxicityModel:
    """Weights by feature and the score of a sentence without any of them."""

    cfg: ToxicityConfig
    weights: dict[int, float]
    bias: float


def features_of(word: str, cfg: ToxicityConfig) -> list[int]:
    """Hashes of a word and of its beginnings."""
    parts = [f"{word} ", *(word[:n] for n in cfg.prefixes if n <= len(word))]
    return [xxhash.xxh3_64_intdigest(p) >> 1 for p in parts]


def sentences(text: str) -> Iterator[tuple[int, int, set[str]]]:
    """``(start, end, distinct words)`` of all sentences that have words."""
    for m in _SENTENCE.finditer(text):
        found = set(_WORD.findall(m.group().lower()))
        if found:
            yield m.start(), m.end(), found


def _softplus(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0.0, z)


def train(bags: list[list[list[int]]], plain: np.ndarray, labels: np.ndarray, n_features: int, positive_share: float, cfg: ToxicityConfig) -> tuple[np.ndarray, float]:
    """Weights and bias for bags of sentences, by Adam on the weighted log-likelihood of the bags.

    ``bags`` holds the sentences with features, as numbers below ``n_features``, and
    ``plain`` counts the other sentences of each bag, which differ in nothing.
    """
    sample_share = float(labels.mean())
    sentences_ = [s for bag in bags for s in bag]
    bag_of = np.concatenate((np.repeat(np.arange(len(bags)), [len(b) for b in bags]), np.arange(len(bags)))).astype(np.int64)
    times = np.concatenate((np.ones(len(sentences_)), plain))
    row = np.repeat(np.arange(len(sentences_)), [len(s) for s in sentences_]).astype(np.int64)
    column = np.array([f for s in sentences_ for f in s], dtype=np.int64)

    weight_of = np.where(labels > 0, positive_share / sample_share, (1 - positive_share) / (1 - sample_share))
    w, bias = np.zeros(n_features), -5.0
    m, v = np.zeros(n_features + 1), np.zeros(n_features + 1)
    for t in range(1, cfg.rounds + 1):
        z = bias + np.bincount(row, weights=w[column], minlength=len(times))
        none = np.bincount(bag_of, weights=times * _softplus(z), minlength=len(bags))  # -log of "no sentence is toxic"
        p_sentence = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
        some = np.maximum(-np.expm1(-none), 1e-12)
        per_bag = np.where(labels > 0, -np.exp(-none) / some, 1.0) * weight_of
        g_z = times * p_sentence * per_bag[bag_of] / len(bags)
        g = np.append(np.bincount(column, weights=g_z[row], minlength=n_features) + cfg.shrink * w, g_z.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = cfg.rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
        w, bias = w - step[:-1], bias - step[-1]
    return w, float(bias)


def _telling_features(sample: DataFrame, n_texts: dict[int, int], cfg: ToxicityConfig) -> list[int]:
    """Features whose share of texts differs between the labels by more than chance, the best first."""

    def counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Memo(lambda word: features_of(word, cfg), 50_000)
        for batch in batches:
            found: tuple[Counter, Counter] = Counter(), Counter()
            for toxic, x in zip(batch.column("toxic").to_pylist(), batch.column("text"), strict=True):
                words = set().union(*(w for _, _, w in sentences(x.as_py())))
                found[toxic].update({f for word in words for f in memo[word]})
            names = list(found[0].keys() | found[1].keys())
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.int64()), *[pa.array([c[f] for f in names], pa.int64()) for c in found]], names=["f", "n0", "n1"]
            )

    per_feature = sample.mapInArrow(counted, "f bigint, n0 bigint, n1 bigint").groupBy("f").agg(
        F.sum("n0").alias("n0"), F.sum("n1").alias("n1")
    )
    total0, total1 = float(n_texts[0]), float(n_texts[1])
    share = (F.col("n0") + F.col("n1")) / (total0 + total1)
    spread = F.sqrt(share * (1 - share) * (1 / total0 + 1 / total1) + 1e-12)
    # standard deviations that rule out chance and copies of one text, fewer where there are few texts
    least = max(3.0, cfg.least_signal * min(1.0, ((total0 + total1) / 3000) ** 0.5))
    signal = F.abs(F.col("n1") / total1 - F.col("n0") / total0) / spread
    telling = per_feature.where(F.col("n0") + F.col("n1") >= cfg.least_texts).withColumn("signal", signal).where(F.col("signal") > least)
    return [r["f"] for r in telling.orderBy(F.desc("signal"), "f").limit(cfg.features).collect()]


def fit(
    candidates: DataFrame,
    labels: DataFrame,
    cfg: ToxicityConfig = ToxicityConfig(),
    candidate_id: str = "candidate_id",
    text: str = "text",
    toxic: str = "toxic",
) -> ToxicityModel:
    """Learn from candidate texts and ``labels`` with the same id and 0 or 1 in ``toxic``.

    Per label up to ``texts_per_label`` texts, by a hash of their ids, among those of at
    most ``train_bytes`` bytes. Rows without an id, a text or a label teach nothing; an id
    labelled more than once counts as toxic if one of its labels does; an id with several
    texts teaches with each within the bound. With labels of one kind only, all texts get that kind.
    """
    known = (
        pick(labels, candidate_id=candidate_id, toxic=toxic)
        .where("candidate_id is not null and toxic is not null")
        .groupBy("candidate_id")
        .agg(F.max(F.when(F.col("toxic").cast("int") > 0, 1).otherwise(0)).alias("toxic"))
    )
    texts = pick(candidates, candidate_id=candidate_id, text=text).where("text is not null")
    short = texts.where(F.octet_length("text") <= cfg.train_bytes)
    shares = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    present = known.join(short.select("candidate_id").distinct(), "candidate_id", "left_semi")
    chosen = first_rows(present, "toxic", cfg.texts_per_label)
    # an id may have many texts, so the bound is held on rows as well
    sample = first_rows(short.join(chosen, "candidate_id").select("candidate_id", "toxic", "text"), "toxic", cfg.texts_per_label)
    n_texts = {0: 0, 1: 0} | {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not n_texts[0] or not n_texts[1]:
        return ToxicityModel(cfg, {}, 30.0 if n_texts[1] else -30.0)

    telling = _telling_features(sample, n_texts, cfg)
    slot = {f: i for i, f in enumerate(telling)}

    def bags(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Memo(lambda word: [slot[f] for f in features_of(word, cfg) if f in slot])
        for batch in batches:
            rows, plain = [], []
            for x in batch.column("text"):
                every = [[f for word in sorted(found) for f in memo[word]] for _, _, found in sentences(x.as_py())]
                rows.append([s for s in every if s])
                plain.append(len(every) - len(rows[-1]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("toxic"), pa.array(plain, pa.int32()), pa.array(rows, pa.list_(pa.list_(pa.int32())))],
                names=["toxic", "plain", "bag"],
            )

    made = sample.orderBy("candidate_id", "text").mapInArrow(bags, "toxic int, plain int, bag array<array<int>>").toArrow()
    known_labels = made.column("toxic").to_numpy()
    total = sum(shares.values())
    w, bias = train(made.column("bag").to_pylist(), made.column("plain").to_numpy(), known_labels, len(telling), shares.get(1, 0) / total, cfg)
    return ToxicityModel(cfg, dict(zip(telling, w.tolist(), strict=True)), bias)


class Scorer:
    """Scores texts; word scores are remembered while a task runs."""

    def __init__(self, model: ToxicityModel) -> None:
        self.model = model
        get = model.weights.get
        self.word = Memo(lambda word: sum(get(f, 0.0) for f in features_of(word, model.cfg)))

    def __call__(self, text: str) -> tuple[float, list[tuple[int, int, float]]]:
        """Noisy-or of all sentences, and the sentences to blame as ``(start, end, score)``."""
        z, spans = [], []
        for start, end, found in sentences(text):
            z.append(self.model.bias + sum(map(self.word.__getitem__, found)))
            spans.append((start, end))
        if not z:
            return 0.0, []
        z = np.array(z)
        score = float(-np.expm1(-_softplus(z).sum()))
        p = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
        blamed = np.flatnonzero(p >= 0.5)
        if score >= self.model.cfg.threshold and not len(blamed):
            blamed = [int(np.argmax(p))]
        return min(1.0, max(0.0, score)), [(*spans[i], float(p[i])) for i in blamed]


def score(
    candidates: DataFrame, model: ToxicityModel, candidate_id: str = "candidate_id", text: str = "text"
) -> DataFrame:
    """``candidate_id, score, predicted, sentences`` for every row.

    ``score`` is between 0 and 1, ``predicted`` is 1 from the threshold on, and ``sentences``
    has start, end (in code points) and score of every sentence that is toxic by itself, or of
    the worst one where only all together are. Null and empty texts and texts without
    words have no sentence and score 0. Repeated rows give repeated results; other columns
    are not read; texts are read whole.
    """
    texts = pick(candidates, candidate_id=candidate_id, text=text)
    shared = texts.sparkSession.sparkContext.broadcast(model)  # at most cfg.features weights
    blame = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_earlier_stages()
        scorer = Scorer(shared.value)
        for batch in slices(batches):
            made = [scorer(x.as_py() or "") for x in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("candidate_id"),
                    pa.array([s for s, _ in made], pa.float64()),
                    pa.array([int(s >= scorer.model.cfg.threshold) for s, _ in made], pa.int32()),
                    pa.array([[dict(zip(("start", "end", "score"), x, strict=True)) for x in b] for _, b in made], blame),
                ],
                names=["candidate_id", "score", "predicted", "sentences"],
            )

    kind = texts.schema["candidate_id"].dataType.simpleString()
    return texts.mapInArrow(
        run, f"candidate_id {kind}, score double, predicted int, sentences array<struct<start: int, end: int, score: double>>"
    )


def without_toxic(candidates: DataFrame, model: ToxicityModel, text: str = "text") -> DataFrame:
    """The rows whose text is not predicted to be toxic, all columns as they were."""
    shared = candidates.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_earlier_stages()
        scorer = Scorer(shared.value)
        for batch in slices(batches):
            keep = [scorer(x.as_py() or "")[0] < scorer.model.cfg.threshold for x in batch.column(text)]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return candidates.mapInArrow(run, candidates.schema)
