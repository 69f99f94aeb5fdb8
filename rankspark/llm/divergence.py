"""How far the wording of one company's candidate texts is from that of the others in its industry.

Every company of an industry, and the industry as a whole, is a vector of counts over the
terms that the industry keeps. Such a vector is the row of leaves of a segment tree over
term ids. Trees are hash-consed: a node is known by its two children, so identical count
subtrees, of one tree or of different ones, are a single node. Two trees are priced by
going down both at once; a pair of nodes that comes up again is met in the memo of its
level and priced once, with the number of times it occurs.

Term ids follow falling totals, so that rare terms, which most companies lack, stand side by
side and their subtrees are shared. A tree is cut into subtrees of ``block_terms`` leaves:
a task has one such block of one industry and the subtrees of at most
``companies_per_task`` companies on either side, so neither many terms nor many companies
nor a large industry gather in one task. Prices of blocks add up.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankspark.llm.common import byte_strings, pick
from rankspark.session import cut

PAIR, TERM = "pair", "term"


@dataclass(frozen=True)
class DivergenceConfig:
    """A term is kept by an industry if ``least_texts`` of its texts hold it; ``top_terms`` are reported per company."""

    least_texts: int = 10
    top_terms: int = 10
    block_terms: int = 4096
    companies_per_task: int = 64
    terms_per_sort: int = 1 << 16
    terms_in_memory: int = 500_000


# Terms

# letters A-Z fall to a-z, bytes from 0x80 on stay, all others end a term
_FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def terms(text: bytes) -> list[bytes]:
    """Runs of ASCII letters and of all characters beyond ASCII, A-Z in lower case."""
    return text.translate(_FOLD).split()


def term_counts(texts: DataFrame, cfg: DivergenceConfig) -> DataFrame:
    """``current_industry, current_company, term, n, n_texts``: occurrences, and texts with the term.

    Tasks add up before the shuffle and hand on what they have once it exceeds
    ``terms_in_memory`` entries. A company without any term has one row whose term is null.
    """
    schema = pa.schema(
        [("current_industry", pa.string()), ("current_company", pa.string()), ("term", pa.binary()), ("n", pa.int64()), ("n_texts", pa.int64())]
    )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = defaultdict(lambda: (Counter(), Counter()))

        def flush() -> Iterator[pa.RecordBatch]:
            for (industry, company), (n, n_texts) in held.items():
                rows = len(n) + 1
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.repeat(pa.scalar(industry, pa.string()), rows),
                        pa.repeat(pa.scalar(company, pa.string()), rows),
                        pa.array([None, *n], pa.binary()),
                        pa.array([0, *n.values()], pa.int64()),
                        pa.array([0, *map(n_texts.__getitem__, n)], pa.int64()),
                    ],
                    schema=schema,
                )
            held.clear()

        size = 0
        for batch in batches:
            names = zip(batch.column("current_industry").to_pylist(), batch.column("current_company").to_pylist(), strict=True)
            for name, text in zip(names, byte_strings(batch.column("text")), strict=True):
                n, n_texts = held[name]
                found, size = terms(text or b""), size - len(n)
                n.update(found)
                n_texts.update(set(found))
                size += len(n) + 1
                if size > cfg.terms_in_memory:
                    yield from flush()
                    size = 0
        yield from flush()

    counted = texts.mapInArrow(run, "current_industry string, current_company string, term binary, n bigint, n_texts bigint")
    keys = ("current_industry", "current_company", F.col("term").cast("string").alias("term"))
    return counted.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("n_texts").alias("n_texts"))


def numbered_terms(kept: DataFrame, cfg: DivergenceConfig) -> DataFrame:
    """Kept terms in falling order of their totals, in blocks: ``block`` and the place ``slot`` within it."""
    tasks = max(1, -(-kept.count() // cfg.terms_per_sort))
    order = ("current_industry", F.desc("total"), "term")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, block, slot, industry = TaskContext.get().partitionId() << 32, -1, 0, None
        for batch in batches:
            blocks, slots = [], []
            for name in batch.column("current_industry").to_pylist():
                if name != industry or slot == cfg.block_terms:
                    industry, block, slot = name, block + 1, 0
                blocks.append(first + block)
                slots.append(slot)
                slot += 1
            columns = [*batch.columns, pa.array(blocks, pa.int64()), pa.array(slots, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "block", "slot"])

    ordered = kept.repartitionByRange(tasks, *order).sortWithinPartitions(*order)
    return ordered.mapInArrow(run, "current_industry string, term string, total bigint, block bigint, slot int")


# Prices


def shares(count: np.ndarray, size: np.ndarray | int) -> np.ndarray:
    """``1 + floor(10**9 * (count + 2) / size)``, exactly: long division by three digits at a time."""
    whole, rest = np.divmod(np.asarray(count, dtype=np.int64) + 2, size)
    for _ in range(3):
        more, rest = np.divmod(rest * 1000, size)
        whole = whole * 1000 + more
    return whole + 1


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """``floor((p - q)**2 / (p + q))`` of shares up to ``10**9 + 1``, exactly."""
    return (p - q) ** 2 // (p + q)


# Trees

_PAD = -1  # the leaf beyond the last term


@dataclass
class Forest:
    """Hash-consed segment trees over the rows of a matrix of counts.

    ``children[k]`` holds the left and right node of every distinct node of level ``k + 1``
    and ``leaves`` the counts of level 0, so a number stands for a whole subtree.
    """

    leaves: np.ndarray
    roots: np.ndarray
    children: list[np.ndarray] = field(default_factory=list)

    @classmethod
    def of(cls, counts: np.ndarray) -> Forest:
        rows, width = counts.shape
        padded = np.full((rows, 1 << max(0, width - 1).bit_length()), _PAD, dtype=np.int64)
        padded[:, :width] = counts
        leaves, nodes = np.unique(padded, return_inverse=True)
        nodes, children = nodes.reshape(padded.shape), []
        while nodes.shape[1] > 1:
            left, right = nodes[:, 0::2], nodes[:, 1::2]
            size = int(nodes.max(initial=0)) + 1
            keys, found = np.unique(left * size + right, return_inverse=True)
            children.append(np.stack(np.divmod(keys, size), axis=1))
            nodes = found.reshape(left.shape)
        return cls(leaves, nodes[:, 0], children)

    def price(self, a: int, others: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, int]:
        """Distance of tree ``a`` to each other tree, and how many pairs of leaves were priced for it."""
        pair = np.arange(len(others))
        x, y, times = np.full(len(others), self.roots[a]), self.roots[others], np.ones(len(others), dtype=np.int64)
        for nodes in reversed(self.children):
            below = np.concatenate([nodes[x], nodes[y]], axis=1)  # left, right of x; left, right of y
            x, y = below[:, [0, 1]].T.ravel(), below[:, [2, 3]].T.ravel()
            size = int(nodes.max(initial=0)) + 1
            keys, at = np.unique((np.tile(pair, 2) * size + x) * size + y, return_inverse=True)
            summed = np.zeros(len(keys), dtype=np.int64)
            np.add.at(summed, at, np.tile(times, 2))
            rest, y = np.divmod(keys, size)
            pair, x = np.divmod(rest, size)
            times = summed
        real = self.leaves[x] != _PAD
        pair, x, y, times = pair[real], x[real], y[real], times[real]
        f = distance(shares(self.leaves[x], sizes[a]), shares(self.leaves[y], sizes[others][pair]))
        total = np.zeros(len(others), dtype=np.int64)
        np.add.at(total, pair, f * times)
        return total, len(pair)

    def held(self, a: int) -> tuple[np.ndarray, np.ndarray]:
        """Slots and counts of the terms that tree ``a`` holds; subtrees without any are passed over."""
        node, slot, nothing = self.roots[a : a + 1], np.zeros(1, dtype=np.int64), self._empty()
        for level in range(len(self.children) - 1, -1, -1):
            full = ~nothing[level + 1][node]
            both = self.children[level][node[full]]
            slot = (2 * slot[full][:, None] + [0, 1]).ravel()
            node = both.ravel()
        some = self.leaves[node] > 0
        return slot[some], self.leaves[node[some]]

    def _empty(self) -> list[np.ndarray]:
        marks = [self.leaves <= 0]
        for nodes in self.children:
            marks.append(marks[-1][nodes].all(axis=1))
        return marks


# The operator

_OUT = pa.schema(
    [("current_industry", pa.string()), ("current_company", pa.string()), ("part", pa.string()), ("item", pa.string()), ("value", pa.int64())]
)


def _priced(key: tuple, table: pa.Table, top_terms: int) -> pa.Table:
    """Distances within one block: of the companies of two shares to each other, and of each to the industry."""
    industry, _, one, two = (k.as_py() for k in key)
    # a company names itself once per block and share, with the block's number of terms
    heads = table.filter(pc.less(table["slot"], 0))
    if not heads.num_rows:  # a share without companies
        return _OUT.empty_table()
    companies, share = heads["current_company"].to_pylist(), heads["share"].to_numpy()
    width, sizes = heads["n"][0].as_py(), heads["size"].to_numpy()
    at = pa.array(companies, pa.string())
    body = table.filter(pc.and_(pc.greater_equal(table["slot"], 0), pc.is_valid(table["current_company"])))
    counts = np.zeros((len(companies), width), dtype=np.int64)
    row = pc.index_in(body["current_company"], at).to_numpy()
    counts[row, body["slot"].to_numpy()] = body["n"].to_numpy()
    forest = Forest.of(counts)
    made: list[tuple] = []
    for a in range(len(companies)):
        others = np.flatnonzero(share == two) if one != two else np.arange(a + 1, len(companies))
        if share[a] != one or not len(others):
            continue
        for b, value in zip(others, forest.price(a, others, sizes)[0].tolist(), strict=True):
            made.append((companies[a], PAIR, companies[b], value))
            made.append((companies[b], PAIR, companies[a], value))
    whole = table.filter(pc.is_null(table["current_company"]))
    if whole.num_rows:
        total, size = np.zeros(width, dtype=np.int64), whole["size"][0].as_py()
        place = whole["slot"].to_numpy()
        total[place] = whole["n"].to_numpy()
        names = np.empty(width, dtype=object)
        names[place] = whole["term"].cast(pa.binary()).to_pylist()
        for a, company in enumerate(companies):
            slot, count = forest.held(a)
            p, q = shares(count, sizes[a]), shares(total[slot], size)
            f, slot = distance(p, q)[p > q], slot[p > q]
            best = sorted(zip((-f).tolist(), names[slot].tolist(), strict=True))[:top_terms]
            made.extend((company, TERM, term.decode(), -value) for value, term in best)
    columns = list(zip(*made, strict=True)) if made else [[]] * 4
    return pa.table([pa.array([industry] * len(made), pa.string()), *columns], schema=_OUT)


def company_divergence(
    candidates: DataFrame,
    cfg: DivergenceConfig = DivergenceConfig(),
    text: str = "text",
    current_industry: str = "current_industry",
    current_company: str = "current_company",
) -> DataFrame:
    """``current_industry, current_company, part, item, value, rank``: what sets companies of an industry apart.

    ``candidates`` has one row per text with the industry and the company of its candidate,
    such as ``candidate_id, text`` of a record beside two fields of its ``profile``. An industry
    keeps the terms that stand in ``least_texts`` of its texts. A term has a share of a
    company, ``p = 1 + floor(10**9 * (count + 2) / (N + 2 * V))`` with the sum ``N`` of counts over the ``V``
    kept terms, and likewise of the industry. ``value`` sums or is
    ``floor((p - q)**2 / (p + q))``, all in whole numbers:

    - part ``pair``: ``item`` is another company of the industry and ``value`` the sum over all kept terms;
    - part ``term``: ``item`` is a term that the company holds with a larger share than its industry, ``value`` its part; the best ``top_terms``.

    ``rank`` counts from 1 per company and part, by falling value, then by item in UTF-8 order.

    Null texts, industries and companies are empty ones. Companies without text or terms and
    industries without kept terms have pairs all the same (0 without kept terms). Every row is a
    text of its own, repeated ids and texts included; other columns are not read, so their names
    cannot clash. Very long texts are counted whole. An empty table gives no rows. The result
    holds each pair of companies of an industry twice: that is what is asked for.
    """
    texts = pick(candidates, text=text, current_industry=current_industry, current_company=current_company)
    texts = texts.select("text", *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("current_industry", "current_company")])
    counts = cut(term_counts(texts, cfg))
    kept = cut(
        counts.where(F.col("term").isNotNull())
        .groupBy("current_industry", "term")
        .agg(F.sum("n").alias("total"), F.sum("n_texts").alias("n_texts"))
        .where(F.col("n_texts") >= cfg.least_texts)
        .drop("n_texts")
    )
    known = cut(numbered_terms(kept, cfg))
    own = cut(
        counts.join(known, ["current_industry", "term"]).select("current_industry", "current_company", "block", "slot", "n")
    )

    vocabulary = known.groupBy("current_industry").agg(F.count(F.lit(1)).alias("n_terms"), F.sum("total").alias("n_all"))
    n_terms, n_own, n_all = (F.coalesce(c, F.lit(0)) for c in ("n_terms", "n_own", "n_all"))
    sums = own.groupBy("current_industry", "current_company").agg(F.sum("n").alias("n_own"))
    names = counts.where(F.col("term").isNull()).select("current_industry", "current_company")
    tasks_of = names.groupBy("current_industry").agg(F.ceil(F.count(F.lit(1)) / cfg.companies_per_task).cast("int").alias("shares"))
    companies = cut(
        names.join(sums, ["current_industry", "current_company"], "left")
        .join(vocabulary, "current_industry", "left")
        .join(tasks_of, "current_industry")
        .select(
            "current_industry",
            "current_company",
            (n_own + 2 * n_terms).alias("size"),
            "shares",
            F.pmod(F.xxhash64("current_company"), F.col("shares")).cast("int").alias("share"),
        )
    )
    industries = tasks_of.join(vocabulary, "current_industry", "left").select(
        "current_industry", "shares", (n_all + 2 * n_terms).alias("size")
    )
    # an industry that keeps no term has one block without terms
    found = known.groupBy("current_industry", "block").agg(F.count(F.lit(1)).alias("width"))
    blocks = industries.join(found, "current_industry", "left").select(
        "current_industry", F.coalesce("block", F.lit(-1).cast("bigint")).alias("block"), F.coalesce("width", F.lit(0)).cast("bigint").alias("width")
    )

    null = lambda kind: F.lit(None).cast(kind)
    every = F.sequence(F.lit(0), F.col("shares") - 1)
    met = F.transform(every, lambda x: F.struct(F.least("share", x).alias("one"), F.greatest("share", x).alias("two")))

    def rows(df: DataFrame, tasks: Column, company: Column, slot: Column, n: Column, share: Column, term: Column) -> DataFrame:
        named = df.withColumn("task", F.explode(tasks))
        return named.select(
            "current_industry", "block", "task.one", "task.two", company.alias("current_company"),
            slot.cast("int").alias("slot"), n.alias("n"), "size", share.alias("share"), term.alias("term"),
        )

    company, share = F.col("current_company"), F.col("share")
    heads = rows(companies.join(blocks, "current_industry"), met, company, F.lit(-1), F.col("width"), share, null("string"))
    bodies = rows(own.join(companies, ["current_industry", "current_company"]), met, company, F.col("slot"), F.col("n"), share, null("string"))
    wholes = rows(
        known.join(industries, "current_industry"),
        F.transform(every, lambda x: F.struct(x.alias("one"), x.alias("two"))),
        null("string"), F.col("slot"), F.col("total"), null("int"), F.col("term"),
    )

    top = cfg.top_terms
    priced = (
        heads.unionByName(bodies)
        .unionByName(wholes)
        .groupBy("current_industry", "block", "one", "two")
        .applyInArrow(
            lambda key, table: _priced(key, table, top),
            "current_industry string, current_company string, part string, item string, value bigint",
        )
    )
    place = ("current_industry", "current_company", "part")
    # a term stands in one block only, a pair of companies in all of them
    summed = priced.groupBy(*place, "item").agg(F.sum("value").alias("value"))
    ranked = summed.withColumn("rank", F.row_number().over(Window.partitionBy(*place).orderBy(F.desc("value"), "item")))
    return ranked.where((F.col("part") == PAIR) | (F.col("rank") <= cfg.top_terms))
