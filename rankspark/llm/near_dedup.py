"""Near-duplicate candidate texts by min-max hashing, with every link confirmed on full sets.

A text is its set of distinct word shingles. Each permutation keeps both its smallest and
its largest value, so one pass of hashing fills two components of the signature. Bands of
components name buckets; texts that share one are compared on their full sets, and linked
when the similarity reaches the limit.

Exact copies are one vertex from the start. Within a bucket all members are compared with
one of them, the hub, and not with each other. Members that do not end up in the hub's
component are then compared with all others of their bucket, in blocks whose result is a
forest of links. So a large bucket of mutual copies
costs one comparison per member, no link is lost, and no pairs are written.

Sets of sizes that are too far apart cannot reach the limit, whatever they share, so such
pairs are left out before any set travels; buckets with the same members are one.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankspark.llm.common import batches_of, byte_strings, connected, hash_memo, is_empty, mix, pick, shingles, slices, word_hashes
from rankspark.session import cut


@dataclass(frozen=True)
class NearDedupConfig:
    """``bands`` x ``band_rows`` components come from half as many permutations.

    With these values a pair of similarity 0.8 shares no band once in 300,000 times.
    """

    words: int = 5
    percent: int = 80
    bands: int = 32
    band_rows: int = 5
    seed: int = 11
    block_shingles: int = 250_000

    def __post_init__(self) -> None:
        if not (self.words > 0 and 0 < self.percent <= 100 and self.bands > 0 and self.band_rows > 0):
            raise ValueError("words, percent, bands and band_rows must be positive, percent at most 100")


class MinMax:
    """Signatures: the smallest and the largest value of a set under every permutation."""

    def __init__(self, cfg: NearDedupConfig) -> None:
        self.cfg = cfg
        n = -(-cfg.bands * cfg.band_rows // 2)
        seeds = mix(np.arange(1, 2 * n + 1, dtype=np.uint64) + np.uint64(cfg.seed << 32))
        self.factor, self.shift = (seeds[:n] | np.uint64(1))[:, None], seeds[n:][:, None]

    def components(self, found: np.ndarray, slice_: int = 4096) -> np.ndarray:
        low = high = None
        for at in range(0, len(found), slice_):
            values = found[None, at : at + slice_] * self.factor + self.shift
            a, b = values.min(axis=1), values.max(axis=1)
            low = a if low is None else np.minimum(low, a)
            high = b if high is None else np.maximum(high, b)
        return np.stack((low, high), axis=1).ravel()

    def bands(self, found: np.ndarray) -> list[int]:
        cfg = self.cfg
        rows = self.components(found)[: cfg.bands * cfg.band_rows].reshape(cfg.bands, cfg.band_rows)
        salt = mix(np.arange(1, cfg.bands + 1, dtype=np.uint64))
        total = salt
        for k in range(cfg.band_rows):
            total = mix(total + rows[:, k])
        return total.view(np.int64).tolist()


def _digest(found: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(found.tobytes())


def signatures(texts: DataFrame, cfg: NearDedupConfig) -> DataFrame:
    """``candidate_id, n_shingles, digest, bands`` per row; a text without words has neither digest nor bands."""
    schema = pa.schema([("n_shingles", pa.int64()), ("digest", pa.binary()), ("bands", pa.list_(pa.int64()))])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, sign = hash_memo(), MinMax(cfg)
        for batch in slices(batches):
            rows = []
            for text in byte_strings(batch.column("text")):
                found = shingles(word_hashes(text or b"", memo), cfg.words)
                rows.append((len(found), _digest(found), sign.bands(found)) if len(found) else (0, None, None))
            columns = [pa.array(x, f.type) for x, f in zip(zip(*rows) if rows else [[], [], []], schema, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("candidate_id"), *columns], names=["candidate_id", *schema.names]
            )

    kind = texts.schema["candidate_id"].dataType.simpleString()
    return texts.mapInArrow(run, f"candidate_id {kind}, n_shingles bigint, digest binary, bands array<bigint>")


def _sets(texts: DataFrame, cfg: NearDedupConfig) -> DataFrame:
    """``digest, found`` per row with words: the full set of shingle hashes."""
    schema = pa.schema([("digest", pa.binary()), ("found", pa.list_(pa.int64()))])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = hash_memo()

        def rows() -> Iterator[tuple]:
            for batch in slices(batches):
                for text in byte_strings(batch.column("text")):
                    found = shingles(word_hashes(text or b"", memo), cfg.words)
                    if len(found):
                        yield _digest(found), found.view(np.int64)

        yield from batches_of(rows(), schema, 200)

    return texts.mapInArrow(run, "digest binary, found array<bigint>")


def _of_like_size(pairs: DataFrame, vertices: DataFrame, cfg: NearDedupConfig) -> DataFrame:
    """The pairs ``a, b`` whose sizes allow a link: no union is smaller than the larger set, no intersection larger than the smaller."""
    one = vertices.select(F.col("v").alias("a"), F.col("size").alias("size_a"))
    two = vertices.select(F.col("v").alias("b"), F.col("size").alias("size_b"))
    fits = 100 * F.least("size_a", "size_b") >= cfg.percent * F.greatest("size_a", "size_b")
    return pairs.join(one, "a").join(two, "b").where(fits).select("a", "b")


def _member_sets(ends: DataFrame, texts: DataFrame, vertices: DataFrame, cfg: NearDedupConfig) -> DataFrame:
    """``v, found``: full sets of the vertices ``v``, made from their whole texts."""
    needed = cut(vertices.join(ends, "v", "left_semi").select("v", "digest", F.col("candidate_id").alias("rep")))
    same = F.col("candidate_id").eqNullSafe(F.col("rep"))
    texts = texts.join(needed.select("rep").distinct(), same, "left_semi")
    return cut(_sets(texts, cfg).join(needed.select("digest", "v"), "digest").select("v", "found"))


def _confirm(pairs: DataFrame, sets: DataFrame, cfg: NearDedupConfig) -> DataFrame:
    """``a, b, linked`` for pairs of vertices, measured on the full sets of both."""
    one = sets.select(F.col("v").alias("a"), F.col("found").alias("set_a"))
    two = sets.select(F.col("v").alias("b"), F.col("found").alias("set_b"))
    both = F.size(F.array_intersect("set_a", "set_b")).cast("bigint")
    either = F.size("set_a") + F.size("set_b") - both
    measured = pairs.join(one, "a").join(two, "b").select("a", "b", both.alias("both"), either.alias("either"))
    return cut(
        measured.distinct().select(
            "a",
            "b",
            (100 * F.col("both") >= cfg.percent * F.col("either")).alias("linked"),
        )
    )


def near_duplicates(
    candidates: DataFrame, cfg: NearDedupConfig = NearDedupConfig(), candidate_id: str = "candidate_id", text: str = "text"
) -> DataFrame:
    """``candidate_id, n_shingles, component_id, kept`` for every row of ``candidates``.

    ``component_id`` is the smallest candidate id that links reach, the row's own included;
    ``kept`` marks the rows whose id it is. Ids may have any type with an order.

    Null or empty texts and texts of white space have no shingles, are linked with nothing
    and are kept. Equal texts are always linked. A row with a null id takes part as any
    other, gets the smallest id of its component and is kept only if there is none. Rows
    that repeat an id keep one result row each. An empty table gives an empty result, and
    other columns are not read.
    """
    texts = pick(candidates, candidate_id=candidate_id, text=text)
    signed = cut(signatures(texts, cfg))
    with_words = signed.where("n_shingles > 0")
    vertices = cut(
        with_words.groupBy("digest")
        .agg(F.min("candidate_id").alias("candidate_id"), F.first("n_shingles").alias("size"))
        .withColumn("v", F.monotonically_increasing_id())
    )

    rep = vertices.select("v", F.col("digest").alias("d"), F.col("candidate_id").alias("rep"))
    chosen = with_words.join(rep, (F.col("digest") == F.col("d")) & F.col("candidate_id").eqNullSafe(F.col("rep")))
    banded = chosen.select("v", F.explode("bands").alias("bucket"))
    shared = (
        banded.groupBy("bucket").agg(F.min("v").alias("hub"), F.max("v").alias("last")).where("hub <> last").drop("last")
    )
    members = cut(banded.join(shared, "bucket").distinct())
    met = members.where("v <> hub").select(F.col("hub").alias("a"), F.col("v").alias("b")).distinct()
    pairs = cut(_of_like_size(met, vertices, cfg))

    components = None
    if not is_empty(members):
        ends = pairs.select(F.explode(F.array("a", "b")).alias("v")).distinct()
        first = _confirm(pairs, _member_sets(ends, texts, vertices, cfg), cfg)
        links = first.where("linked").select("a", "b")
        components = connected(links)
        unsettled = _open_buckets(members, components, vertices, cfg)
        if not is_empty(unsettled):
            sets = _member_sets(unsettled.select("v").distinct(), texts, vertices, cfg)
            more = _late_links(unsettled, sets, cfg)
            if not is_empty(more):
                components = connected(links.unionByName(more))
    return _result(signed, vertices, components)


def _open_buckets(members: DataFrame, components: DataFrame, vertices: DataFrame, cfg: NearDedupConfig) -> DataFrame:
    """``bucket, main, v, root, size``: members of buckets that may still hold a link between components.

    ``main`` is the component of the hub. A bucket whose members are all of it is settled,
    and so is a bucket of two. A member stays if a member of another component is near it
    in size; classes of size are so wide that a link never passes over one. Of buckets
    with the same members one stays.
    """
    label = components.select("v", "root")
    hubs = components.select(F.col("v").alias("hub"), F.col("root").alias("hub_root"))
    placed = cut(
        members.join(label, "v", "left")
        .join(hubs, "hub", "left")
        .select("bucket", "v", F.coalesce("root", "v").alias("root"), F.coalesce("hub_root", "hub").alias("main"))
    )
    outside = F.max((F.col("root") != F.col("main")).cast("int"))
    many = placed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), outside.alias("open"))
    placed = placed.join(many.where("n > 2 and open = 1").select("bucket"), "bucket", "left_semi")
    width = math.log(100 / cfg.percent * 1.0001)
    size_class = F.floor(F.log("size") / width).alias("size_class")
    placed = cut(placed.join(vertices.select("v", "size"), "v").select("*", size_class))

    per_class = placed.groupBy("bucket", "size_class").agg(F.min("root").alias("low"), F.max("root").alias("high"))
    near = F.explode(F.array(*[F.col("size_class") + i for i in (-1, 0, 1)])).alias("size_class")
    live = (
        per_class.select("bucket", near, "low", "high")
        .groupBy("bucket", "size_class")
        .agg(F.min("low").alias("low"), F.max("high").alias("high"))
        .where("low <> high")
    )
    placed = cut(placed.join(live, ["bucket", "size_class"], "left_semi").drop("size_class"))
    # two independent 64-bit sums per bucket stand for its members, as digests stand for sets
    sums = [F.sum(F.xxhash64(F.lit(seed), "v").cast("decimal(20,0)")).alias(f"s{seed}") for seed in (1, 2)]
    same = placed.groupBy("bucket").agg(*sums, F.count(F.lit(1)).alias("n"))
    chosen = same.groupBy("s1", "s2", "n").agg(F.min("bucket").alias("bucket"))
    return cut(placed.join(chosen.select("bucket"), "bucket", "left_semi"))


def _links_between(left: list[dict], right: list[dict], cfg: NearDedupConfig) -> list[tuple[int, int]]:
    """Links between vertices of two blocks with different roots, as edges of a forest over the roots."""
    values = np.concatenate([r["found"] for r in right])
    owner = np.repeat(np.arange(len(right)), [len(r["found"]) for r in right])
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    v, root, size = (np.array([r[c] for r in right]) for c in ("v", "root", "size"))
    joined: dict[int, int] = {}

    def find(x: int) -> int:
        while joined.get(x, x) != x:
            x = joined[x]
        return x

    edges = []
    for x in left:
        low, high = np.searchsorted(values, x["found"], "left"), np.searchsorted(values, x["found"], "right")
        n = high - low
        at = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        both = np.bincount(owner[at], minlength=len(right))
        linked = (100 * both >= cfg.percent * (size + x["size"] - both)) & (root != x["root"])
        for i in np.flatnonzero(linked):
            a, b = find(x["root"]), find(int(root[i]))
            if a != b:
                joined[a] = b
                edges.append((x["v"], int(v[i])))
    return edges


def _late_links(unsettled: DataFrame, sets: DataFrame, cfg: NearDedupConfig) -> DataFrame:
    """``a, b``: links that join further components, found block by block within each bucket.

    Blocks have a bounded number of shingles. A bucket of one block, the usual case, is compared where it
    is gathered. In larger ones the vertices outside the main component meet all blocks of
    their bucket; what comes out of two blocks is a forest, never their pairs.
    """
    blocks = 1 + F.floor(F.sum("size") / cfg.block_shingles)
    n_blocks = unsettled.groupBy("bucket").agg(blocks.cast("bigint").alias("n_blocks"))
    filled = (
        unsettled.join(n_blocks, "bucket")
        .withColumn("block", F.pmod(F.xxhash64("v"), F.col("n_blocks")))
        .join(sets, "v")
        .withColumn("member", F.struct("v", "root", "size", "found"))
    )
    per_block = filled.groupBy("bucket", "block", "n_blocks").agg(
        F.first("main").alias("main"), F.collect_list("member").alias("every")
    )
    per_block = cut(per_block)

    def side(column: pa.Array) -> list[dict]:
        found, sizes = column.field("found"), column.field("size").to_pylist()
        # hashes that two sets share are equal bit by bit, whatever their sign
        return [
            {"v": v, "root": r, "size": n, "found": np.sort(f.values.to_numpy())}
            for v, r, n, f in zip(column.field("v").to_pylist(), column.field("root").to_pylist(), sizes, found, strict=True)
        ]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                every = side(batch.column("every")[at].values)
                if "outside" in batch.schema.names:
                    outside = side(batch.column("outside")[at].values)
                else:
                    main = batch.column("main")[at].as_py()
                    outside = [m for m in every if m["root"] != main]
                edges = _links_between(outside, every, cfg)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([a for a, _ in edges], pa.int64()), pa.array([b for _, b in edges], pa.int64())], names=["a", "b"]
                )

    whole = per_block.where("n_blocks = 1").select("main", "every").mapInArrow(run, "a bigint, b bigint")
    parts = per_block.where("n_blocks > 1")
    left = parts.select("bucket", "n_blocks", F.filter("every", lambda m: m["root"] != F.col("main")).alias("outside"))
    left = left.where(F.size("outside") > 0).select("bucket", "outside", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)).alias("block"))
    pairs = left.join(parts.select("bucket", "block", "every"), ["bucket", "block"]).select("outside", "every")
    spread = max(1, int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return cut(whole.unionByName(pairs.repartition(spread).mapInArrow(run, "a bigint, b bigint")))


def _result(signed: DataFrame, vertices: DataFrame, components: DataFrame | None) -> DataFrame:
    if components is None:
        smallest = vertices.select("digest", F.col("candidate_id").alias("component"))
    else:
        rooted = vertices.join(components, "v", "left").withColumn("root", F.coalesce("root", "v"))
        per_root = rooted.groupBy("root").agg(F.min("candidate_id").alias("component"))
        smallest = rooted.select("digest", "root").join(per_root, "root").select("digest", "component")
    joined = signed.select("candidate_id", "n_shingles", "digest").join(smallest, "digest", "left")
    component = F.when(F.col("n_shingles") == 0, F.col("candidate_id")).otherwise(F.col("component"))
    return joined.select("candidate_id", "n_shingles", component.alias("component_id")).withColumn(
        "kept", F.col("candidate_id").eqNullSafe(F.col("component_id"))
    )


def keep_one(candidates: DataFrame, cfg: NearDedupConfig = NearDedupConfig(), candidate_id: str = "candidate_id", text: str = "text") -> DataFrame:
    """The rows of ``candidates`` with one candidate per group of near-duplicates, all columns as they were.

    Of rows that repeat the kept id, all stay; so do rows without an id. The ids that go are
    stored: Spark takes the joins before them to be far larger, and would shuffle whole texts
    to meet ids that are small enough to send.
    """
    found = near_duplicates(candidates, cfg, candidate_id, text).where(~F.col("kept"))
    gone = cut(found.select(F.col("candidate_id").alias("gone_id")).distinct())
    return candidates.join(gone, candidates[candidate_id] == gone["gone_id"], "left_anti")
