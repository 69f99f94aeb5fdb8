"""Near-duplicate texts and vectors, and components, against brute force."""

from __future__ import annotations

import os
import random
import weakref
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankspark.llm import common, embedding_dedup, near_dedup
from rankspark.llm.common import Memo, forget_earlier_stages, per_worker
from rankspark.session import run_folder, setting


def components(ids, links):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("seed", [1, 2])
def test_connected(spark, seed):
    rng = random.Random(seed)
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 160)] + [(i, 500) for i in range(200, 240)]
    edges += [(rng.randrange(600, 700), rng.randrange(600, 700)) for _ in range(70)]
    want = components({x for e in edges for x in e}, edges)
    found = common.connected(spark.createDataFrame(edges, "a long, b long"))
    by_root: dict = {}
    for r in found.collect():
        by_root.setdefault(r.root, set()).add(r.v)
    linked = {x for a, b in edges if a != b for x in (a, b)}
    groups: dict = {}
    for v in linked:
        groups.setdefault(want[v], set()).add(v)
    assert sorted(map(sorted, by_root.values())) == sorted(map(sorted, groups.values()))
    assert common.connected(spark.createDataFrame([], "a long, b long")).count() == 0


def shingle_set(text, n):
    w = (text or "").encode().lower().split()
    return {b" ".join(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def brute_texts(rows, n, percent):
    sets = {i: shingle_set(t, n) for i, t in rows}
    links = [
        (a, b) for a, b in combinations(sets, 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])
    ]
    comp = components(sets, links)
    return {(i, len(sets[i]), comp[i], comp[i] == i) for i in sets}


def test_links_between_members_that_the_hub_lacks(spark):
    """Bands of one component put unlinked texts into shared buckets, blocks of few shingles split these."""
    rng = random.Random(5)
    shared = [f"s{i}" for i in range(40)]
    rows = []
    for group in range(8):
        own = [f"g{group}w{i}" for i in range(30 + 8 * group)]
        for _ in range(3):
            copy = shared + own
            copy[rng.randrange(len(copy))] = f"x{len(rows)}"
            rows.append((len(rows), " ".join(copy)))
    table = spark.createDataFrame(rows, "candidate_id long, text string")
    want = brute_texts(rows, 4, 80)
    assert 8 <= sum(kept for *_, kept in want) < len(rows)
    for block in (150, 250_000):
        cfg = near_dedup.NearDedupConfig(words=4, bands=24, band_rows=1, block_shingles=block)
        assert {tuple(r) for r in near_dedup.near_duplicates(table, cfg).collect()} == want


@pytest.mark.parametrize("n", [4, 5])
def test_near_duplicates(spark, n):
    rng = random.Random(n)
    vocabulary = [f"w{i}" for i in range(400)]
    rows, i = [], 0
    for _ in range(12):  # groups whose members are one, two or many replacements away from a base
        base = [rng.choice(vocabulary) for _ in range(rng.choice((3, 12, 60, 150)))]
        for _ in range(rng.randrange(1, 14)):
            copy = list(base)
            for _ in range(rng.choice((0, 0, 1, 2, 3, 5, 9))):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            rows.append((i, " ".join(copy)))
            i += 1
    # a chain: each is linked with the next one, the ends are not
    chain = [f"c{k}" for k in range(120)]
    for k in range(14):
        rows.append((i, " ".join(chain[k * 4 : k * 4 + 60])))
        i += 1
    rows += [(i, None), (i + 1, ""), (i + 2, " \t\n"), (i + 3, "One"), (i + 4, "one"), (i + 5, "a b"), (i + 6, "a  B"), (i + 7, "x y z")]
    rng.shuffle(rows)
    table = spark.createDataFrame(rows, "candidate_id long, text string").withColumn("digest", F.lit("clash")).repartition(5)
    got = near_dedup.near_duplicates(table, near_dedup.NearDedupConfig(words=n))
    assert {tuple(r) for r in got.collect()} == brute_texts(rows, n, 80)
    kept = near_dedup.keep_one(table, near_dedup.NearDedupConfig(words=n))
    assert kept.columns == table.columns
    assert {r.candidate_id for r in kept.collect()} == {x[0] for x in brute_texts(rows, n, 80) if x[3]}


def test_members_that_the_hub_does_not_reach(spark):
    """Two groups in one bucket: the hub links with one of them only."""
    one = [f"p{k}" for k in range(100)]
    two = one[:72] + [f"q{k}" for k in range(28)]
    rows = []
    for g, base in enumerate((one, two)):
        for k in range(30):
            copy = list(base)
            copy[(k * 3) % 70] = f"z{g}-{k}"
            rows.append((g * 100 + k, " ".join(copy)))
    cfg = near_dedup.NearDedupConfig(words=1, bands=40, band_rows=1)
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "candidate_id long, text string"), cfg)
    assert {tuple(r) for r in got.collect()} == brute_texts(rows, 1, 80)


def test_few_ids_that_go_do_not_move_whole_texts(spark):
    """What decides is how large the ids are, not how large Spark takes the joins before them to be."""
    rows = [(k, f"text number {k // 2} has words of its own like w{k // 2} and v{k // 2}") for k in range(400)]
    table = spark.createDataFrame(rows, "candidate_id long, text string")
    with setting(spark, "spark.sql.autoBroadcastJoinThreshold", "256k"):
        kept = near_dedup.keep_one(table)
        plan = kept._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
        assert sorted(r.candidate_id for r in kept.collect()) == list(range(0, 400, 2))


def test_a_worker_keeps_the_object_of_one_stage():
    class Made:
        def __init__(self):
            self.memo = Memo(self.of)

        def of(self, key):
            return key

    first = weakref.ref(per_worker("first", Made))
    assert per_worker("first", Made) is first()
    second = weakref.ref(per_worker("second", Made))
    assert first() is None and second() is not None
    forget_earlier_stages()
    assert second() is None


def test_odd_ids_and_empty_tables(spark):
    text = "one and the same text of more than five words"
    rows = spark.createDataFrame([("b", text), ("a", text), ("a", text), (None, text), (None, None), ("c", None)], "candidate_id string, text string")
    got = sorted((r.candidate_id or "-", r.component_id or "-", r.kept) for r in near_dedup.near_duplicates(rows).collect())
    assert got == [("-", "-", True), ("-", "a", False), ("a", "a", True), ("a", "a", True), ("b", "a", False), ("c", "c", True)]
    assert near_dedup.near_duplicates(rows.where("false")).count() == 0
    long = " ".join(f"w{i}" for i in range(150_000))
    pair = spark.createDataFrame([(1, long), (2, long + " end"), (3, long[: len(long) // 2])], "candidate_id long, text string")
    assert {(r.candidate_id, r.component_id) for r in near_dedup.near_duplicates(pair).collect()} == {(1, 1), (2, 1), (3, 3)}


def brute_vectors(rows, limit):
    good = {}
    for i, v in rows:
        if v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            good[i] = np.asarray(v, np.float32).astype(float)
    links = []
    for a, b in combinations(good, 2):
        x, y = good[a], good[b]
        if len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= limit:
            links.append((a, b))
    comp = components([i for i, _ in rows], links)
    n = {i: 0 for i, _ in rows}
    for a, b in links:
        n[a] += 1
        n[b] += 1
    return {(i, n[i], comp[i], comp[i] == i) for i, _ in rows}


@pytest.mark.parametrize("block, fan_out", [(512, 16), (7, 2), (5, 3)])
def test_near_duplicate_vectors(spark, block, fan_out):
    rng = np.random.default_rng(block)
    centres = rng.normal(size=(9, 12))
    rows = [(i, (centres[i % 9] + rng.normal(size=12) * rng.choice([0.05, 0.25, 0.6])).tolist()) for i in range(160)]
    rows += [(200 + i, rows[3][1]) for i in range(25)] + [(300, (2 * np.array(rows[3][1])).tolist())]
    rows += [(400, None), (401, []), (402, [0.0] * 12), (403, [float("nan")] * 12), (404, [float("inf")] + [1.0] * 11)]
    rows += [(405, [None] + [1.0] * 11), (406, [1.0, 2.0]), (407, [1.0, 2.0]), (408, [1e-30] * 12), (409, [-0.0] * 12)]
    table = spark.createDataFrame(rows, "candidate_id long, embedding array<float>").withColumn("v", F.lit("clash")).repartition(4)
    cfg = embedding_dedup.GridConfig(block=block, fan_out=fan_out, rows_per_task=50)
    got = embedding_dedup.near_duplicate_vectors(table, cfg)
    assert {tuple(r) for r in got.collect()} == brute_vectors(rows, 0.95)


def test_vectors_without_any_link(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, None)], "candidate_id long, embedding array<double>")
    got = embedding_dedup.near_duplicate_vectors(rows)
    assert {tuple(r) for r in got.collect()} == {(1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True)}
    assert embedding_dedup.near_duplicate_vectors(rows.where("candidate_id = 3")).count() == 1
    assert embedding_dedup.near_duplicate_vectors(rows.where("false")).count() == 0


@pytest.mark.parametrize("sizes", [{"held_bytes": 2000, "at_a_time": 10}, {"held_bytes": 1, "block": 100}, {"pivots": 1, "leading": 2}])
def test_vectors_meet_in_any_number_of_passes(spark, sizes):
    """Cells that are held together, those of later passes, equal vectors and vectors of other lengths."""
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(5, 12))
    rows = [(i, (centres[i % 5] + rng.normal(size=12) * rng.choice([0.1, 0.25, 0.5])).tolist()) for i in range(50)]
    rows += [(100 + i, rows[i][1]) for i in range(4)] + [(110 + i, (rng.normal(size=3) + [3, 0, 0]).tolist()) for i in range(10)]
    table = spark.createDataFrame(rows, "candidate_id long, embedding array<float>").repartition(3)
    cfg = embedding_dedup.GridConfig(**{"block": 8, "fan_out": 3, "rows_per_task": 30} | sizes)
    assert {tuple(r) for r in embedding_dedup.near_duplicate_vectors(table, cfg).collect()} == brute_vectors(rows, 0.95)


def test_disk_follows_vectors_not_pairs_of_blocks(spark):
    """Random vectors, of which no bound tells two blocks apart: a body that travels per pair fills the disk."""
    rng = np.random.default_rng(1)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(4000, 32)))]
    table = spark.createDataFrame(rows, "candidate_id long, embedding array<float>").repartition(4).localCheckpoint()
    manager = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    places = [d.getPath() for d in manager.localDirs()] + [run_folder(spark).removeprefix("file:")]

    def used() -> int:
        return sum(os.lstat(f"{d}/{f}").st_size for top in places for d, _, files in os.walk(top) for f in files)

    before = used()
    with setting(spark, "spark.sql.autoBroadcastJoinThreshold", "64k"):
        got = embedding_dedup.near_duplicate_vectors(table, embedding_dedup.GridConfig(block=64, rows_per_task=1000))
        assert got.where("n_links = 0 and kept").count() == 4000
    grown = used() - before
    assert grown < 20 * 4000 * 32 * 4


@pytest.mark.parametrize("dims, kind", [(1, "<f4"), (2, "<f8"), (9, "<f4"), (40, "<f8")])
def test_bounds_lose_no_link(dims, kind):
    """Dense and thin groups, pairs at the very limit, and lengths beside that of the directions."""
    rng = np.random.default_rng(dims)
    m = np.concatenate([rng.normal(size=(60, dims)), rng.normal(size=(1, dims)) + rng.normal(size=(60, dims)) * 0.05, -np.ones((3, dims))])
    if dims > 4:
        m = np.concatenate([m, np.pad([[1, 0, 0, 0, 0], [19, 5, 3, 2, 1]], ((0, 0), (0, dims - 5)))])
    m = m.astype(np.float32).astype(kind)
    cfg = embedding_dedup.GridConfig(block=12, fan_out=4)
    directions = np.linalg.qr(rng.normal(size=(9, 9)))[0][:, :4]
    cells = list(embedding_dedup._cells(embedding_dedup._short_units(m), cfg.block))
    order, ends = np.concatenate(cells), np.cumsum([len(c) for c in cells])
    assert sorted(order.tolist()) == list(range(len(m))) and max(map(len, cells)) <= cfg.block
    whole = embedding_dedup.Vectors(dims, m[order], order, np.ones(len(m), int), np.arange(len(cells)), np.append(0, ends[:-1]))
    split = len(cells) // 2
    first = embedding_dedup.Vectors(dims, m[order][: ends[split]], order[: ends[split]], whole.ns[: ends[split]], whole.ats[: split + 1], whole.starts[: split + 1])
    at = ends[split]
    second = embedding_dedup.Vectors(dims, m[order][at:], order[at:], whole.ns[at:], whole.ats[split + 1 :], whole.starts[split + 1 :] - at)
    n, edges = np.zeros(len(m), int), []
    for held, reads in ((first, [whole]), (second, [second])):
        met = embedding_dedup.Met(embedding_dedup.Held(held, directions, cfg))
        for v, x, is_edge in [found for right in reads for found in met.read(right, directions)] + [(*met.of_held(), False)]:
            if is_edge:
                edges += zip(v.tolist(), x.tolist(), strict=True)
            else:
                np.add.at(n, v, x)
    want = brute_vectors([(i, v.tolist()) for i, v in enumerate(m)], 0.95)
    comp = components(range(len(m)), edges)
    assert {(i, n[i], comp[i], comp[i] == i) for i in range(len(m))} == want
    assert len(edges) < len(m) * 2
