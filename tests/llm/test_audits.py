"""Divergence of companies, packing and rearranged texts: brute force, laws and exact round trips."""

from __future__ import annotations

import hashlib
import json
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from rankspark.llm import divergence, fill_middle, packing, token_output
from rankspark.sources import candidates, features

DEFINITION = token_output.load_definition(public_tokenizers.path("word_bpe_49k.json"))
LIBRARY = Tokenizer.from_str(DEFINITION)


@pytest.fixture(scope="module")
def records(spark, tmp_path_factory):
    """Candidate records of the project, read from JSON lines."""
    rng, folder = random.Random(4), tmp_path_factory.mktemp("records")
    words = "kafka spark python lead built models search für naïve Übung 数据 team-work data2vec".split()

    def one(i):
        profile = {
            "headline": " ".join(rng.choices(words, k=rng.randrange(1, 9))),
            "summary": "\n".join(" ".join(rng.choices(words, k=6)) for _ in range(rng.randrange(0, 5))),
            "current_company": rng.choice(["Acme", "Bolt", "Coda", None]),
            "current_industry": rng.choice(["Software", "Retail", None]),
        }
        return json.dumps({"candidate_id": f"CAND_{i:04d}", "profile": profile, "skills": ["Go", "C++"]})

    (folder / "c.jsonl").write_text("\n".join(one(i) for i in range(150)))
    rows = candidates.scan_candidates(spark, str(folder))
    return features.with_text(rows).join(rows.select("candidate_id", "profile.current_industry", "profile.current_company"), "candidate_id")


# Divergence


def audit(rows, least, top):
    """``company_divergence`` with dictionaries."""
    count, texts, names = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, industry, company in rows:
        industry, company = industry or "", company or ""
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        found = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", low)
        names[industry].add(company)
        count[industry, company].update(found)
        texts[industry].update(set(found))
    out = []
    for industry, companies in names.items():
        kept = [t for t, n in texts[industry].items() if n >= least]
        total = Counter()
        for c in companies:
            total.update(count[industry, c])

        def share(n, kept=kept):
            size = sum(n[t] for t in kept) + 2 * len(kept)
            return {t: 1 + 10**9 * (n[t] + 2) // size for t in kept}

        f = lambda p, q: (p - q) ** 2 // (p + q)
        p, q = {c: share(count[industry, c]) for c in companies}, share(total)
        for c in companies:
            pairs = [(sum(f(p[c][t], p[d][t]) for t in kept), d) for d in companies if d != c]
            parts = [(f(p[c][t], q[t]), t) for t in kept if count[industry, c][t] and p[c][t] > q[t]]
            for part, few in (("pair", pairs), ("term", sorted(parts, key=lambda x: (-x[0], x[1].encode()))[:top])):
                few = sorted(few, key=lambda x: (-x[0], x[1].encode()))
                out += [(industry, c, part, item, value, k) for k, (value, item) in enumerate(few, 1)]
    return sorted(out)


CASES = [
    divergence.DivergenceConfig(least_texts=3),
    divergence.DivergenceConfig(least_texts=2, top_terms=3, block_terms=4, companies_per_task=2, terms_per_sort=7, terms_in_memory=5),
]


@pytest.mark.parametrize("cfg", CASES)
def test_divergence_against_brute_force(spark, cfg):
    rng = random.Random(1)
    words = ["".join(rng.choice("abcXé日") for _ in range(rng.randrange(1, 3))) for _ in range(60)]
    rows = []
    for _ in range(200):
        text = "".join(rng.choice(words) + rng.choice([" ", "-", "0", "\n"]) for _ in range(rng.randrange(0, 15)))
        rows.append((text, rng.choice(["a", "b", None, ""]), f"c{rng.randrange(7)}"))
    rows += [(None, "a", "silent"), ("", "bare", "x"), ("rare", "bare", "y"), ("z " * 5000, "a", "long"), (None, None, None)]
    rows += [rows[3]] * 4
    table = spark.createDataFrame(rows, "text string, current_industry string, current_company string").withColumn("rank", F.lit("clash"))
    got = divergence.company_divergence(table.repartition(5), cfg).collect()
    assert sorted(tuple(r) for r in got) == audit(rows, cfg.least_texts, cfg.top_terms)


def test_divergence_of_records(records):
    cfg = divergence.DivergenceConfig(least_texts=5)
    want = audit([(r.text, r.current_industry, r.current_company) for r in records.collect()], 5, 10)
    assert sorted(tuple(r) for r in divergence.company_divergence(records, cfg).collect()) == want
    assert {r[2] for r in want} == {"pair", "term"}
    assert divergence.company_divergence(records.where("false"), cfg).count() == 0


def test_equal_subtrees_are_one_node_and_priced_once():
    counts = np.zeros((3, 1000), dtype=np.int64)
    counts[0, :8], counts[1, :8], counts[2, 500] = 5, [5, 5, 5, 5, 1, 2, 3, 4], 9
    forest = divergence.Forest.of(counts)
    assert sum(len(c) for c in forest.children) < 60
    sizes = counts.sum(axis=1) + 2000
    total, priced = forest.price(0, np.array([1, 2]), sizes)
    p = [divergence.shares(counts[k], sizes[k]) for k in range(3)]
    assert total.tolist() == [int(divergence.distance(p[0], p[k]).sum()) for k in (1, 2)]
    assert priced <= 9
    slot, count = forest.held(1)
    assert slot.tolist() == list(range(8)) and count.tolist() == counts[1, :8].tolist()
    big = np.array([0, 10**15, 3 * 10**15], dtype=np.int64)
    assert divergence.shares(big, 4 * 10**15).tolist() == [1 + 10**9 * (int(c) + 2) // (4 * 10**15) for c in big]


# Packing


def check_packed(rows, got, window):
    """Every id in exactly one piece, sequences without gaps and padding."""
    want = Counter()
    for i, t in rows:
        ids = np.asarray([*LIBRARY.encode(t or "", add_special_tokens=False).ids, 2], dtype="<u4").tobytes()
        want[i, ids] += 1
    sequences, texts = defaultdict(list), defaultdict(list)
    for r in got:
        assert len(r.ids) == 4 * r.length and r.length > 0
        sequences[r.sequence_id].append((r.offset, r.length))
        texts[r.candidate_id].append((r.start, bytes(r.ids), r.candidate_tokens))
    for pieces in sequences.values():
        pieces.sort()
        assert [o for o, _ in pieces] == [sum(n for _, n in pieces[:k]) for k in range(len(pieces))]
        size = sum(n for _, n in pieces)
        assert size == window or size & (size - 1) == 0
    for i, pieces in texts.items():
        if sum(n for (c, _), n in want.items() if c == i) == 1:
            pieces.sort()
            whole = b"".join(ids for _, ids, _ in pieces)
            assert want[i, whole] == 1 and all(n == len(whole) // 4 for *_, n in pieces)
            assert [s for s, *_ in pieces] == [sum(len(x) // 4 for _, x, _ in pieces[:k]) for k in range(len(pieces))]
    assert sum(len(ids) // 4 * n for (_, ids), n in want.items()) == sum(r.length for r in got)
    assert set(texts) == {i for i, _ in rows}
    return sequences


@pytest.mark.parametrize("window, open_windows", [(4096, 4096), (64, 4096), (48, 3), (1, 5)])
def test_packing_laws(spark, window, open_windows):
    rng = random.Random(window)
    rows = [(i, " ".join(rng.choice(["data", "engineering", "of", "x1"]) for _ in range(rng.choice([0, 3, 20, 90])))) for i in range(300)]
    rows += [(900, None), (901, ""), (None, "no id"), (7, "again"), (7, "again"), (902, "very long " * 9000)]
    table = spark.createDataFrame(rows, "candidate_id long, text string").withColumn("offset", F.lit("clash")).repartition(4)
    cfg = packing.PackConfig(window_tokens=window, open_windows=open_windows, bytes_per_batch=2000)
    got = packing.pack_candidates(table, DEFINITION, cfg).collect()
    sequences = check_packed(rows, got, window)
    if window == 4096:  # at most the binary digits of one window a task
        assert sum(sum(n for _, n in s) != window for s in sequences.values()) <= 4 * 12
    assert packing.pack_candidates(table.where("false"), DEFINITION, cfg).count() == 0


def test_packing_of_records(records):
    rows = [(r.candidate_id, r.text) for r in records.collect()]
    got = packing.pack_candidates(records, DEFINITION, packing.PackConfig(window_tokens=128)).collect()
    check_packed(rows, got, 128)
    assert zlib.crc32(bytes(got[0].ids)) == records.sparkSession.createDataFrame([got[0]]).select(F.crc32("ids")).first()[0]


def test_levels_take_the_least_sum_of_squares():
    rng, size = random.Random(2), 20
    levels = packing.Levels(size)
    for _ in range(2000):
        length = rng.choice([2, 3, 5, 7, 11, 13])
        count = levels.count.copy()
        assert [len(w) for w in levels.windows] == count[:size].tolist() and count[size] == 0

        def after(level, count=count, length=length):
            new = count.copy()
            if level:
                new[level] -= 1
            if level + length < size:
                new[level + length] += 1
            return int((new**2).sum())

        choices = [h for h in range(size - length + 1) if h == 0 or count[h]]
        assert after(levels.best(length)) == min(map(after, choices))
        levels.put(packing.Piece(0, memoryview(b""), 0, length))
    full = [sum(p.length for p in w) for w in levels.settle()]
    assert all(n == size or n & (n - 1) == 0 for n in full) and levels.open == 0


def test_few_texts_are_cut():
    """Texts shorter than a window stay whole until the end of a task, where each window closed costs one cut at most."""
    rng, packer, n = random.Random(3), packing.Packer(packing.PackConfig()), 3000
    done = [w for i in range(n) for w in packer.add(i, bytes(4 * rng.randrange(1, 3000)))]
    assert all(p.length == len(p.ids) // 4 for w in done for p in w)
    at_end = list(packer.end())
    cut = {p.candidate_id for w in at_end for p in w if p.length != len(p.ids) // 4}
    assert len(cut) <= len(at_end)


# Rearranged texts


@pytest.mark.parametrize(
    "offsets",
    [[0], [5], list(range(70_000)), list(range(0, 200_000, 2)), [0, 65535, 65536, 131072, 1 << 33], [*range(10), *range(66_000, 90_000), 400_000]],
)
def test_select_in_containers(offsets):
    found = fill_middle.Boundaries(np.array(offsets))
    step = max(1, len(offsets) // 997)
    assert [found.select(k) for k in range(0, len(offsets), step)] == offsets[::step]
    assert found.select(len(offsets) - 1) == offsets[-1]
    for k in (-1, len(offsets)):
        with pytest.raises(IndexError):
            found.select(k)


def test_all_containers_occur():
    kinds = lambda x: [type(c).__name__ for c in fill_middle.Boundaries(np.array(x)).containers]
    assert kinds([1, 5, 9]) == ["ArrayContainer"]
    assert kinds(range(0, 60_000, 2)) == ["BitmapContainer"]
    assert kinds([*range(5000), 65536 + 7]) == ["RunContainer", "ArrayContainer"]


def rearranged(text, key, cfg):
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    h = hashlib.sha256(f"{cfg.seed}:{key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    a, b = sorted((h1 % (len(lines) + 1), h2 % (len(lines) + 1)))
    p, m, s = "".join(lines[:a]), "".join(lines[a:b]), "".join(lines[b:])
    if not text or re.search("<[PSM]>", text) or h3 % 100 >= cfg.fill_percent:
        return len(lines), "plain", None, None, text
    if h4 % 100 < cfg.suffix_first_percent:
        return len(lines), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(lines), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("cfg", [fill_middle.FillConfig(bytes_per_batch=100), fill_middle.FillConfig(seed=1, fill_percent=60, suffix_first_percent=20)])
def test_middles_against_brute_force(spark, cfg):
    rng = random.Random(6)
    texts = ["", None, "\n", "\n\n\n", "a", "a\n", "<P", "<P\n>", "x<S>y", "<M>", "<<S\n>P>", "é\r\n日 b\n😀", "word\n" * 80_000, "\n" * 70_000]
    texts += ["".join(rng.choice("ab<PSM>\né日😀") for _ in range(rng.randrange(0, 40))) for _ in range(300)]
    rows = list(enumerate(texts)) + [(None, "no\nid"), (3, "other\ntext"), (3, "other\ntext")]
    table = spark.createDataFrame(rows, "candidate_id long, text string").withColumn("output", F.lit("clash")).repartition(4)
    made = fill_middle.fill_in_middle(table, cfg).withColumn("again", fill_middle.restored("output", "form", cfg))
    got = made.collect()
    want = Counter((i, *rearranged(t or "", "" if i is None else str(i), cfg), t or "") for i, t in rows)
    assert Counter(tuple(r) for r in got) == want
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    assert fill_middle.fill_in_middle(table.where("false"), cfg).count() == 0


def test_middles_of_records(records):
    made = fill_middle.fill_in_middle(records).withColumn("again", fill_middle.restored("output", "form"))
    both = made.join(records.select("candidate_id", "text"), "candidate_id")
    assert both.count() == 150 and both.where("again <> text").count() == 0
    assert both.where("form = 'plain'").count() < 150
