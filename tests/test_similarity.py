"""Posting lists and the exact top K they give, against brute force."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict
from math import floor, sqrt

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rankspark.config import RankConfig
from rankspark.operators import similarity
from rankspark.sources import candidates, features, postings


def counts(text):
    return Counter(re.findall(r"[^\W_]+", (text or "").lower()))


def brute_force(texts, jobs, k, digits):
    length = lambda c: sqrt(sum(n * n for n in c.values()))
    out = []
    own = {i: counts(t) for i, t in texts}
    for j, t in jobs:
        c, rows = counts(t), []
        for i, d in own.items():
            dot = sum(n * d[w] for w, n in c.items())
            rows.append((-(floor(dot / (length(c) * length(d)) * 10**digits + 0.5) / 10**digits if dot else 0.0), i))
        out += [(j, i, -s, r) for r, (s, i) in enumerate(sorted(rows)[:k], 1)]
    return sorted(out)


@pytest.fixture(scope="module")
def texts():
    """Some words are in nearly every text, most are rare; copies make ties."""
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdeé") for _ in range(4)) for _ in range(400)]
    weights = [1 / (k + 1) for k in range(400)]
    made = [" ".join(rng.choices(words, weights, k=rng.choice([1, 5, 30, 120]))) for _ in range(500)]
    made += [None, "", "...", made[3], made[3].upper(), words[0], words[0] * 2, "the " * 5000 + made[7]]
    return [(f"c{k:03d}", t) for k, t in enumerate(made)]


def index_of(spark, texts, path, cfg=postings.PostingConfig()):
    table = spark.createDataFrame(texts, "candidate_id string, text string").withColumn("norm", F.lit("clash"))
    postings.write(table.repartition(3), path, cfg)
    return postings.read(spark, path)


SMALL = postings.PostingConfig(block_rows=7, rows_per_task=500)


@pytest.mark.parametrize("cfg", [postings.PostingConfig(), SMALL])
def test_lists_are_whole_and_in_blocks(spark, texts, tmp_path, cfg):
    index = index_of(spark, texts, str(tmp_path / "i"), cfg)
    want = defaultdict(dict)
    for i, t in texts:
        c = counts(t)
        for w, n in c.items():
            want[w][i] = n / sqrt(sum(x * x for x in c.values()))
    got = defaultdict(dict)
    for r in index.blocks.collect():
        assert len(r.ids) == len(r.weights) == r["size"] <= cfg.block_rows
        assert r.weights == sorted(r.weights, reverse=True) and r.max_weight == r.weights[0]
        assert not set(got[r.term]) & set(r.ids)
        got[r.term].update(zip(r.ids, r.weights))
    assert {w: sorted(x) for w, x in got.items()} == {w: sorted(x) for w, x in want.items()}
    assert all(abs(got[w][i] - x) < 1e-12 for w, few in want.items() for i, x in few.items())
    assert index.blocks.select("block").distinct().count() == index.blocks.count()


@pytest.mark.parametrize("k, digits", [(1, 6), (5, 6), (40, 3), (600, 9)])
def test_similar_texts_against_brute_force(spark, texts, tmp_path, k, digits):
    rng = random.Random(k)
    jobs = [(f"j{n}", " ".join((rng.choice(texts)[1] or "x").split()[:40])) for n in range(8)]
    jobs += [("nothing", "zzz yyy"), ("null", None), ("rare", "zzz " + texts[0][1])]
    index = index_of(spark, texts, str(tmp_path / "i"), SMALL)
    wanted = spark.createDataFrame(jobs, "job_id string, jd_text string")
    cfg = RankConfig(recall_k=k, score_digits=digits)
    got = sorted(tuple(r) for r in similarity.similar_texts(index, wanted, cfg, splits=3).select("job_id", "candidate_id", "sem_score", "recall_rank").collect())
    want = brute_force(texts, jobs, k, digits)
    assert [(a, b, d) for a, b, _, d in got] == [(a, b, d) for a, b, _, d in want]
    assert all(abs(x[2] - y[2]) < 10.0**-digits / 2 for x, y in zip(got, want))


def test_lists_and_entries_are_left_out(spark, texts, tmp_path):
    """For a job that copies a text, most postings of its tokens are never opened, and few texts are scored in full."""
    index = index_of(spark, texts, str(tmp_path / "i"), SMALL)
    copied = next(t for _, t in texts if t and len(t.split()) == 120)
    jobs = spark.createDataFrame([(1, copied)], "job_id long, jd_text string")
    cfg = RankConfig(recall_k=1)
    wanted = similarity.job_terms(jobs)
    listed = similarity.bounds(wanted, index)
    reached = similarity._best(similarity.exact_scores(similarity.seeds(index, listed, cfg), index, wanted, cfg), 1).first().sem_score
    need = (F.lit(reached - 1e-6) - F.col("rest")) / F.col("w")
    needed = listed.withColumn("need", need).withColumn("cap", F.lit(0.0)).where("need <= max_weight")
    every = index.blocks.join(wanted, "term").agg(F.sum("size")).first()[0]
    opened = similarity.open_lists(index, needed, 3).count()
    assert reached > 0.5 and opened < every / 5, (reached, opened, every)


def test_index_of_records_and_odd_tables(spark, tmp_path):
    (tmp_path / "c.jsonl").write_text("\n".join(
        f'{{"candidate_id": "C{i}", "profile": {{"headline": "h{i % 3} data", "summary": "{"spark " * i}"}}}}' for i in range(9)))
    rows = features.with_text(candidates.scan_candidates(spark, str(tmp_path / "c.jsonl")))
    postings.write(rows, str(tmp_path / "i"))
    index = postings.read(spark, str(tmp_path / "i"))
    jobs = spark.createDataFrame([(1, "Spark data, data")], "job_id long, jd_text string")
    got = similarity.similar_texts(index, jobs, RankConfig(recall_k=3)).collect()
    want = brute_force([(r.candidate_id, r.text) for r in rows.collect()], [(1, "Spark data, data")], 3, 9)
    assert sorted((r.job_id, r.candidate_id, r.recall_rank) for r in got) == [(a, b, d) for a, b, _, d in want]
    postings.write(rows.where("false"), str(tmp_path / "none"))
    empty = postings.read(spark, str(tmp_path / "none"))
    assert similarity.similar_texts(empty, jobs, RankConfig(recall_k=3)).count() == 0
    assert similarity.similar_texts(index, jobs.where("false"), RankConfig(recall_k=3)).count() == 0
    index.vectors.drop("norm").write.parquet(str(tmp_path / "bad/vectors"))
    index.blocks.write.parquet(str(tmp_path / "bad/blocks"))
    with pytest.raises(postings.MissingIndex):
        postings.read(spark, str(tmp_path / "bad"))


def test_frequent_tokens_read_each_text_once(spark, texts, tmp_path, monkeypatch):
    """Where the lists of all jobs together have more entries than the index, no list is opened; results stay exact."""
    most = [w for w, _ in Counter(" ".join(t or "" for _, t in texts).lower().split()).most_common(12)]
    rng = random.Random(4)
    jobs = [(n, " ".join(rng.sample(most, 8))) for n in range(9)]
    index = index_of(spark, texts, str(tmp_path / "i"))
    monkeypatch.setattr(similarity, "open_lists", None)
    wanted = spark.createDataFrame(jobs, "job_id long, jd_text string")
    got = similarity.similar_texts(index, wanted, RankConfig(recall_k=20)).collect()
    want = brute_force(texts, jobs, 20, 9)
    assert sorted((r.job_id, r.candidate_id, r.recall_rank) for r in got) == [(a, b, d) for a, b, _, d in want]


@pytest.mark.parametrize("cells", [2_000_000, 30])
def test_scan_in_blocks(spark, texts, tmp_path, cells):
    """Several blocks of jobs and slices of one text give what one block gives."""
    jobs = [(f"j{n}", " ".join((texts[n][1] or "x").split()[:9])) for n in range(6)] + [("none", "zzz"), ("null", None)]
    index = index_of(spark, texts, str(tmp_path / "i"))
    wanted = similarity.job_terms(spark.createDataFrame(jobs, "job_id string, jd_text string"))
    found = similarity.scan_scores(index, wanted, spark.createDataFrame([], "job_id string, reached double"), RankConfig(recall_k=4), cells)
    got = similarity._best(found, 4).collect()
    want = [x for x in brute_force(texts, jobs, 4, 9) if x[2] > 0]
    assert sorted((r.job_id, r.candidate_id, r.recall_rank) for r in got) == [(a, b, d) for a, b, _, d in want]
    assert all(abs(x - y) < 1e-9 for x, y in zip(sorted(r.sem_score for r in got), sorted(x[2] for x in want)))


class Handed:
    """Stands for a table and keeps the function that its tasks would run."""

    def __init__(self, df):
        self.schema = df.schema

    def select(self, *_):
        return self

    def mapInArrow(self, run, _):  # noqa: N802
        return run


def test_counted_texts_leave_a_task_in_small_batches(spark):
    """A batch of many long texts is not held as counts at once."""
    table = pa.table({"candidate_id": [str(k) for k in range(2000)], "text": [f"w{k} " * 500 + "é" for k in range(2000)]})
    run = postings.count_terms(Handed(spark.createDataFrame([("", "")], "candidate_id string, text string")), "candidate_id", "text")
    made = list(run(table.to_batches()))
    assert len(made) > 2 and max(b.num_rows for b in made) < 1000
    rows = pa.Table.from_batches(made).to_pylist()
    assert [r["candidate_id"] for r in rows] == [str(k) for k in range(2000)]
    assert rows[7]["terms"] == [{"term": "w7", "n": 500}, {"term": "é", "n": 1}]
