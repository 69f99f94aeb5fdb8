"""Ingest with a state, and stores in buckets: failures, repeats, plans without an exchange of what is stored."""

from __future__ import annotations

import json
import os

import pytest
from pyspark.sql import functions as F

from rankspark.functions.vectors import HashedTokens
from rankspark.sources.bucketed import BucketedStore, NoStore
from rankspark.streaming.keyed import ingest_first


def line(cid, headline):
    return json.dumps({"candidate_id": cid, "profile": {"headline": headline}})


class Failing(HashedTokens):
    """Fails for one text, as a lost model or machine would."""

    def __call__(self, texts):
        if any("bad" in t for t in texts):
            raise RuntimeError("planted")
        return super().__call__(texts)


@pytest.fixture
def stream(spark, tmp_path):
    source, target, progress = (str(tmp_path / n) for n in ("in", "out", "progress"))
    (tmp_path / "in").mkdir()

    def put(name, *lines):
        (tmp_path / "in" / name).write_text("\n".join(lines) + "\n")
        os.utime(tmp_path / "in" / name, (1e9 + ord(name[0]),) * 2)  # batches take files by their age

    def run(make_encoder=HashedTokens, files_per_batch=1):
        ingest_first(spark, source, target, progress, make_encoder=make_encoder, files_per_batch=files_per_batch).awaitTermination()

    def found(name):
        return spark.read.parquet(f"{target}/{name}")

    put.folder = tmp_path
    return put, run, found


def test_first_over_all_batches(spark, stream):
    put, run, found = stream
    put("a.jsonl", line("x", "first"), line("x", "second"), "{broken", line("y", "one"), '{"profile": {}}', "")
    put("b.jsonl", line("y", "late"), line("z", "here"))
    run()
    put("c.jsonl", line("x", "first"), line("x", "second"), line("y", "one"))  # a file that comes again under another name
    put("d.jsonl", line("z", "again"), line("w", "new"), "[1]")
    run()
    run()
    rows = sorted((r.candidate_id, r.profile.headline) for r in found("records").collect())
    assert rows == [("w", "new"), ("x", "first"), ("y", "one"), ("z", "here")]
    assert sorted(r.candidate_id for r in found("features").collect()) == ["w", "x", "y", "z"]
    assert sorted((r.value, r.fault) for r in found("quarantine").collect()) == [("[1]", "not an object"), ("{broken", "not json")]


def test_a_stop_in_the_middle(stream):
    put, run, found = stream
    put("a.jsonl", line("x", "good"), line("y", "fine"))
    run()
    put("b.jsonl", line("x", "later"), line("z", "bad"), line("z", "more"))
    with pytest.raises(Exception, match="planted"):
        run(Failing)
    put("c.jsonl", line("z", "even later"), line("v", "last"))
    run()
    assert sorted((r.candidate_id, r.profile.headline) for r in found("records").collect()) == [("v", "last"), ("x", "good"), ("y", "fine"), ("z", "bad")]
    assert sorted(r.candidate_id for r in found("features").collect()) == ["v", "x", "y", "z"]


def test_a_batch_reads_nothing_that_is_stored(stream):
    """Files that nobody can read stand among the stored ones."""
    put, run, found = stream
    put("a.jsonl", line("x", "good"))
    run()
    folder = put.folder / "out"
    for name in ("records", "features"):
        next((folder / name).glob("batch_id=*/part-*.parquet")).write_bytes(b"not parquet")
    put("b.jsonl", line("x", "later"), line("y", "new"))
    run()
    kept = [r.candidate_id for p in sorted((folder / "records").glob("batch_id=*"))[1:] for r in found(f"records/{p.name}").collect()]
    assert kept == ["y"]


# Buckets


def rows(spark, *values):
    return spark.createDataFrame(list(values), "candidate_id string, model string, text_hash string, source_pos long")


def below_join(df):
    """Steps from the scan of the bucketed table up to the join with it."""
    lines = df._jdf.queryExecution().executedPlan().toString().split("\n")
    at = next(k for k, x in enumerate(lines) if "Bucketed: true" in x)
    depth = lambda x: len(x) - len(x.lstrip(" :+-"))
    steps = [lines[at]]
    for x in reversed(lines[:at]):
        if depth(x) < depth(steps[-1]):
            if "LeftAnti" in x:
                break
            steps.append(x)
    return steps


def test_store_keeps_its_buckets(spark, tmp_path):
    path = str(tmp_path / "s")
    first = [(f"c{n}", "m", f"h{n}", n) for n in range(50)]
    store = BucketedStore.create(rows(spark, *first), path, buckets=4)
    wanted = rows(spark, ("c1", "m", "h1", 0), ("c1", "m", "other", 0), ("c2", "n", "h2", 0), ("zz", "m", "h", 0), (None, "m", "h", 0), ("c3", None, "h3", 0))
    got = sorted((r.candidate_id or "", r.model or "", r.text_hash) for r in store.todo(wanted).collect())
    assert got == [("", "m", "h"), ("c1", "m", "other"), ("c2", "n", "h2"), ("c3", "", "h3"), ("zz", "m", "h")]
    store.merge(rows(spark, ("c1", "x", "x", 1), ("new", "m", "b", 9), ("new", "m", "a", 2), ("c49", "x", "x", 1)))
    store.close()
    again = BucketedStore.open(spark, path)
    assert again.buckets == 4 and again.read().count() == 51
    assert [r.text_hash for r in again.read().where("candidate_id = 'new'").collect()] == ["a"]
    before = again.read().orderBy("candidate_id").collect()
    assert len(list((tmp_path / "s" / again.generation).glob("*.parquet"))) > 4
    again.compact()
    assert len(list((tmp_path / "s" / again.generation).glob("*.parquet"))) == 4
    assert BucketedStore.open(spark, path).read().orderBy("candidate_id").collect() == before == again.read().orderBy("candidate_id").collect()
    again.merge(rows(spark, ("more", "m", "x", 1)))
    assert BucketedStore.open(spark, path).read().count() == 52
    with pytest.raises(NoStore):
        BucketedStore.open(spark, str(tmp_path / "none"))


def test_the_stored_side_is_not_exchanged(spark, tmp_path):
    store = BucketedStore.create(rows(spark, *[(f"c{n}", "m", "h", n) for n in range(20)]), str(tmp_path / "s"), buckets=8)
    wanted = rows(spark, *[(f"c{n}", "m", "h", n) for n in range(10, 30)])
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for df in (store.todo(wanted), store.fresh(wanted)):
            above = below_join(df)
            assert any("FileScan" in x for x in above) and not any("Exchange" in x for x in above), above
            assert sorted(r.candidate_id for r in df.collect()) == [f"c{n}" for n in range(20, 30)]
        copy = store.read()._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in copy
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
