"""Ingest, stored vectors, job texts, ranked CSV files and incremental ingest."""

from __future__ import annotations

import csv
import gzip
import io
import json

import pytest
from pyspark.sql import functions as F

from rankspark import constants as fixed
from rankspark.functions.vectors import HashedTokens
from rankspark.operators import quality
from rankspark.sources import candidates, features, jobs, ranked_csv
from rankspark.streaming.ingest import ingest



def record(cid, **more):
    return {"candidate_id": cid, "profile": {"headline": f"h {cid}", "years_of_experience": 3}} | more


LINES = [
    json.dumps(record("a", skills=["Go", {"name": " C++ "}, {"name": None}, "", 7])).encode(),
    b"",
    b"   ",
    b'{"candidate_id": "broken"',
    b'["a", "list"]',
    b"17",
    json.dumps({"profile": {"headline": "no id"}}).encode(),
    json.dumps(record("a", skills=["Late"])).encode(),
    json.dumps(record(12, profile="text", career_history={"not": "a list"})).encode(),
    json.dumps(
        record(
            "b",
            career_history=[
                {"company": "X", "duration_months": "12", "start_date": "2020-05"},
                "odd",
                {"company": ["nested"], "duration_months": 7.9, "start_date": "2020-05", "end_date": "2019-05"},
            ],
            sig={"notice_period_days": True, "github_activity_score": 4, "skill_assessment_scores": {"go": 91, "sql": "x"}},
            notice_period_days=45,
        )
    ).encode(),
    b'{"candidate_id": "bad\xff"}',
]


@pytest.fixture
def lines_dir(tmp_path):
    d = tmp_path / "in"
    d.mkdir()
    (d / "one.jsonl").write_bytes(b"\n".join(LINES) + b"\n")
    return d


def test_scan(spark, lines_dir):
    rows = {r.candidate_id: r for r in candidates.scan_candidates(spark, str(lines_dir), "sig").collect()}
    assert set(rows) == {"a", "12", "b"}
    assert [s.name for s in rows["a"].skills] == ["Go", " C++ ", None, "", "7"]
    assert rows["12"].profile.headline is None and rows["12"].career_history == []
    b = rows["b"]
    assert [h.duration_months for h in b.career_history] == [None, 7.9]
    assert b.career_history[1].company is None
    assert b.signals.notice_period_days is None and b.notice_period_days == 45.0
    assert b.signals.skill_assessment_scores == {"go": 91.0, "sql": None}


def test_quarantine(spark, lines_dir):
    parsed = candidates.parse(candidates.read_lines(spark, str(lines_dir)))
    found = sorted(r.fault for r in candidates.quarantine(parsed).collect())
    assert found == ["not an object", "not an object", "not json", "not utf-8"]


def test_gzip_gives_the_same(spark, lines_dir, tmp_path):
    z = tmp_path / "z"
    z.mkdir()
    with gzip.open(z / "one.jsonl.gz", "wb") as f:
        f.write(b"\n".join(LINES))
    plain = candidates.scan_candidates(spark, str(lines_dir), "sig")
    packed = candidates.scan_candidates(spark, str(z), "sig")
    key = lambda df: sorted(str(r) for r in df.collect())
    assert key(plain) == key(packed)


def test_keep_first(spark):
    rows = spark.createDataFrame(
        [(f"id{i % 7}", i, f"v{i}") for i in range(40)] + [("solo", 99, "x")], "candidate_id string, source_pos int, v string"
    ).repartition(5)
    got = candidates.keep_first(rows).collect()
    assert sorted(tuple(r) for r in got) == sorted([(f"id{i}", i, f"v{i}") for i in range(7)] + [("solo", 99, "x")])


@pytest.mark.parametrize("split, cores", [("64", "8"), ("1m", "1")])
def test_scan_loses_nothing_when_splits_change(spark, tmp_path, split, cores):
    """All ids repeat over three files; the action runs with other splits than the call."""
    src = tmp_path / "many"
    src.mkdir()
    for f in range(3):
        (src / f"{f}.jsonl").write_text("\n".join(json.dumps({"candidate_id": f"c{i}", "n": f}) for i in range(700)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    rows = candidates.scan_candidates(spark, str(src))
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.leafNodeDefaultParallelism", cores)
    try:
        assert rows.count() == 700
        assert rows.select("candidate_id").distinct().count() == 700
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.leafNodeDefaultParallelism")


def test_compose_text(spark):
    full = record(
        "x",
        profile={"headline": " H ", "current_title": "T", "current_company": " C ", "current_industry": "", "summary": "S" * 3000},
        skills=[{"name": "a"}, " b "],
        career_history=[{"title": "t1", "description": "d1"}, {"title": " ", "description": "d2"}],
        education=[{"field_of_study": "", "degree": "BSc"}, {"field_of_study": "F"}],
    )
    docs = [full, record("y", profile={"current_company": "Only"}), {"candidate_id": "z"}]
    lines = spark.createDataFrame([(json.dumps(d), i) for i, d in enumerate(docs)], "value string, source_pos int")
    rows = candidates.records(candidates.parse(lines))
    got = dict(rows.select("candidate_id", candidates.compose_text()).collect())
    assert got["x"] == f"H | T at C | Skills: a, b | {'S' * 3000} | Experience: t1 | d1 d2 | Education: BSc, F"
    assert got["y"] == "at Only" and got["z"] == ""
    assert features.with_text(rows).where("candidate_id = 'x'").first().text == got["x"]


def test_jobs(spark, tmp_path):
    t = spark.createDataFrame(
        [(1, " inline ", "file"), (2, "", " file\n"), (3, None, None), (4, None, "  ")],
        "job_id long, inline_text string, file_text string",
    )
    got = dict(jobs.resolve(t).select("job_id", "jd_text").collect())
    assert got == {1: "inline", 2: "file", 3: fixed.SAMPLE_JOB_TEXT, 4: ""}
    with pytest.raises(jobs.EmptyJob):
        jobs.require_text(jobs.resolve(t))
    (tmp_path / "jd.md").write_text("two\nlines\n")
    assert jobs.resolve(jobs.read_jobs(spark, str(tmp_path / "jd.md"))).first().jd_text == "two\nlines"
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        jobs.read_jobs(spark, str(tmp_path / "absent.md")).collect()


def test_features(spark, lines_dir, tmp_path):
    rows = candidates.scan_candidates(spark, str(lines_dir), "sig")
    made = features.build(rows)
    path = str(tmp_path / "f")
    features.write(made, path)
    assert features.read(spark, path).count() == 3
    m = features.manifest(features.read(spark, path)).first()
    assert (m.n_vectors, m.min_dim, m.max_dim, m.n_without_id) == (3, 384, 384, 0)
    with pytest.raises(features.EmptyFeatures):
        features.write(made.where("false"), str(tmp_path / "empty"))
    made.drop("norm").write.parquet(str(tmp_path / "lost"))
    with pytest.raises(features.MissingColumns):
        features.read(spark, str(tmp_path / "lost"))


def test_encoder_reads_whole_texts():
    e = HashedTokens(dim=1000)
    long = "alpha " * 50_000 + "omega"
    v = e([long, "", "Alpha ALPHA"])
    assert v[0].sum() == 50_001 and v[0][e.bucket("omega")] == 1
    assert v[1].sum() == 0 and v[2][e.bucket("alpha")] == 2


def ranked_rows(spark, n=6, job=1):
    return spark.createDataFrame(
        [(job, f"c{i}", i, 1.0 - i / 10, 'say "hi", a\nb' if i == 2 else ("" if i == 3 else f"r{i}")) for i in range(1, n + 1)],
        "job_id long, candidate_id string, rank int, score double, reasoning string",
    )


def test_csv_round_trip(spark, tmp_path):
    rows = ranked_rows(spark).unionByName(ranked_rows(spark, job=2))
    path = str(tmp_path / "out")
    ranked_csv.write(rows, path, rows.select("job_id").distinct(), 6)
    back = ranked_csv.read(spark, path).orderBy("job_id", "rank").collect()
    assert len(back) == 12
    assert back[1].reasoning == 'say "hi", a\nb' and back[2].reasoning == fixed.REASONING_PLACEHOLDER
    assert back[0].score == 0.9
    assert ranked_csv.header_of(spark, f"{path}/job_id=1") == list(fixed.OUTPUT_COLUMNS)


def test_files_are_those_of_a_csv_writer(spark, tmp_path):
    """Byte for byte: CRLF, quotes only where needed, rounding of the exact value."""
    odd = ['x, "q" y', "plain", "line\nfeed", " lead", 'say "hi"', "\\back", "cr\rx", "#x", "crlf\r\nx", "tail "]
    rows = [(1, f"c{k}", k, 1.0 - 0.0000005 * k, t) for k, t in enumerate(odd, 1)]
    ranked = spark.createDataFrame(rows, "job_id long, candidate_id string, rank int, score double, reasoning string")
    path = str(tmp_path / "out")
    ranked_csv.write(ranked.repartition(4), path, ranked.select("job_id").distinct(), len(odd))
    (file,) = (tmp_path / "out" / "job_id=1").glob("part-*")
    want = io.StringIO(newline="")
    out = csv.writer(want)
    out.writerow(fixed.OUTPUT_COLUMNS)
    out.writerows((c, k, f"{s:.6f}", t) for _, c, k, s, t in rows)
    assert file.read_bytes().decode() == want.getvalue()
    back = {r.rank: r.reasoning for r in ranked_csv.read(spark, path).collect()}
    assert [back[k].replace("\r\n", "\n").replace("\r", "\n").strip() for k in range(1, len(odd) + 1)] == [
        t.replace("\r\n", "\n").replace("\r", "\n").strip() for t in odd
    ]


def test_short_results_are_refused(spark, tmp_path):
    want = spark.createDataFrame([(1,), (5,)], "job_id long")
    with pytest.raises(ranked_csv.ShortResult):
        ranked_csv.write(ranked_rows(spark), str(tmp_path / "o"), want, 6)
    assert not (tmp_path / "o").exists()


def test_browse(spark):
    rows = ranked_rows(spark, 20)
    assert [r["rank"] for r in ranked_csv.search(rows, "R1").orderBy("rank").collect()] == [1] + list(range(10, 20))
    assert ranked_csv.search(rows, "r.").count() == 0
    m = ranked_csv.metrics(rows).first()
    assert (m.n_ranked, m.top_score, m.cutoff_score) == (20, 0.9, -1.0)
    assert sorted(r["rank"] for r in ranked_csv.preview(rows, 2).collect()) == [1, 2, 19, 20]
    assert ranked_csv.preview(ranked_rows(spark, 3), 5).count() == 3


def test_raw_csv_checks(spark, tmp_path):
    f = tmp_path / "r.csv"
    f.write_text(
        "candidate_id,rank,score,reasoning\na,1,1.0,ok\nb,x,0.9,ok\nc,3,zero,ok\nd,4,nan,ok\ne,5,0.8\n"
    )
    raw = ranked_csv.read_raw(spark, str(f)).withColumn("job_id", F.lit(1))
    assert [r.row_no for r in quality.columns(raw).collect()] == [5]
    assert [r.row_no for r in quality.contiguous(raw).collect()] == [2]
    assert [r.row_no for r in quality.score_bounds(raw).orderBy("row_no").collect()] == [3, 4]
    assert quality.header(ranked_csv.header_of(spark, str(f)), fixed.OUTPUT_COLUMNS) is None
    assert quality.header(["a"], fixed.OUTPUT_COLUMNS)


def test_incremental_ingest(spark, tmp_path):
    src, out, progress = tmp_path / "src", str(tmp_path / "out"), str(tmp_path / "p")
    src.mkdir()

    def run():
        ingest(spark, str(src), out, progress).awaitTermination()

    (src / "1.jsonl").write_text("\n".join(json.dumps(record(c, note=1)) for c in "abca") + "\nbroken\n")
    run()
    (src / "2.jsonl").write_text("\n".join(json.dumps(record(c)) for c in "cd") + "\n[]\n")
    run()
    run()
    for name in ("records", "features"):
        rows = spark.read.parquet(f"{out}/{name}")
        assert sorted(r.candidate_id for r in rows.select("candidate_id").collect()) == list("abcd"), name
    assert sorted(r.fault for r in spark.read.parquet(f"{out}/quarantine").collect()) == ["not an object", "not json"]


def test_lost_progress_adds_nothing_twice(spark, tmp_path):
    src, out = tmp_path / "src", str(tmp_path / "out")
    src.mkdir()
    (src / "1.jsonl").write_text("\n".join(json.dumps(record(c)) for c in "ab"))
    for progress in ("p1", "p2"):
        ingest(spark, str(src), out, str(tmp_path / progress)).awaitTermination()
    assert spark.read.parquet(f"{out}/records").count() == spark.read.parquet(f"{out}/features").count() == 2


def test_validate_file(spark, tmp_path):
    """One call on a file: header, fields and all checks."""
    from rankspark import constants
    from rankspark.config import RankConfig

    cand = spark.createDataFrame([("c1",), ("c2",), ("c3",)], "candidate_id string")
    shown = "candidate_id string, years double, notice_days double, github double, title string"
    facts = spark.createDataFrame([("c1", 7.0, 30.0, None, "Engineer"), ("c2", 3.0, None, None, "Analyst")], shown)
    skl = spark.createDataFrame([("c1", "Python3", 0)], "candidate_id string, skill string, pos int")
    good = tmp_path / "good.csv"
    good.write_text(",".join(constants.OUTPUT_COLUMNS) + '\nc1,1,1.000000,"7 years,\nPython3"\nc2,2,0.500000,3 years\n')
    cfg = RankConfig(top_n=2)
    assert quality.validate_file(spark, str(good), 1, cand, facts, skl, cfg).count() == 0
    bad = tmp_path / "bad.csv"
    bad.write_text("id,rank,score,reasoning\nc1,1,0.5,9 years\nc2,2\nc9,3,0.6,\n")
    errors = quality.validate_file(spark, str(bad), 1, cand, facts, skl, cfg)
    found = {(r.check, r.row_no) for r in errors.collect()}
    assert {("header", None), ("columns", 2), ("row_count", None), ("grounded", 1), ("existence", 3), ("reasoning_present", 3), ("monotonic", 3)} <= found


def test_scratch_is_cleared_and_clusters_name_a_folder(spark, tmp_path):
    from pathlib import Path
    from types import SimpleNamespace

    from rankspark import session

    kept = session.cut(spark.range(3))
    folder = Path(session.run_folder(spark).removeprefix("file:"))
    assert kept.count() == 3 and any(folder.iterdir())
    session.clear_scratch(spark)
    assert not folder.exists()
    conf = SimpleNamespace(get=lambda *a: None)
    context = SimpleNamespace(getConf=lambda: conf, getCheckpointDir=lambda: None, master="spark://host:7077")
    with pytest.raises(session.NoSharedFolder):
        session.shared_dir(SimpleNamespace(sparkContext=context, conf=conf))


def test_encoders_with_a_limited_input_get_all_pieces(spark):
    from rankspark.functions import vectors

    class Short:
        name, max_chars = "short", 10

        def __call__(self, texts):
            assert all(len(t) <= 10 for t in texts)
            import numpy as np

            return np.array([[t.count("a"), t.count("b"), len(t)] for t in texts], dtype=float)

    a, b = vectors.encode_whole(Short(), ["a" * 20 + "b" * 5, ""])
    assert a.tolist() == pytest.approx([8.0, 1.0, 9.0]) and b.tolist() == [0, 0, 0]
    rows = spark.createDataFrame([("x" * 2500 + " one",), ("x" * 2500 + " two",)], "text string")
    made = [r.embedding for r in vectors.encode(rows, "text", HashedTokens).collect()]
    assert made[0] != made[1]


def test_a_new_encoder_makes_new_vectors(spark, tmp_path):
    src, out = tmp_path / "in", str(tmp_path / "out")
    src.mkdir()
    (src / "a.jsonl").write_text(json.dumps(record("m1")))
    ingest(spark, str(src), out, str(tmp_path / "p1")).awaitTermination()
    ingest(spark, str(src), out, str(tmp_path / "p2")).awaitTermination()
    assert features.read(spark, f"{out}/features").count() == 1
    ingest(spark, str(src), out, str(tmp_path / "p3"), make_encoder=lambda: HashedTokens(dim=16)).awaitTermination()
    stored = features.read(spark, f"{out}/features")
    assert sorted(r.model for r in stored.collect()) == ["hashed-tokens-16", "hashed-tokens-384"]
    assert spark.read.parquet(f"{out}/records").count() == 1


class SmallInput(HashedTokens):
    """Refuses more text at once than a batch may have."""

    def __call__(self, texts):
        if sum(map(len, texts)) > (2 << 20):
            raise RuntimeError("too much text at once")
        return super().__call__(texts)


def test_encoder_gets_batches_bounded_in_bytes(spark):
    from rankspark.functions import vectors

    rows = [(k, None if k == 3 else f"w{k} " * 60_000) for k in range(24)]
    made = vectors.encode(spark.createDataFrame(rows, "k int, text string").coalesce(1), "text", SmallInput, normalize=False)
    got = {r.k: sum(r.embedding) for r in made.select("k", "embedding").collect()}
    assert got == {k: 0 if t is None else 60_000 for k, t in rows}


def test_encoder_remembers_few_words():
    e = HashedTokens()
    e([" ".join(f"w{k}" for k in range(at, at + 1000)) for at in range(0, 150_000, 1000)])
    assert len(e._buckets) <= 100_000
