"""Recall against brute force, whole runs, sentences and checks."""

from __future__ import annotations

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankspark.config import RankConfig
from rankspark.operators import quality, ranking, reasoning, rules
from rankspark.operators.recall import DuplicateJob, MissingVector, score_summary, top_matches
from rankspark.plans import ranking as runs
from rankspark.plans.queries import CFG as VIEW_CFG
from rankspark.plans.views import Views
from rankspark.session import tasks_of
from rankspark.sources import candidates, features
from rankspark.sources.features import ModelMismatch

VECTORS = "candidate_id string, embedding array<float>"


def brute_force(vecs, jobs, k, digits=6):
    out = set()
    for j, q in jobs:
        q = np.asarray(q, np.float32).astype(float)
        rows = []
        for cid, v in vecs:
            if v is None:
                continue
            v = np.asarray(v, np.float32).astype(float)
            n = np.linalg.norm(v) * np.linalg.norm(q)
            s = float(v @ q / n) if n else 0.0
            rows.append((-np.floor(s * 10**digits + 0.5) / 10**digits, cid))
        out |= {(j, cid, rank) for rank, (_, cid) in enumerate(sorted(rows)[:k], 1)}
    return out


@pytest.mark.parametrize("state, merge, bound", [(1_000_000, 50, 64), (20, 100, 64), (20, 2, 1), (1_000_000, 2, 1)])
def test_recall_is_exact(spark, state, merge, bound):
    rng = np.random.default_rng(7)
    base = rng.normal(size=(60, 8)).astype(np.float32)
    # a third of all vectors are copies of one, so many scores tie; one is zero, one missing
    vecs = [(f"c{i:03d}", base[i].tolist()) for i in range(60)] + [(f"h{i:03d}", base[0].tolist()) for i in range(40)]
    vecs += [("zero", [0.0] * 8), ("none", None)]
    jobs = [(j, (base[j] + (0 if j < 3 else 0.3)).tolist()) for j in range(12)]
    cfg = RankConfig(recall_k=10, score_digits=6, recall_state_rows=state, tasks_per_merge=merge, bound_from_tasks=bound)
    got = top_matches(
        spark.createDataFrame(vecs, VECTORS).repartition(7),
        spark.createDataFrame(jobs, "job_id long, job_vec array<float>"),
        cfg,
    )
    found = {(r.job_id, r.candidate_id, r.recall_rank) for r in got.collect()}
    assert found == brute_force(vecs, jobs, 10)


def test_recall_with_fewer_rows_than_k(spark):
    vecs = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0])], VECTORS)
    jobs = spark.createDataFrame([(1, [1.0, 0.0])], "job_id long, job_vec array<float>")
    assert [r.candidate_id for r in top_matches(vecs, jobs, RankConfig()).orderBy("recall_rank").collect()] == ["a", "b"]
    with pytest.raises(DuplicateJob):
        top_matches(vecs, jobs.unionByName(jobs), RankConfig())
    with pytest.raises(Exception, match="vectors of length 3"):
        top_matches(vecs, spark.createDataFrame([(1, [1.0, 0.0, 0.0])], jobs.schema), RankConfig()).collect()


SF = "/root/testdata/sf0.001"


def run_tables(spark, cfg, mix=None):
    v = Views(spark, SF)
    parts = [v.vec, v.jobs, v.cand, v.roles, v.sig, v.skl]
    if mix:
        parts = [p.repartition(mix).orderBy(F.rand(mix)) if i != 1 else p for i, p in enumerate(parts)]
    return runs.output(runs.explain_rows(runs.rank_tables(*parts, cfg), cfg))


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture(scope="module")
def whole_run(spark):
    return rows_of(run_tables(spark, VIEW_CFG))


def test_order_and_partitions_do_not_matter(spark, whole_run):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        assert rows_of(run_tables(spark, VIEW_CFG, mix=5)) == whole_run
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_joins_without_broadcasts_give_the_same(spark, whole_run):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert rows_of(run_tables(spark, VIEW_CFG)) == whole_run
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_equal_vectors_tie_by_id_with_the_default_rounding(spark):
    """The last bits of a product depend on the batch; the order of equal vectors must not."""
    rng = np.random.default_rng(3)
    same, other = rng.normal(size=384).tolist(), rng.normal(size=(300, 384))
    rows = [(f"e{i:04d}", same) for i in range(1000)] + [(f"o{i:04d}", x.tolist()) for i, x in enumerate(other)]
    vecs = spark.createDataFrame(rows, VECTORS)
    jobs = spark.createDataFrame([(j, rng.normal(size=384).tolist()) for j in range(3)], "job_id long, job_vec array<float>")
    cfg, before, seen = RankConfig(recall_k=700), spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"), []
    try:
        for parts, batch in ((1, "10000"), (3, "7"), (50, "64")):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
            seen.append({(r.job_id, r.candidate_id, r.recall_rank) for r in top_matches(vecs.repartition(parts), jobs, cfg).collect()})
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert seen[0] == seen[1] == seen[2]


def test_a_job_without_vector_is_an_error(spark):
    vecs = spark.createDataFrame([("a", [1.0, 0.0])], VECTORS)
    with pytest.raises(MissingVector):
        top_matches(vecs, spark.createDataFrame([(1, [1.0, 0.0]), (2, None)], "job_id long, job_vec array<float>"), RankConfig())


def test_vectors_of_two_models_are_refused(spark):
    vecs = spark.createDataFrame([("a", [1.0, 0.0], "one")], VECTORS + ", model string")
    jobs = spark.createDataFrame([(1, [1.0, 0.0], "two")], "job_id long, job_vec array<float>, job_model string")
    with pytest.raises(ModelMismatch):
        runs.recall(vecs, jobs, RankConfig())


def test_output_contract(whole_run):
    by_job = {}
    for job, cid, rank, score, why in whole_run:
        by_job.setdefault(job, []).append((rank, score, cid, why))
    assert len(by_job) == 40
    for rows in by_job.values():
        rows.sort()
        assert [r[0] for r in rows] == list(range(1, len(rows) + 1))
        scores = [r[1] for r in rows]
        assert scores[0] == 1.0 and all(0 <= s <= 1 for s in scores) and scores == sorted(scores, reverse=True)
        assert len({r[2] for r in rows}) == len({r[3] for r in rows}) == len(rows)
        assert all(0 < len(r[3]) <= 240 for r in rows)


def test_good_output_passes_all_checks(spark):
    v = Views(spark, SF)
    out = run_tables(spark, VIEW_CFG).withColumn("row_no", F.col("rank"))
    from rankspark.operators import facts

    known = facts.of_all(v.cand, v.roles, v.sig, v.skl, VIEW_CFG)
    errors = quality.report(out, v.job_texts, v.cand, known, v.skl, VIEW_CFG)
    assert quality.verdict(errors) == (True, 0, [])


def test_records_run(spark):
    def rec(i, **more):
        return {
            "candidate_id": f"CAND_{i:03d}",
            "profile": {"current_title": "ML Engineer", "years_of_experience": 4, "summary": "python kafka retrieval"},
            "skills": [{"name": "Python"}, {"name": "Go"}, {"name": "HR"}],
            "career_history": [{"company": "Acme", "start_date": "2018-01", "end_date": "2022-01", "duration_months": 40}],
            "signals": {"notice_period_days": 60, "recruiter_response_rate": 0.5, "interview_completion_rate": 1.0},
        } | more

    docs = [rec(i) for i in range(30)]
    docs.append(rec(90, profile={"current_title": "Civil Engineer", "summary": "python kafka retrieval"}))
    docs.append(rec(91, signals={"skill_assessment_scores": {"x": 95}}, profile={"years_of_experience": 0.2, "summary": "python"}))
    lines = spark.createDataFrame([(json.dumps(d), i) for i, d in enumerate(docs)], "value string, source_pos int")
    cfg = RankConfig(recall_k=100, top_n=30, score_digits=6)
    records = candidates.keep_first(candidates.records(candidates.parse(lines))).drop("source_pos")
    jobs = runs.embed_jobs(spark.createDataFrame([(1, "Python, kafka, HR-tech category")], "job_id long, jd_text string"))
    rows = runs.rank_candidates(records, features.build(records), jobs, cfg).orderBy("rank").collect()
    assert [r.candidate_id for r in rows] == [f"CAND_{i:03d}" for i in range(30)]
    assert len({r.reasoning for r in rows}) == 30
    said = [r.reasoning for r in rows]
    assert any("Python" in t for t in said) and all("60 days" in t for t in said)
    assert not any("Go," in t or "Go;" in t or "HR" in t for t in said)


REASON = (
    "job_id long, candidate_id string, rank int, tier string, title string, years double, github double, "
    "notice_days double, hopper boolean, named_skills array<string>, matched_set array<string>"
)


def sentences(spark, rows, cfg=RankConfig()):
    base = dict(job_id=1, tier="top", title=None, years=None, github=None, notice_days=None, hopper=False,
                named_skills=None, matched_set=None)
    made = [base | {"candidate_id": f"CAND_{i:05d}", "rank": i + 1} | r for i, r in enumerate(rows)]
    return reasoning.with_sentence(spark.createDataFrame(made, REASON), cfg)


def test_every_phrase_of_every_tier(spark):
    full = dict(title=" ML Engineer ", years=6.9, github=32.5, notice_days=45.7, hopper=True,
                named_skills=["RAG", "C++"], matched_set=["rag", "c++"])
    rows = sentences(spark, [full | {"tier": t} for t in ("top", "mid", "filler") for _ in range(40)]).collect()
    end = "; however, note the extended notice period of 45 days; candidate shows frequent job transitions."
    found = {r.reasoning.removesuffix(end) for r in rows}
    assert found == {
        "Exceptional fit: 6y as a ML Engineer with strong engagement signals, incl. RAG, C++, GitHub activity 32.50",
        "Top-tier match — 6y ML Engineer background; standout engagement, proven in RAG, C++, GitHub activity 32.50",
        "Outstanding candidate: deep ML Engineer experience (6y) directly matching the JD, incl. RAG, C++, GitHub activity 32.50",
        "Exceptional fit for this role with strong engagement signals, GitHub activity 32.50",
        "Solid ML Engineer background matching JD requirements, supported by 6y of experience, incl. RAG, C++, GitHub activity 32.50",
        "Good match: 6y as a ML Engineer, with relevant skills in RAG, C++, GitHub activity 32.50",
        "Relevant ML Engineer profile (6y) aligning with core JD needs, incl. RAG, C++, GitHub activity 32.50",
        "Solid background matching the JD requirements, GitHub activity 32.50",
        "Adjacent skills only — likely below cutoff but included as final filler given 6y of experience",
        "Borderline profile: partial overlap with the JD, retained as filler (6y as a ML Engineer)",
        "Peripheral match — included to complete the shortlist; limited direct JD alignment",
        "Adjacent skills only — likely below cutoff, included as final filler",
    }


def test_nothing_known_gives_a_general_phrase(spark):
    for r in sentences(spark, [{} for _ in range(30)]).collect():
        assert r.is_general and r.reasoning == r.general


def test_long_and_odd_values(spark):
    rows = sentences(
        spark,
        [
            dict(title="x" * 300, years=2.0),
            dict(title="Lead {years} [x]", years=2.0),
            dict(title="SDE-2", years=3.0, named_skills=["{title}"], matched_set=["{title}"]),
            dict(title="Dev [ML]", years=3.0),
        ],
    ).orderBy("rank").collect()
    assert all(len(r.reasoning) <= 240 for r in rows)
    assert not any(c in r.reasoning for r in rows for c in "{}")
    assert rows[0].is_general or "x" * 300 not in rows[0].reasoning
    assert "Dev [ML]" in rows[3].reasoning or rows[3].is_general


def test_collisions_are_resolved_in_rank_order(spark):
    rows = sentences(spark, [dict(tier="filler") for _ in range(60)] + [dict(tier="filler", title="Dev") for _ in range(30)])
    got = reasoning.unique_in_order(rows, RankConfig()).orderBy("rank").collect()
    texts = [r.reasoning for r in got]
    assert len(set(texts)) == 90
    assert sum("(ref CAND_" in t for t in texts) >= 60 - 24
    assert any("(Dev)" in t for t in texts)


def test_no_sentence_left_is_an_error(spark):
    rows = sentences(spark, [dict(candidate_id="same", tier="filler", rank=i) for i in range(1, 60)])
    with pytest.raises(Exception, match="NoUniqueSentence"):
        reasoning.unique_in_order(rows, RankConfig()).collect()


def test_grounding_needs_every_number(spark):
    rows = sentences(spark, [dict(title="SDE-2", years=3.0, notice_days=10.0)])
    test = lambda s: rows.select(reasoning.is_grounded(F.lit(s), F.col("allowed"))).first()[0]
    assert test("2 and 3 and 10") and not test("23") and not test("{x}")


def test_normalise(spark):
    def scores(*raw):
        df = spark.createDataFrame([(1, float(x)) for x in raw], "job_id long, raw_score double")
        return sorted((r.score for r in ranking.normalize(df).collect()), reverse=True)

    assert scores(0, 0) == [0.0, 0.0] and scores(-1, -2) == [0.0, 0.0]
    assert scores(5) == [1.0] and scores(4, 2, -1) == [1.0, 0.5, 0.0]


def test_funnel_counts_missing_records(spark):
    recalled = spark.createDataFrame([(1, "a"), (1, "b"), (1, "gone")], "job_id long, candidate_id string")
    marked = spark.createDataFrame([(1, "a", None), (1, "b", "x")], "job_id long, candidate_id string, drop_reason string")
    r = rules.funnel(recalled, marked, 5).first()
    assert (r.recalled, r.missing, r.dropped, r.kept, r.retained) == (3, 1, 1, 1, 1)


def test_ids_of_any_type(spark):
    """Text ids of jobs and whole-number ids of candidates, as the recall of other types."""
    vecs = spark.createDataFrame([(n, [float(n % 7), 1.0, float(n % 3)]) for n in range(100)], "candidate_id long, embedding array<double>")
    jobs = spark.createDataFrame([("one", [1.0, 2.0, 0.0]), ("two", [0.0, 0.0, 1.0])], "job_id string, job_vec array<double>")
    cfg = RankConfig(recall_k=5)
    got = sorted(tuple(r) for r in top_matches(vecs, jobs, cfg).collect())
    number = F.when(F.col("job_id") == "one", 1).otherwise(2).cast("long").alias("job_id")
    usual = top_matches(
        vecs.select(F.lpad(F.col("candidate_id").cast("string"), 3, "0").alias("candidate_id"), "embedding"), jobs.select(number, "job_vec"), cfg
    )
    assert got == sorted(({1: "one", 2: "two"}[r.job_id], int(r.candidate_id), r.sem_score, r.recall_rank) for r in usual.collect())
    assert [r.n_scored for r in score_summary(vecs, jobs, cfg).collect()] == [100, 100]
    assert top_matches(vecs, jobs.where("false"), cfg).count() == 0


def test_no_work_before_the_action(spark):
    """A plan with a join below is not run to count its partitions."""
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.sparkContext.setJobGroup("quiet", "quiet")
    try:
        left = spark.range(100).select(F.col("id").alias("candidate_id"))
        right = spark.range(100).select(F.col("id").alias("candidate_id"), F.array(F.lit(1.0), F.col("id").cast("double")).alias("embedding"))
        joined = left.join(right, "candidate_id")
        assert tasks_of(joined) == int(spark.conf.get("spark.sql.shuffle.partitions")) and tasks_of(left.repartition(3)) > 0
        assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("quiet")) == 0
        jobs = spark.createDataFrame([(1, [1.0, 1.0])], "job_id long, job_vec array<double>")
        assert top_matches(joined, jobs, RankConfig(recall_k=3)).count() == 3
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
