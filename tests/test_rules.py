"""Boundary values of rules, factors and text functions on hand-made rows."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from rankspark import constants as fixed
from rankspark.config import RankConfig
from rankspark.functions import career, hashing, text
from rankspark.operators import facts, rules, scoring, skills

CFG = RankConfig()
FACTS_SCHEMA = (
    "candidate_id string, title string, stated_years double, years double, span_months bigint, tenure_months bigint, "
    "mean_tenure_years double, only_consulting boolean, notice_days double, response_rate double, "
    "completion_rate double, github double, has_expert boolean, has_ai_skill boolean"
)
BASE = dict(
    candidate_id="c", title="Data Engineer", stated_years=5.0, years=5.0, span_months=60, tenure_months=60,
    mean_tenure_years=3.0, only_consulting=False, notice_days=0.0, response_rate=0.0, completion_rate=0.0,
    github=None, has_expert=False, has_ai_skill=False,
)


def make_facts(spark, *rows):
    return spark.createDataFrame([BASE | r | {"candidate_id": str(i)} for i, r in enumerate(rows)], FACTS_SCHEMA)


def values(df, c):
    return [r[0] for r in df.orderBy(F.col("candidate_id").cast("int")).select(c).collect()]


def reasons(spark, *rows):
    return values(make_facts(spark, *rows), rules.drop_reason(CFG))


def texts(spark, c, *given):
    df = spark.createDataFrame([(i, g) for i, g in enumerate(given)], "i int, s string")
    return [r[0] for r in df.orderBy("i").select(c).collect()]


def test_overlap(spark):
    got = reasons(
        spark,
        dict(tenure_months=90), dict(tenure_months=91),
        dict(span_months=0, tenure_months=1, stated_years=0.0), dict(span_months=0, tenure_months=2),
        dict(span_months=-5, tenure_months=2), dict(span_months=None, tenure_months=999), dict(tenure_months=None),
    )
    o = "overlapping_timeline"
    assert got == [None, o, None, o, o, None, None]


def test_inflation(spark):
    got = reasons(
        spark,
        dict(stated_years=10.0), dict(stated_years=10.1), dict(stated_years=0.0, years=0.0),
        dict(stated_years=-1.0), dict(stated_years=None), dict(stated_years=99.0, span_months=None),
    )
    assert got == [None, "experience_inflation", None, None, None, None]


def test_fake_expert(spark):
    got = reasons(
        spark,
        dict(has_expert=True, years=0.49, stated_years=0.49), dict(has_expert=True, years=0.5, stated_years=0.5),
        dict(has_expert=True, years=None, stated_years=None), dict(has_expert=False, years=0.0, stated_years=0.0),
    )
    assert got == ["fake_expert", None, None, None]


def test_titles(spark):
    titles = ["Salesforce Dev", "sales lead", "HR-tech lead", "Threat Analyst", " ", None, "Civil Engineer", "DevOps"]
    got = reasons(spark, *[dict(title=t, has_ai_skill=True) for t in titles])
    d, m = "domain_mismatch", "title_mismatch"
    assert got == [m, d, d, m, None, None, d, None]
    assert reasons(spark, dict(title="Threat Analyst")) == [None]


def test_first_rule_wins(spark):
    row = dict(title="Nurse", tenure_months=999, stated_years=99.0, has_expert=True, years=0.1)
    assert reasons(spark, row) == ["domain_mismatch"]


@pytest.mark.parametrize(
    "days, factor",
    [(0, 1), (30, 1), (30.5, 1), (31, 0.85), (60, 0.85), (61, 0.7), (90, 0.7), (180, 0.25), (210, 0.1), (211, 0),
     (999, 0), (None, 1), (-5, 1)],
)
def test_notice(spark, days, factor):
    df = make_facts(spark, dict(notice_days=None if days is None else float(days)))
    assert values(df, scoring.notice(CFG))[0] == pytest.approx(factor)


def test_hopper_and_consulting(spark):
    df = make_facts(
        spark, dict(mean_tenure_years=1.5), dict(mean_tenure_years=1.4999), dict(mean_tenure_years=None),
        dict(only_consulting=True), dict(only_consulting=None),
    )
    assert values(df, scoring.hopper(CFG)) == [1.0, 0.85, 1.0, 1.0, 1.0]
    assert values(df, scoring.consulting(CFG)) == [1.0, 1.0, 1.0, 0.1, 1.0]


@pytest.mark.parametrize("r, c, want", [(-1, 1, 1), (0, 1, 1), (0.5, 0.5, 1.25), (1, 1, 2), (1.7, 1, 2), (None, 1, 1)])
def test_engagement(spark, r, c, want):
    df = make_facts(spark, dict(response_rate=None if r is None else float(r), completion_rate=float(c)))
    assert values(df, scoring.engagement(CFG))[0] == pytest.approx(want)


def test_month_index(spark):
    got = texts(
        spark, career.month_index(F.col("s")),
        "2020-01", "2020-12-31", " 2020-1", "2020-13", "2020-00", "2020", None, "x2020-01", "2020-19", "2020-1x", "2020-123",
    )
    y = 2020 * 12
    assert got == [y, y + 11, y, None, None, None, None, None, None, y, y + 11]


def test_whole_words(spark):
    job = F.lit("senior category c++, robust go-lang rag. hr a.b")
    terms = ["go", "c++", "rust", "rag", "", "a.b", "axb", "c"]
    assert texts(spark, text.has_whole_word(job, F.col("s")), *terms) == [True, True, False, True, False, True, False, True]


def test_denied_skills(spark):
    job = F.lit("marketing, hr and go")
    assert texts(spark, skills.is_match(F.lower("s"), job, CFG), "Marketing", "HR", "GO") == [False, False, True]


def test_tidy_and_strip(spark):
    assert texts(spark, text.tidy(F.col("s")), "a  b ,c (  d ) , , ; e .", "x ( y", "  a b ") == [
        "a b,c (d); e.", "x (y", "a b",
    ]
    assert texts(spark, text.present(F.col("s")), "　\t", " a ", None) == [None, "a", None]


def test_stable_pick(spark):
    import hashlib

    ids = [f"CAND_{i:07d}" for i in range(50)]
    want = [int.from_bytes(hashlib.sha256(i.encode()).digest()[:8], "big") % 24 for i in ids]
    assert texts(spark, hashing.stable_pick(F.col("s"), 24), *ids) == want


RECORD_SCHEMA = (
    "candidate_id string, profile struct<headline: string, current_title: string, current_company: string, "
    "current_industry: string, summary: string, years_of_experience: double>, skills array<struct<name: string>>, "
    "career_history array<struct<company: string, title: string, description: string, start_date: string, "
    "end_date: string, duration_months: double>>, education array<struct<field_of_study: string, degree: string>>, "
    "signals struct<recruiter_response_rate: double, interview_completion_rate: double, github_activity_score: double, "
    "notice_period_days: double, skill_assessment_scores: map<string, double>>, notice_period_days double"
)


def test_facts_of_records_and_tables_agree(spark):
    roles = [
        ("a", "TCS", "2015-01", "2016-01", 12.0), ("a", " infosys ", None, "2017-01", 30.9), ("a", None, "2018-05", None, -1.0),
        ("b", "Acme", "2019-03", None, 10.0), ("b", "TCS", "2018-01", "2017-01", 7.0),
        ("c", "", None, None, None),
    ]
    table = spark.createDataFrame(
        roles, "candidate_id string, company string, start_date string, end_date string, duration_months double"
    )
    by_id = {}
    for cid, *r in roles:
        by_id.setdefault(cid, []).append((r[0], None, None, r[1], r[2], r[3]))
    recs = spark.createDataFrame(
        [(cid, None, None, hist, None, None, None) for cid, hist in by_id.items()], RECORD_SCHEMA
    )
    names = ["candidate_id", "span_months", "tenure_months", "mean_tenure_years", "only_consulting"]
    a = {tuple(r) for r in facts.from_records(recs, CFG).select(*names).collect()}
    b = {tuple(r) for r in facts.career_figures(table, CFG).select(*names).collect()}
    assert a == b
    got = {r[0]: r[1:] for r in b}
    assert got["a"][:2] == (40, 42) and got["a"][3] is True
    assert got["b"][:2] == (24, 17) and got["b"][3] is False
    assert got["c"] == (None, None, None, None)


def test_fixed_values_are_whole():
    assert len(fixed.GENERAL_PHRASES) == len(set(fixed.GENERAL_PHRASES)) == 24
    assert len(fixed.OFF_DOMAIN_TITLE_WORDS) == 27
    assert {len(p) for p in fixed.TIER_PATTERNS.values()} == {4}


def test_sizes_must_be_positive():
    for bad in (dict(recall_k=0), dict(top_n=-1)):
        with pytest.raises(ValueError):
            RankConfig(**bad)


ODD_SKILLS = [
    "c++", "c#", ".net", "c", "r", "go", "node.js", "asp.net", "++", "a", "machine learning", "日本", "é", "é日", "tf-idf",
    "o'reilly", "<b>", "\\d", "x" * 50, "one two three four five six", "one two three four five sixty", "c++ and c# and .net core 8", "-",
]


@pytest.mark.parametrize("longest", [1, 3, 8])
def test_skills_meet_job_texts_by_equality(spark, longest):
    """The same pairs as a pattern per skill and text."""
    rng = random.Random(longest)
    parts = [*ODD_SKILLS, " ", ", ", "(", ")", ".", "\n", "1", "C++11", "gopher", "Asp.Net", "R&D", "x", "+", "HR", "marketing"]
    jobs = [(n, "".join(rng.choice(parts) + rng.choice(["", " ", ","]) for _ in range(rng.randrange(1, 30)))) for n in range(150)]
    jobs += [(900, ""), (901, "c++"), (902, ".net"), (903, None), (904, "one two three four five six")]
    cfg = RankConfig(longest_skill_run=longest)
    texts = spark.createDataFrame(jobs, "job_id long, jd_text string")
    held = spark.createDataFrame([(s,) for s in [*ODD_SKILLS, "hr", "marketing", "", "none such"]], "skill_lower string")
    got = {(r.job_id, r.skill_lower) for r in skills.named_by_jobs(held, texts, cfg).collect()}

    def stands(s, t):
        return re.search(r"(?<![a-z0-9])" + re.escape(s) + r"(?![a-z0-9])", t.lower())

    names = [s for s in ODD_SKILLS if s not in cfg.denied_skills]
    assert got == {(n, s) for n, t in jobs if t for s in names if stands(s, t)}
    assert len(got) > 300


def test_no_text_travels_with_skills(spark):
    """Job texts are cut into runs before any exchange; only the rare long skills meet a text."""
    pairs = spark.createDataFrame([(1, "a")], "job_id long, candidate_id string")
    jobs = spark.createDataFrame([(1, "Go and C++")], "job_id long, jd_text string")
    skl = spark.createDataFrame([("a", " C++ ", 2), ("a", "Go", 1), ("a", "go", 3), ("a", None, 4), ("b", "Go", 1)], "candidate_id string, skill string, pos int")
    assert sorted(tuple(r) for r in skills.matched_rows(pairs, jobs, skl, CFG).collect()) == [(1, "a", "C++", 2), (1, "a", "Go", 1), (1, "a", "go", 3)]
    held = skl.select(F.lower("skill").alias("skill_lower"))
    plan = skills.word_runs(jobs, 8).join(held, F.col("run") == F.col("skill_lower"))._jdf.queryExecution().optimizedPlan().toString()
    assert "RLIKE(skill" not in plan and "jd_text" not in plan.split("Join")[1].split("Aggregate")[0]


@pytest.mark.parametrize("digits", [0, 2, 6, 7])
def test_decimals_are_those_of_the_binary_value(spark, digits):
    rng = random.Random(digits)
    odd = [0.1234565, 0.5, 1.5, 2.5, 0.0000005, -0.0, 0.0, 1 / 128, 3 / 128, 127 / 128, 0.9999995, 0.99999949999, 1e-320, 5e-7, float("nan")]
    odd += [float("inf"), -float("inf"), 2.0**52 + 0.5, 2.0**53 + 2, -1.0000005, 123456789.1234565, 9.2e18, -0.4999999, 0.125, 0.375]
    odd += [k / 128 for k in range(300)] + [k * 5e-7 for k in range(300)] + [k * 0.005 for k in range(300)]
    made = [rng.random() for _ in range(60_000)] + [rng.uniform(-1e6, 1e6) for _ in range(20_000)]
    made += [round(rng.random(), 7) for _ in range(20_000)] + [rng.random() * 10.0 ** rng.randrange(-12, 15) for _ in range(10_000)]
    values_ = odd + made
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values_)] + [(-1, None)], "k long, v double").repartition(8)
    got = {r.k: r.s for r in df.select("k", text.fixed_decimals(F.col("v"), digits).alias("s")).collect()}
    assert got.pop(-1) is None
    wrong = [(v, got[k], f"{v:.{digits}f}") for k, v in enumerate(values_) if got[k] != f"{v:.{digits}f}"]
    assert not wrong, wrong[:5]
