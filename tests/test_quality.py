"""Checks on ranked rows, run together in one pass."""

from __future__ import annotations

import random

import pytest

from rankspark.config import RankConfig
from rankspark.operators import quality

ROWS = "job_id bigint, row_no bigint, candidate_id string, rank string, score string, reasoning string"
SINGLE = [quality.ids, quality.contiguous, quality.score_bounds, quality.monotonic, quality.reasoning_present]


def faulty_rows(n_jobs: int, n: int) -> list[tuple]:
    """Rows with faults of every kind, often several in one row."""
    draw = random.Random(5)
    rows = []
    for job in range(n_jobs):
        for at in range(1, n + 1):
            rows.append(
                (
                    job,
                    at,
                    draw.choice([f"c{at}", f"c{at}", "c1", "", None]),
                    draw.choice([str(at), str(at), "x", None, "7"]),
                    draw.choice([f"{1 - at / 100}", "nan", "zero", None, "0.5", "1.5"]),
                    draw.choice([f"{at} years", " ", None, "x"]),
                )
            )
    return rows


def expected(rows: list[tuple]) -> set[tuple]:
    """The same errors, row by row in plain Python."""

    def number(s, kind):
        try:
            return kind(s)
        except (TypeError, ValueError):
            return None

    found, before, seen = set(), {}, set()
    for job, at, candidate, rank, score, reasoning in rows:
        value = number(score, float)
        if not candidate or (job, candidate) in seen:
            found.add(("ids", job, at))
        seen.add((job, candidate))
        if number(rank, int) != at:
            found.add(("contiguous", job, at))
        if value is None or not 0 <= value <= 1:
            found.add(("score_bounds", job, at))
        last = before.get(job)
        # nan stands above every number
        nan, last_nan = value is not None and value != value, last is not None and last != last
        if value is not None and last is not None and not last_nan and (nan or value > last + 1e-9):
            found.add(("monotonic", job, at))
        if value is not None:
            before[job] = value
        if not (reasoning or "").strip():
            found.add(("reasoning_present", job, at))
    return found


def keys(errors) -> list[tuple]:
    return [(r.check, r.job_id, r.row_no) for r in errors.collect()]


def test_one_pass_finds_what_each_check_finds(spark):
    plain = faulty_rows(4, 40)
    ranked = spark.createDataFrame(plain, ROWS).repartition(5)
    together = keys(quality.row_errors(ranked, quality.row_checks(ranked)))
    assert len(together) == len(set(together)) and set(together) == expected(plain)
    assert sorted(together) == sorted(k for check in SINGLE for k in keys(check(ranked)))


def test_row_checks_move_rows_once(spark):
    ranked = spark.createDataFrame(faulty_rows(2, 5), ROWS)
    plan = quality.row_errors(ranked, quality.row_checks(ranked))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Union" not in plan


@pytest.mark.parametrize("fields", ["", ", _corrupt string"])
def test_no_rows_give_no_row_errors(spark, fields):
    none = spark.createDataFrame([], ROWS + fields)
    assert quality.row_errors(none, quality.row_checks(none)).count() == 0


def test_a_report_makes_the_rows_and_reads_the_records_once(spark):
    """Counted by accumulators beside the rows: both inputs are computed a single time, whatever the number of checks."""
    made, read = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)

    def counted(seen):
        def run(batches):
            for b in batches:
                seen.add(b.num_rows)
                yield b

        return run

    rows = [(1, 1, "c1", "1", "0.9", "5 years"), (1, 2, "c2", "2", "0.8", "{gap}"), (1, 3, "c9", "3", "0.7", "x")]
    ranked = spark.createDataFrame(rows, ROWS).mapInArrow(counted(made), ROWS)
    cand = spark.createDataFrame([("c1",), ("c2",), ("c3",)], "candidate_id string").mapInArrow(counted(read), "candidate_id string")
    shown = "candidate_id string, years double, notice_days double, github double, title string"
    facts = spark.createDataFrame([("c1", 5.0, None, None, "Engineer"), ("c2", 3.0, None, None, "Analyst")], shown)
    skl = spark.createDataFrame([("c1", "Python", 0)], "candidate_id string, skill string, pos int")
    jobs = spark.createDataFrame([(1,), (2,)], "job_id bigint")
    errors = quality.report(ranked, jobs, cand, facts, skl, RankConfig(top_n=3))
    assert sorted(keys(errors), key=str) == [("existence", 1, 3), ("grounded", 1, 2), ("row_count", 2, None)]
    errors.count()
    assert (made.value, read.value) == (3, 3)
