"""Properties of physical plans that must hold at any size."""

from __future__ import annotations

import pytest

from rankspark.operators import facts
from rankspark.operators.recall import top_matches
from rankspark.plans.queries import CFG, REGISTERED
from rankspark.plans.views import Views
from rankspark.sources import candidates

SF = "/root/testdata/sf0.001"
CHEAP = [
    "scan_candidates", "quarantine_rows", "compose_text", "recall_topk_multi", "score_all_pairs", "experience_years",
    "multiplier_breakdown", "dedupe_first", "merge_features", "count_consistency", "cosine_scores", "text_similarity_topk",
    "drop_reason", "rank_candidates", "validation_report",
]


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", CHEAP)
def test_no_cross_joins(spark, name):
    plan = plan_of(REGISTERED[name](spark, SF))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_scans_read_only_what_they_need(spark):
    plan = plan_of(REGISTERED["sentinel_nulls"](spark, SF))
    assert "ReadSchema: struct<o_custkey:bigint,o_totalprice:double>" in plan
    plan = plan_of(REGISTERED["scan_valid_ids"](spark, SF))
    assert "props" not in plan.split("ReadSchema")[1]


def test_figures_are_aggregated_before_the_shuffle(spark):
    plan = plan_of(facts.career_figures(Views(spark, SF).roles, CFG))
    assert plan.count("Exchange") == 1 and "partial_sum" in plan.split("Exchange")[1]


def test_a_line_is_parsed_once(spark):
    plan = plan_of(candidates.records(Views(spark, SF).parsed))
    assert plan.count("parseJson") == 1


def test_an_encoder_runs_once(spark):
    v = Views(spark, SF)
    assert plan_of(REGISTERED["hashed_vectors"](spark, SF)).count("ArrowEvalPython") == 1
    plan = plan_of(top_matches(v.vec, v.jobs, CFG))
    assert plan.count("MapInArrow") == 1 and "WindowGroupLimit" in plan


@pytest.mark.parametrize("name", ["dedupe_first", "merge_features"])
def test_first_rows_are_found_without_sorting_whole_rows(spark, name):
    assert "SortAggregate" not in plan_of(REGISTERED[name](spark, SF))


def test_large_tables_are_narrowed_before_they_are_aggregated(spark):
    v = Views(spark, SF)
    made = facts.from_tables(v.vec, v.cand, v.roles, v.sig, v.skl, CFG)
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    # every one of the four tables meets the ids below its aggregation
    assert plan.count("LeftSemi") == 4
