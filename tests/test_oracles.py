"""Every registered query with SQL gives the same rows as that SQL, on the smallest test tables."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from rankspark.plans.oracles import ORACLES
from rankspark.plans.queries import REGISTERED
from tests.compare import compare, connect

SF_DIR = "/root/testdata/sf0.001"
QUERIES = REGISTERED


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, con, name):
    ok, note = compare(spark, con, QUERIES[name], ORACLES[name], SF_DIR)
    assert ok, note


def test_every_query_is_covered():
    assert set(ORACLES) == set(QUERIES)
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["job_id", "candidate_id", "rank", "score", "reasoning"]
    assert df.count() > 0
