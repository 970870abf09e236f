"""Physical plan checks on tables read from Parquet (as in production, not through fixture views)."""

import pytest

from evalspark.fixtures import fixture_tables
from evalspark.operators import scoring
from evalspark.plans import QUERIES
from evalspark.plans.sqlparts import SUMMARY_VIEWS


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def stored(spark, sf_dir, tmp_path_factory):
    d = tmp_path_factory.mktemp("tables")
    t = fixture_tables(spark, sf_dir, list(SUMMARY_VIEWS))
    for n in SUMMARY_VIEWS:
        t[n].write.parquet(str(d / n))
    return {n: spark.read.parquet(str(d / n)) for n in SUMMARY_VIEWS}


def test_summary_plan_is_join_based(stored):
    p = plan(scoring.evaluation_summary(stored))
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython"):
        assert bad not in p, bad
    assert "BroadcastHashJoin" in p  # forms, competencies and band buckets are broadcast after a size check


def test_summary_scan_prunes_columns(stored):
    p = plan(scoring.evaluation_summary(stored))
    kpi_scan = [line for line in p.split("\n") if "ReadSchema" in line and "max_score" in line and "weight:int" in line]
    assert kpi_scan and "title" not in kpi_scan[0]


def test_lookup_pushes_filter(spark, sf_dir):
    p = plan(QUERIES["users_by_keys"](spark, sf_dir))
    assert "PushedFilters" in p
