"""Every query with oracle SQL equals DuckDB on the fixture tables (the driver's gate)."""

import pytest

from evalspark.plans import ORACLE, QUERIES
from tools.oracle_check import compare


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_duckdb(spark, duck, sf_dir, name):
    ok, msg = compare(spark, duck, name, sf_dir)
    assert ok, msg


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLE)


def test_entry_contract():
    import __spark_entry__ as e
    assert set(QUERIES) <= set(e.queries()) and set(ORACLE) <= set(e.oracle_sql())
