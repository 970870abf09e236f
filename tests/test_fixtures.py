from evalspark.fixtures import FIXTURE_COLUMNS, fixture_tables


def test_fixture_columns_match_views(spark, sf_dir):
    t = fixture_tables(spark, sf_dir, list(FIXTURE_COLUMNS))
    for name, cols in FIXTURE_COLUMNS.items():
        assert tuple(t[name].columns) == cols, name


def test_entry_smoke(spark):
    import __spark_entry__ as e
    df = e.entry(spark)
    assert df.count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
