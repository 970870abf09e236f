"""Branch counts recorded in FIXTURES.md section 4 (sf0.01), reproduced by the queries."""

from pyspark.sql import functions as F

from evalspark.plans import QUERIES

SF01 = "/root/testdata/sf0.01"


def test_summary_branch_counts(spark):
    s = QUERIES["evaluation_summary"](spark, SF01).cache()
    assert s.count() == 15000
    grades = {r[0]: r[1] for r in s.groupBy("grade").count().collect()}
    assert grades == {"A+": 147, "A": 229, "B": 414, "C": 924, "D": 2322, "F": 10028, "P": 446, "S": 252,
                      "N/A": 238}
    assert s.where(~F.col("has_ta")).count() == 1364
    assert s.where(F.col("total_pct") > 100).count() == 132
    assert s.where(F.col("comp_pct") > 100).count() == 1236
    assert s.where((F.col("form_id") == 1) & ~F.col("grade").isin("S", "N/A")).count() == 1241
    s.unpersist()


def test_save_log_counts(spark):
    acc = QUERIES["save_log_accepted"](spark, SF01)
    assert acc.where("accepted").count() == 1904
    assert acc.where("accepted and status = 2").count() == 385
    assert acc.where("not valid").count() == 909
    assert QUERIES["years_of_work"](spark, SF01).where("id = 463").first()["years_of_work"] == 8
