"""Scalar rules F1-F14 and the broadcast size check."""

import datetime as dt

from pyspark.sql import functions as F

from evalspark.functions import scalars as sc
from evalspark.operators.common import counted_broadcast, row_width, sized_broadcast


def test_text_and_date_rules(spark):
    df = spark.createDataFrame([(" ",), ("",), (None,), ("2024-02-29",), ("2023-02-29",), ("x",)], "s string")
    got = df.select(sc.blank_to_null("s").alias("a"), sc.is_blank("s").alias("b"),
                    sc.try_date("s").alias("c"), sc.iso_date(sc.try_date("s")).alias("d")).collect()
    assert [tuple(r) for r in got] == [
        (" ", True, None, None), (None, True, None, None), (None, True, None, None),
        ("2024-02-29", False, dt.date(2024, 2, 29), "2024-02-29"), ("2023-02-29", False, None, None),
        ("x", False, None, None)]


def test_atoi_and_status(spark):
    df = spark.createDataFrame([("12",), ("+7",), ("-3",), (" 5",), ("1.5",), ("",), (None,), ("99999999999",)],
                               "s string")
    assert [r[0] for r in df.select(sc.int_or_zero("s")).collect()] == [12, 7, -3, 0, 0, 0, 0, 0]
    st = spark.createDataFrame([(-1,), (0,), (1,), (2,), (3,), (None,)], "s int")
    assert [r[0] for r in st.select(sc.normalize_status("s")).collect()] == [0, 0, 1, 2, 0, 0]


def test_bangkok_day_and_page_clamps(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 1, 16, 59),), (dt.datetime(2024, 1, 1, 17, 0),)],
                               "ts timestamp_ntz")
    assert [r[0] for r in df.select(sc.local_date("ts")).collect()] == [dt.date(2024, 1, 1), dt.date(2024, 1, 2)]
    assert sc.clamp_page(0, -5) == (50, 0)
    assert sc.clamp_page(201, 3) == (50, 3)
    assert sc.clamp_page(200, 0) == (200, 0)


def test_weight_fraction(spark):
    df = spark.createDataFrame([(None,), (0.7,), (1.0,), (1.0001,), (70.0,)], "w double")
    assert [round(r[0], 6) for r in df.select(sc.weight_fraction("w")).collect()] == [0.0, 0.7, 1.0, 0.010001, 0.7]


def test_sized_broadcast_respects_bounds(spark):
    small = spark.range(10)
    big_a = spark.range(100000).withColumnRenamed("id", "k")
    join_small = big_a.join(sized_broadcast(small.withColumnRenamed("id", "k")), "k")
    assert "BroadcastHashJoin" in join_small._jdf.queryExecution().executedPlan().toString()
    exploded = small.select(F.explode(F.sequence(F.lit(0), F.col("id"))).alias("k"))
    assert sized_broadcast(exploded) is exploded  # an explode is not in the estimate: left to AQE
    spark.conf.set("evalspark.broadcast.maxRows", "5")
    try:
        assert counted_broadcast(small) is small  # over the row bound: returned unchanged (no hint)
    finally:
        spark.conf.unset("evalspark.broadcast.maxRows")
    assert row_width(spark.range(1).schema) == 16


def test_scale_conf_bounds():
    from evalspark.session import scale_conf
    big = scale_conf(100 * 10 ** 12)
    assert big["spark.sql.shuffle.partitions"] == "372530"
    assert scale_conf(10 ** 9)["spark.sql.shuffle.partitions"] == "200"


def test_sized_broadcast_skips_count_for_huge_estimates(spark):
    from evalspark.operators.common import _estimated_bytes
    huge = spark.range(10 ** 13)  # Catalyst estimates 80 TB: returned as is, no count job
    assert _estimated_bytes(huge) >= 8 * 10 ** 13
    jobs_before = spark.sparkContext.statusTracker().getJobIdsForGroup(None)
    assert sized_broadcast(huge) is huge
    assert spark.sparkContext.statusTracker().getJobIdsForGroup(None) == jobs_before
