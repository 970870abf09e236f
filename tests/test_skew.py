"""Hot keys: a third of all rows on one key must still give exact results, with partial aggregation."""

from pyspark.sql import functions as F

from evalspark.fixtures import fixture_tables
from evalspark.operators import scoring, workflow

SF01 = "/root/testdata/sf0.01"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_hot_assignment_kpi_percent(spark):
    k = fixture_tables(spark, SF01, ["eval_kpi_user"])["eval_kpi_user"]
    hot = k.agg(F.min("assignment_id")).first()[0]
    skewed = k.withColumn("assignment_id", F.when(F.col("id") % 3 == 0, F.lit(hot)).otherwise(F.col("assignment_id")))
    got = {r[0]: round(r[1], 6) for r in scoring.kpi_percent(skewed).collect()}
    pdf = skewed.select("assignment_id", "max_score", "score", "weight").toPandas().astype(
        {"max_score": float, "score": float, "weight": float})
    pdf["num"] = (pdf.score / pdf.max_score * pdf.weight).where(pdf.max_score > 0, 0.0)
    g = pdf.groupby("assignment_id").agg(num=("num", "sum"), den=("weight", "sum"))
    want = {a: round((r.num / r.den * 100.0) if r.den else 0.0, 6) for a, r in g.iterrows()}
    assert got.keys() == want.keys()
    assert all(abs(got[a] - want[a]) < 1e-6 for a in got)
    assert (skewed.where(F.col("assignment_id") == hot).count() * 3) >= skewed.count() * 0.99
    plan = _plan(scoring.kpi_percent(skewed))
    assert "partial_sum" in plan  # map-side partial aggregation before the shuffle


def test_hot_key_save_log(spark):
    # every third request goes to one (user, form): the lock is still a per-key min, not a window
    ev = spark.range(0, 3000).select(
        F.col("id").alias("seq"),
        F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") % 50).alias("user_id"),
        F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") % 7).alias("form_id"),
        ((F.col("id") % 5 == 4).cast("int") * 2).alias("status"),
        F.lit(None).cast("int").alias("stored_status"),
        (F.col("id") % 11 != 0).alias("valid"))
    res = workflow.resolve_save_log(ev)
    assert "Window" not in _plan(res)
    rows = sorted(res.select("seq", "user_id", "form_id", "status", "valid", "accepted").collect())
    locked = {}
    for seq, u, f, st, valid, acc in rows:
        key = (u, f)
        expect = bool(valid) and not locked.get(key, False)
        assert acc == expect, seq
        if expect and st == 2:
            locked[key] = True
