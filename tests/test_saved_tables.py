"""A small log rewrites the partitions of what it changed and no other file."""

import os

from pyspark.sql import functions as F
from test_refusals import AS_OF, GOOD, state

from evalspark.operators import workflow
from evalspark.sources.tables import KEY_PART, load_by_key, save_by_key, save_touched

PARTS = 8


def files(path):
    return {(d[len(path):], f): os.stat(f"{d}/{f}").st_mtime_ns for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def test_only_touched_partitions_are_written(spark, tmp_path):
    path = f"{tmp_path}/t"
    base = spark.range(200).selectExpr("id", "id * 2 AS v")
    save_by_key(base, path, "id", PARTS)
    before, now = files(path), load_by_key(spark, path)
    new = now.selectExpr("id", "IF(id IN (3, 4), -1, v) AS v").where("id <> 5")  # computed from the table itself
    written = save_touched(new, spark.createDataFrame([(3,), (4,), (5,)], "id long"), path, "id", PARTS)
    after = files(path)
    kept = [f for f in before if f in after and before[f] == after[f]]
    assert written <= 3 and len({d for d, _ in kept}) == len({d for d, _ in before}) - written
    got = {r["id"]: r["v"] for r in load_by_key(spark, path).collect()}
    assert got == {i: -1 if i in (3, 4) else 2 * i for i in range(200) if i != 5}


def test_an_emptied_partition_goes(spark, tmp_path):
    path = f"{tmp_path}/t"
    save_by_key(spark.range(40), path, "id", PARTS)
    part = spark.read.parquet(path).where("id = 7").first()[KEY_PART]
    gone = spark.read.parquet(path).where(f"{KEY_PART} = {part}").select("id")
    ids = [r["id"] for r in gone.collect()]
    rest = load_by_key(spark, path).where(~F.col("id").isin(ids))
    save_touched(rest, spark.createDataFrame([(i,) for i in ids], "id long"), path, "id", PARTS)
    assert not os.path.exists(f"{path}/{KEY_PART}={part}") and load_by_key(spark, path).count() == 40 - len(ids)


def test_a_save_log_of_one_user_leaves_the_others_files(spark, tmp_path):
    t = state(spark)
    paths = {n: f"{tmp_path}/{n}" for n in workflow.SAVED_BY}
    for n, key in workflow.SAVED_BY.items():
        save_by_key(t[n], paths[n], key, PARTS)
    stored = {**t, **{n: load_by_key(spark, p) for n, p in paths.items() if any(files(p))}}
    before = files(paths["eval_assignment"])
    log = spark.createDataFrame([(1, None, 1, 7, "", GOOD)], "seq long, ts timestamp_ntz, user_id long, form_id long, due_date string, doc string")
    want = {n: sorted(map(str, workflow.apply_save_log(stored, log, AS_OF)[n].select(*stored[n].columns).collect())) for n in ("eval_kpi_user", "eval_assignment")}
    written = workflow.write_after_saves(workflow.apply_save_log(stored, log, AS_OF), {n: paths[n] for n in want}, PARTS)
    assert written == {"eval_kpi_user": 1, "eval_assignment": 1}
    assert {n: sorted(map(str, load_by_key(spark, paths[n]).select(*stored[n].columns).collect())) for n in want} == want
    assert sum(before[f] == files(paths["eval_assignment"]).get(f) for f in before) >= 1
