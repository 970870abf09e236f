"""The micro-batch stream ends in the same state as W6 over the whole log."""

from evalspark.fixtures import fixture_tables
from evalspark.operators.workflow import apply_save_log, state_by_key
from evalspark.plans import QUERIES
from evalspark.plans.q_streaming import stage_log_files
from evalspark.streaming import save_stream
from evalspark.streaming.save_stream import receive_save_log


def test_stream_equals_batch(spark, sf_dir):
    stream = sorted(tuple(r) for r in QUERIES["stream_save_state"](spark, sf_dir).collect())
    batch = sorted(tuple(r) for r in QUERIES["save_log_state"](spark, sf_dir).collect())
    assert stream == batch and len(stream) > 0


def test_stream_resumes_and_receives_each_save_once(spark, sf_dir, tmp_path):
    log = fixture_tables(spark, sf_dir, ["save_log"])["save_log"]
    d = str(tmp_path)
    early, late = log.where("seq % 2 = 0"), log.where("seq % 2 = 1")
    stage_log_files(early, f"{d}/log", 2)
    assert receive_save_log(spark, f"{d}/log", f"{d}/got", f"{d}/cp").count() == early.count()
    stage_log_files(late, f"{d}/log", 2)
    got = receive_save_log(spark, f"{d}/log", f"{d}/got", f"{d}/cp")
    assert got.count() == log.count() == got.select("seq").distinct().count()


def test_no_side_that_grows_is_broadcast(spark, sf_dir, tmp_path):
    """Sides with a row per save, pair or assignment are merged however small Catalyst takes them for; forms, users and comps beyond the bound too."""
    names = ["save_log", "eval_form", "users", "eval_competency", *save_stream.STATE_TABLES]
    t, d = fixture_tables(spark, sf_dir, names), str(tmp_path)
    spark.conf.set("evalspark.broadcast.maxRows", "1")
    try:
        stage_log_files(t["save_log"], f"{d}/log", 1)
        checked = save_stream.checked(spark.read.schema(save_stream.SAVE_LOG_SCHEMA).parquet(f"{d}/log"), t)
        save_stream.check_arrivals(spark, f"{d}/log", d, t)
        save_stream.keep_state(spark, d)
        after = save_stream.state_after(spark, d, t, "2025-02-28 00:00:00")
        for df in (checked, state_by_key(after, t["save_log"])):
            plan = df._jdf.queryExecution().executedPlan().toString().split("\n")
            joins = [x for x in plan if "BroadcastHashJoin" in x and "__pid" not in x]  # __pid: one row per partition
            assert not joins and any("SortMergeJoin" in x for x in plan), joins
    finally:
        spark.conf.unset("evalspark.broadcast.maxRows")


def test_a_batch_costs_what_it_brings(spark, sf_dir, tmp_path):
    names = ["odd_save_log", "eval_form", "users", "eval_competency", *save_stream.STATE_TABLES]
    t = fixture_tables(spark, sf_dir, names)
    log, d, as_of = t["odd_save_log"], str(tmp_path), "2025-02-28 00:00:00"
    parts = [log.where("seq % 10 < 7"), log.where("seq % 10 = 8"), log.where("seq % 10 in (7, 9)")]  # late saves come last
    for i, part in enumerate(parts):
        stage_log_files(part, f"{d}/log", 1)
        arrived = save_stream.check_arrivals(spark, f"{d}/log", d, t)
        assert [p["numInputRows"] for p in arrived.recentProgress if p["numInputRows"]] == [part.count()]
        kept = save_stream.keep_state(spark, d)
        new = sum(p["numInputRows"] for p in kept.recentProgress)
        assert new == spark.read.parquet(f"{d}/checked/{i}").count() <= part.count()
    got = sorted(map(tuple, state_by_key(save_stream.state_after(spark, d, t, as_of), log).collect()), key=repr)
    want = sorted(map(tuple, state_by_key(apply_save_log(t, log, as_of), log).collect()), key=repr)
    assert got == want and len(got) > 40
