"""Property tests: set-based / streamed operators against small sequential models."""

import datetime as dt

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from evalspark.operators import changes, integrity, workflow

SETTINGS = settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))


def step_model(steps, changes_):
    """Sequential UpdateEvalStep over {id: [assignment, idx, status, date]}."""
    state = {s[0]: [s[1], s[2], s[3], None] for s in steps}
    for _seq, sid, status, date in sorted(changes_):
        if sid not in state:
            continue
        row = state[sid]
        row[2], row[3] = status, (dt.date.fromisoformat(date) if date else None)
        if status == 2 and not any(v[2] == 1 for v in state.values() if v[0] == row[0]):
            for v in state.values():
                if v[0] == row[0] and v[1] == row[1] + 1 and v[2] == 0:
                    v[2] = 1
    return sorted((k, v[2], v[3]) for k, v in state.items())


@st.composite
def step_cases(draw):
    steps, sid = [], 0
    for a in range(draw(st.integers(1, 4))):
        for _ in range(draw(st.integers(1, 4))):
            sid += 1
            steps.append((sid, a, draw(st.integers(1, 3)), draw(st.integers(0, 2))))
    n = draw(st.integers(0, 8))
    log = [(i, draw(st.integers(1, sid + 1)), draw(st.integers(0, 3)), draw(st.sampled_from(["", "2024-03-01"])))
           for i in range(n)]
    return steps, log


@SETTINGS
@given(step_cases())
def test_step_updates_match_sequential_model(spark, case):
    steps, log = case
    s = spark.createDataFrame(steps, "id long, assignment_id long, idx int, status int").withColumn(
        "evaluator_id", F.lit(1).cast("long"))
    users = spark.createDataFrame([(1, "u")], "id long, name string")
    c = spark.createDataFrame(log, "seq long, step_id long, status int, eval_date string")
    want = step_model(steps, log)
    got = sorted(tuple(r) for r in workflow.update_steps(s, c, users).select("id", "status", "eval_date").collect())
    assert got == want
    fold = sorted(tuple(r) for r in workflow.replay_all_step_changes(s, c, users)
                  .select("id", "status", "eval_date").collect())
    assert fold == want


def save_model(events):
    """Sequential lock: a stored 2 or an accepted valid submit refuses every later save."""
    locked, out = {}, {}
    for seq, key, status, stored, valid in sorted(events):
        if key not in locked:
            locked[key] = stored == 2
        ok = valid and not locked[key]
        out[seq] = ok
        if ok and status == 2:
            locked[key] = True
    return sorted(out.items())


@SETTINGS
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 2), st.booleans()), min_size=1, max_size=25),
       st.lists(st.sampled_from([None, 0, 1, 2]), min_size=4, max_size=4))
def test_save_lock_matches_sequential_model(spark, evs, stored):
    events = [(i, k, s, stored[k], v) for i, (k, s, v) in enumerate(evs)]
    df = spark.createDataFrame([(i, k, k, s, st_, v) for i, k, s, st_, v in events],
                               "seq long, user_id long, form_id long, status int, stored_status int, valid boolean")
    got = sorted(tuple(r) for r in workflow.resolve_save_log(df).select("seq", "accepted").collect())
    assert got == save_model(events)


@SETTINGS
@given(st.lists(st.tuples(st.integers(0, 5), st.integers(0, 100)), max_size=10),
       st.lists(st.tuples(st.integers(0, 20), st.integers(0, 5), st.integers(0, 100)), max_size=10))
def test_upsert_and_replace_idempotent(spark, base_rows, change_rows):
    base = spark.createDataFrame({k: v for k, v in base_rows}.items() if base_rows else [], "k long, v long")
    ch = spark.createDataFrame(change_rows, "seq long, k long, v long")
    once = changes.upsert(base, ch, ["k"])
    twice = changes.upsert(once, ch, ["k"])
    assert sorted(once.collect()) == sorted(twice.collect())
    last = {}
    for seq, k, v in sorted(change_rows):
        last[k] = v
    expect = dict(base_rows)
    expect.update(last)
    assert sorted(tuple(r) for r in once.collect()) == sorted(expect.items())
    parents = ch.select("k").distinct()
    rows_ = ch.select("k", "v")
    r1 = changes.replace_children(base, parents, rows_, "k")
    r2 = changes.replace_children(r1, parents, rows_, "k")
    assert sorted(r1.collect()) == sorted(r2.collect())


def test_cascade_leaves_no_orphans(spark):
    from evalspark.fixtures import fixture_tables
    from evalspark.plans.q_changes import _CASCADE_TABLES
    # at sf0.001 every user evaluates some surviving step, so nobody can be deleted; sf0.01 has both cases
    t = fixture_tables(spark, "/root/testdata/sf0.01", list(_CASCADE_TABLES) + ["user_deletes"])
    out, gone = changes.cascade_delete_users({k: t[k] for k in _CASCADE_TABLES}, t["user_deletes"])
    assert gone.count() > 0
    o = integrity.orphans(out)
    assert o.agg(F.sum("orphans")).first()[0] == integrity.orphans({k: t[k] for k in _CASCADE_TABLES}) \
        .agg(F.sum("orphans")).first()[0]


@settings(max_examples=10, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.integers(0, 400), st.integers(1, 9), st.integers(0, 10 ** 6), st.randoms())
def test_dense_ids_any_partitioning(spark, n, parts, start, rnd):
    keys = list(range(n))
    rnd.shuffle(keys)
    df = spark.createDataFrame([(k, k % 3) for k in keys], "k long, g long").repartition(parts)
    got = sorted(tuple(r) for r in changes.assign_ids(df, ["g", "k"], start).select("g", "k", "id").collect())
    want = [(g, k, start + i + 1) for i, (g, k) in enumerate(sorted((k % 3, k) for k in range(n)))]
    assert got == want
