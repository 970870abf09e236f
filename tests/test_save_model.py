"""W6 (set-based save log) against a pure-Python sequential model of SaveAll."""

import datetime as dt

from hypothesis import HealthCheck, Phase, given, settings
from hypothesis import strategies as st

from evalspark.operators import workflow

AS_OF = "2025-02-28 00:00:00"
DUES = ["", "  ", "2024-03-05", "2024-13-01", "bad", "2024-02-29"]


def parse(d):
    try:
        return dt.date.fromisoformat(d.strip()) if len(d.strip()) == 10 else None
    except ValueError:
        return None


def model(existing, events):
    """existing: {key: (id, status, due, n_kpis)}; events: (seq, key, status, due, ts, valid, n_kpis)."""
    a = {k: {"id": i, "status": s, "due": d, "kpis": n} for k, (i, s, d, n) in existing.items()}
    next_id = max([v["id"] for v in a.values()], default=0)
    for seq, key, status, due, ts, valid, n in sorted(events):
        if key in a:
            p = parse(due)
            if due.strip() and p:
                a[key]["due"] = p
        else:
            if due.strip():
                p = parse(due)
                if p is None:
                    continue  # insert fails, save fails
            else:
                p = (ts + dt.timedelta(hours=7)).date()
            next_id += 1
            a[key] = {"id": next_id, "status": 0, "due": p, "kpis": 0}
        row = a[key]
        if row["status"] == 2 or not valid:
            continue
        row["status"] = status if 0 <= status <= 2 else 0
        row["kpis"] = n
    return a


def doc(status, valid, n):
    items = [f'{{"idx":{i},"title":"k","max_score":5.0,"weight":60,"score":1.0}}' for i in range(n)]
    if not valid:  # one row the table refuses (weight outside 0..100)
        items.append('{"idx":9,"title":"bad","max_score":5.0,"weight":150,"score":1.0}')
    kpis = ",".join(items)
    return (f'{{"status":{status},"kpis":[{kpis}],"competency_scores":[],"time_attendance":{{"full_score":100.0,'
            f'"score":50.0}},"development_plan":[],"additional":{{"q1":"","q2":"","q3":"","q4":"","q5":""}}}}')


@st.composite
def cases(draw):
    keys = [(f, u) for f in (1, 2) for u in (1, 2)]
    existing = {}
    for i, k in enumerate(keys):
        if draw(st.booleans()):
            existing[k] = (10 + i, draw(st.integers(0, 2)), dt.date(2024, 1, 1 + i), draw(st.integers(0, 2)))
    n = draw(st.integers(1, 12))
    events = []
    for s in range(n):
        events.append((s, draw(st.sampled_from(keys)), draw(st.integers(0, 3)), draw(st.sampled_from(DUES)),
                       dt.datetime(2024, 1, 1, draw(st.integers(0, 23))), draw(st.booleans()) or draw(st.booleans()),
                       draw(st.integers(0, 2))))
    return existing, events


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck),
          phases=[Phase.explicit, Phase.reuse, Phase.generate])
@given(cases())
def test_save_log_matches_sequential_model(spark, case):
    existing, events = case
    want = model(existing, events)
    a = spark.createDataFrame([(i, k[0], k[1], s, d) for k, (i, s, d, _) in existing.items()],
                              "id long, form_id long, user_id long, status int, due_date date")
    kpi_rows = [(i * 100 + j, i, j, "t", 5.0, 10, 1.0) for k, (i, s, d, n) in existing.items() for j in range(n)]
    kpis = spark.createDataFrame(kpi_rows, "id long, assignment_id long, idx int, title string, max_score double, "
                                           "weight int, score double")
    log = spark.createDataFrame(
        [(s, ts, k[1], k[0], st_, due, doc(st_, v, n)) for s, k, st_, due, ts, v, n in events],
        "seq long, ts timestamp_ntz, user_id long, form_id long, status int, due_date string, doc string")
    empty = lambda schema: spark.createDataFrame([], schema)
    tables = {
        "eval_assignment": a, "eval_kpi_user": kpis,
        "eval_competency": spark.createDataFrame([(1, 5.0, 1.0)], "id long, max_score double, weight double"),
        "eval_competency_score": empty("id long, assignment_id long, comp_id long, score double, note string"),
        "eval_ta_score": empty("assignment_id long, full_score double, score double"),
        "eval_dev_plan": empty("id long, assignment_id long, idx int, content string, priority string, timing date, "
                               "remarks string"),
        "eval_additional": empty("assignment_id long, q1 string, q2 string, q3 string, q4 string, q5 string"),
        "eval_step": empty("id long, assignment_id long, idx int, evaluator_id long, status int"),
        "eval_form": spark.createDataFrame([(1,), (2,)], "id long"),
        "users": spark.createDataFrame([(1,), (2,)], "id long"),
    }
    out = workflow.apply_save_log(tables, log, AS_OF)
    got = {(r["form_id"], r["user_id"]): (r["assignment_id"], r["status"], r["due_date"], r["kpis"])
           for r in workflow.state_by_key(out, log).collect()}
    touched = {e[1] for e in events}
    expect = {k: (v["id"], v["status"], v["due"].isoformat(), v["kpis"]) for k, v in want.items() if k in touched}
    assert got == expect, (existing, sorted(events), got, expect)
