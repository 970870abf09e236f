"""Golden micro-cases on inline rows for edges the fixture views cannot reach."""

import datetime as dt

from pyspark.sql import functions as F

from evalspark.functions import scalars as sc
from evalspark.operators import changes, grading, scoring, workflow

D = dt.date


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect()) if cols else sorted(tuple(r) for r in df.collect())


def test_kpi_percent_edges(spark):
    k = spark.createDataFrame(
        [(1, 5.0, 5.0, 50), (1, 0.0, 3.0, 50),      # max 0 adds nothing but keeps its weight
         (2, 5.0, 3.0, 0),                           # sum(weight) 0 -> NULL -> 0
         (3, 5.0, 10.0, 100)],                       # above max -> over 100 %
        "assignment_id long, max_score double, score double, weight int")
    got = dict(rows(scoring.kpi_percent(k), "assignment_id", "kpi_pct"))
    assert got == {1: 50.0, 2: 0.0, 3: 200.0}


def test_competency_weight_units(spark):
    comps = spark.createDataFrame([(1, 5.0, 1.0), (2, 5.0, 1.0001), (3, 5.0, 0.7), (4, 5.0, 70.0), (5, 0.0, 50.0)],
                                  "id long, max_score double, weight double")
    sc_ = spark.createDataFrame([(10, 1, 5.0), (11, 2, 5.0), (12, 3, 5.0), (13, 4, 5.0), (14, 5, 5.0)],
                                "assignment_id long, comp_id long, score double")
    got = {a: round(p, 6) for a, p in rows(scoring.competency_percent(sc_, comps), "assignment_id", "comp_pct")}
    assert got == {10: 100.0, 11: 1.0001, 12: 70.0, 13: 70.0, 14: 0.0}


def test_attendance_missing_and_zero_full(spark):
    a = spark.createDataFrame([(1, 7, 1), (2, 7, 1)], "id long, form_id long, user_id long")
    f = spark.createDataFrame([(7, 0, 0, 100)], "id long, kpi_weight int, comp_weight int, ta_weight int")
    empty_k = spark.createDataFrame([], "assignment_id long, max_score double, score double, weight int")
    empty_s = spark.createDataFrame([], "assignment_id long, comp_id long, score double")
    comps = spark.createDataFrame([], "id long, max_score double, weight double")
    ta = spark.createDataFrame([(2, 0.0, 50.0)], "assignment_id long, full_score double, score double")
    got = rows(scoring.score_assignments(a, f, empty_k, empty_s, comps, ta), "assignment_id", "ta_pct", "has_ta")
    assert got == [(1, 0.0, False), (2, 0.0, True)]


def test_grade_bands(spark):
    bands = spark.createDataFrame(
        [(1, None, "A+", 90.0, 100.0), (2, None, "A", 80.0, 100.0), (3, None, "B", 70.0, 79.99),
         (4, None, "C", 50.0, 69.99), (5, 5, "S", 55.0, 100.0), (6, 6, "X", 10.0, 20.0),
         (7, None, "T1", 30.0, 40.0), (8, None, "T2", 30.0, 40.0)],
        "id long, form_id long, grade string, min_pct double, max_pct double")
    scored = spark.createDataFrame(
        [(1, 1, 95.0),     # overlap A+/A -> higher min wins
         (2, 1, 79.995),   # gap between 79.99 and 80 -> N/A
         (3, 5, 60.0),     # own form band first
         (4, 5, 52.0),     # own set has no hit -> default set
         (5, 6, 75.0),     # own band misses -> default B
         (6, 1, 35.0),     # tie on min -> lower band id
         (7, 1, 150.0)],   # above every band
        "assignment_id long, form_id long, total_pct double")
    got = rows(grading.assign_grade(scored, bands), "assignment_id", "grade", "grade_min", "grade_max")
    assert got == [(1, "A+", 90.0, 100.0), (2, "N/A", 0.0, 0.0), (3, "S", 55.0, 100.0), (4, "C", 50.0, 69.99),
                   (5, "B", 70.0, 79.99), (6, "T1", 30.0, 40.0), (7, "N/A", 0.0, 0.0)]


def test_years_of_work_feb29(spark):
    df = spark.createDataFrame(
        [(1, D(2016, 2, 29), None, D(2025, 2, 28)), (2, D(2016, 2, 29), None, D(2025, 3, 1)),
         (3, D(2016, 2, 29), None, D(2024, 2, 29)), (4, D(2016, 2, 29), None, D(2024, 2, 28)),
         (5, None, D(2020, 6, 1), D(2025, 6, 1)), (6, None, None, D(2025, 1, 1)),
         (7, D(2030, 1, 1), D(2010, 1, 1), D(2025, 1, 1))],
        "id int, confirm_date date, start_date date, as_of date")
    got = dict(rows(df.select("id", sc.years_of_work("confirm_date", "start_date", F.col("as_of")).alias("y"))))
    assert got == {1: 8, 2: 9, 3: 8, 4: 7, 5: 5, 6: 0, 7: 0}


def test_blank_due_uses_bangkok_day(spark):
    a = spark.createDataFrame([(1, 0, 0, 2, D(2024, 1, 1))], "id long, form_id long, user_id long, status int, due_date date")
    req = spark.createDataFrame(
        [(1, dt.datetime(2024, 1, 1, 20, 0), 9, 9, ""),       # new pair, blank -> Bangkok date 2024-01-02
         (2, dt.datetime(2024, 1, 1, 1, 0), 0, 0, "bad"),     # existing: bad date keeps old
         (3, dt.datetime(2024, 1, 5, 1, 0), 8, 8, "nope"),    # new pair, bad date: insert fails
         (4, dt.datetime(2024, 1, 6, 1, 0), 8, 8, "2024-05-05")],
        "seq long, ts timestamp_ntz, form_id long, user_id long, due_date string")
    got = rows(changes.ensure_assignments(a, req, "2025-02-28 00:00:00"), "id", "form_id", "due_date")
    assert got == [(1, 0, D(2024, 1, 1)), (2, 9, D(2024, 1, 2)), (3, 8, D(2024, 5, 5))]


def test_advance_steps_edges(spark):
    steps = spark.createDataFrame(
        [(1, 10, 1, 0), (2, 10, 2, 0),                      # no active: idx 1 opens
         (3, 11, 1, 1), (4, 11, 2, 0), (5, 11, 2, 0),       # duplicated idx 2: both open
         (6, 12, 1, 1), (7, 12, 3, 0),                      # gap: nothing opens
         (8, 13, 1, 1), (9, 13, 2, 0)],                     # not submitted
        "id long, assignment_id long, idx int, status int").withColumn("evaluator_id", F.lit(1).cast("long"))
    sub = spark.createDataFrame([(10,), (11,), (12,)], "assignment_id long")
    got = rows(workflow.advance_steps(steps, sub, "2025-02-28 00:00:00"), "id", "status", "eval_date")
    assert got == [(1, 1, None), (2, 0, None), (3, 2, D(2025, 2, 28)), (4, 1, None), (5, 1, None),
                   (6, 2, D(2025, 2, 28)), (7, 0, None), (8, 1, None), (9, 0, None)]


def test_save_lock(spark):
    ev = spark.createDataFrame(
        [(1, 1, 1, 1, None, True), (2, 1, 1, 2, None, False),   # invalid submit does not lock
         (3, 1, 1, 2, None, True), (4, 1, 1, 0, None, True),    # valid submit locks -> 4 refused
         (5, 2, 2, 0, 2, True),                                  # locked before the log
         (6, 3, 3, 1, 0, True)],
        "seq long, user_id long, form_id long, status int, stored_status int, valid boolean")
    got = rows(workflow.resolve_save_log(ev), "seq", "accepted")
    assert got == [(1, True), (2, False), (3, True), (4, False), (5, False), (6, True)]


def test_replace_with_empty_list_and_patch_lists(spark):
    base = spark.createDataFrame([(1, "late", "2"), (2, "late", "1")], "user_id long, name string, value string")
    parents = spark.createDataFrame([(1,)], "user_id long")
    new = spark.createDataFrame([], "user_id long, name string, value string")
    assert rows(changes.replace_children(base, parents, new, "user_id")) == [(2, "late", "1")]

    users = spark.createDataFrame([(1, "a", "a@x"), (2, "b", "b@x")], "id long, name string, email string")
    for c in ("person_code", "role", "position", "department", "url_image"):
        users = users.withColumn(c, F.lit(None).cast("string"))
    users = users.withColumn("start_date", F.lit(None).cast("date")).withColumn("confirm_date", F.lit(None).cast("date"))
    uc = spark.createDataFrame([(1, 1), (2, 1)], "user_id long, company_id long")
    comp = spark.createDataFrame([(1,), (2,)], "id long")
    patches = spark.createDataFrame(
        [(1, 1, "A", None), (2, 2, None, [])],                  # user 1: list absent; user 2: empty list
        "seq long, user_id long, name string, company_ids array<string>")
    for f in ("email", "role", "personcode", "position", "department", "urlimage", "start_date", "confirm_date"):
        patches = patches.withColumn(f, F.lit(None).cast("string"))
    nu, links = changes.patch_users(users, uc, comp, patches)
    assert rows(nu, "id", "name") == [(1, "A"), (2, "b")]
    assert rows(links) == [(1, 1)]


def test_dense_ids_across_partitions(spark):
    df = spark.range(0, 1000, 1, 7).select((F.col("id") * 7919 % 1000).alias("k"))
    out = changes.assign_ids(df, ["k"], 100)
    got = rows(out, "k", "id")
    assert got == [(k, 101 + k) for k in range(1000)]


def test_update_owned_kpis_rules(spark):
    kpis = spark.createDataFrame(
        [(1, 10, 1, "t1", 5.0, 10, 3.0, 2.0, "c", None, None, None, None, None)],
        "id long, assignment_id long, idx int, title string, max_score double, weight int, expected_score double, "
        "score double, code string, note string, measure string, criteria string, unit string, updated_at timestamp")
    a = spark.createDataFrame([(10, 7, 3)], "id long, form_id long, user_id long")
    ch = spark.createDataFrame(
        [(1, 1, 7, 4, 2, "", "new", 5.0, 50, 3.0, 4.0, "", "m", "", ""),       # wrong owner: skipped
         (2, 1, 7, 3, 3, "x", "bad", 5.0, 150, 3.0, 4.0, "", "m", "", ""),     # weight 150: skipped
         (3, 1, 7, 3, 4, "", "ok", 5.0, 60, 3.0, 1.0, "", "m", "", "")],       # applied, '' -> NULL
        "seq long, kpi_id long, form_id long, user_id long, idx int, code string, title string, max_score double, "
        "weight int, expected_score double, score double, note string, measure string, criteria string, unit string")
    from evalspark.sources.tables import conform
    new, report = changes.update_owned_kpis(conform(kpis, "eval_kpi_user"), a, ch, "2025-02-28 00:00:00")
    assert rows(new, "id", "idx", "code", "title", "weight", "measure") == [(1, 4, None, "ok", 60, "m")]
    assert rows(report, "seq", "updated") == [(1, False), (2, False), (3, True)]


def test_build_steps_rules(spark):
    users = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id long, name string")
    a = spark.createDataFrame([(100, 5, 1)], "id long, form_id long, user_id long")
    steps = spark.createDataFrame([(40, 100, 1, 1, 1)], "id long, assignment_id long, idx int, evaluator_id long, status int")
    req = spark.createDataFrame(
        [(1, 5, 1, '{"evaluators":[2,3]}'), (2, 5, 1, '{"evaluators":[]}'), (3, 5, 1, '{"evaluators":[9]}'),
         (4, 5, 1, '{"evaluators":[1]}')],
        "seq long, form_id long, user_id long, doc string")
    got = rows(workflow.build_steps(req, a, users, steps), "id", "idx", "evaluator_id", "evaluator_name", "status")
    # self first and active; empty list and unknown evaluator create nothing; self not de-duplicated
    assert got == [(41, 1, 1, "a", 1), (42, 2, 2, "b", 0), (43, 3, 3, "c", 0), (44, 1, 1, "a", 1), (45, 2, 1, "a", 0)]


def test_create_users_rules(spark):
    users = spark.createDataFrame([(1, "P1", "x@e")], "id long, person_code string, email string")
    comps = spark.createDataFrame([(1,), (2,)], "id long")
    req = spark.createDataFrame(
        [(1, "n1", "x@e", "P9", ["1"]),            # email taken
         (2, "n2", "y@e", "P2", ["1", "1", "7"]),  # dup + unknown company skipped
         (3, "n3", "y@e", "P3", ["2"]),            # same email as an earlier request
         (4, "n4", "z@e", "P4", None)],
        "seq long, name string, email string, personcode string, company_ids array<string>")
    for f in ("role", "position", "department", "urlimage", "start_date", "confirm_date"):
        req = req.withColumn(f, F.lit(""))
    nu, links = changes.create_users(users, comps, req)
    assert rows(nu, "id", "seq", "email") == [(2, 2, "y@e"), (3, 4, "z@e")]
    assert rows(links) == [(2, 1)]


def test_prepare_forms_rules(spark):
    from evalspark.operators import requests
    forms = spark.createDataFrame([(1, "F1")], "id long, code string")
    req = spark.createDataFrame(
        [(1, "F1", "t", "", 0, "", ""),               # code taken
         (2, "N2", "t", "en", 0, "2024-01-01", "x"),   # total 0 -> 100
         (3, "N3", "t", "", 50, "bad", ""),            # bad date
         (4, "N2", "t", "", 100, "", "")],             # code repeated in the log
        "seq long, code string, title_th string, title_en string, total_weight int, eval_start string, remark string")
    for c in ("kpi_weight", "comp_weight", "ta_weight", "calc_method", "score_scheme"):
        req = req.withColumn(c, F.lit(1))
    got = rows(requests.prepare_forms(forms, req), "id", "code", "title_en", "total_weight", "eval_start", "remark")
    assert got == [(2, "N2", "en", 100, D(2024, 1, 1), "x")]
    blank = spark.createDataFrame([(5, "N5", "t", "", 100, "", "")], req.columns[:7]).select(req.columns[:7])
    for c in ("kpi_weight", "comp_weight", "ta_weight", "calc_method", "score_scheme"):
        blank = blank.withColumn(c, F.lit(1))
    got = rows(requests.prepare_forms(forms, blank), "title_en", "remark", "eval_start")
    assert got == [("", None, None)]  # title_en kept as sent; remark and dates blank -> NULL


def test_new_assignment_needs_existing_form_and_user(spark):
    a = spark.createDataFrame([], "id long, form_id long, user_id long, status int, due_date date")
    forms = spark.createDataFrame([(1,)], "id long")
    users = spark.createDataFrame([(5,)], "id long")
    req = spark.createDataFrame([(1, 1, 5, ""), (2, 2, 5, ""), (3, 1, 6, "")],
                                "seq long, form_id long, user_id long, due_date string")
    got = rows(changes.ensure_assignments(a, req, "2025-02-28 00:00:00", forms, users), "id", "form_id", "user_id")
    assert got == [(1, 1, 5)]


def test_load_and_save_table_round_trip(spark, sf_dir, tmp_path):
    from evalspark.fixtures import fixture_tables
    from evalspark.sources.tables import conform, load_table, save_table
    f = conform(fixture_tables(spark, sf_dir, ["eval_form"])["eval_form"], "eval_form")
    save_table(f, str(tmp_path / "eval_form"))
    back = load_table(spark, "eval_form", str(tmp_path / "eval_form"))
    assert [(x.name, x.dataType) for x in back.schema] == [(x.name, x.dataType) for x in f.schema]
    assert sorted(back.collect()) == sorted(f.collect())
