"""What the reference refuses changes nothing, and refusing one request stops no other."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from evalspark.functions import scalars as sc
from evalspark.operators import changes, documents, integrity, requests, workflow
from evalspark.session import ensure_checkpoint_dir
from evalspark.sources import documents as docs

AS_OF = "2025-02-28 00:00:00"
GOOD = ('{"status":1,"kpis":[{"idx":1,"title":"new","max_score":5,"weight":50,"score":2.5}],"competency_scores":[],'
        '"time_attendance":{"full_score":100,"score":50},"development_plan":[{"idx":1,"content":"c","priority":"High",'
        '"timing":"2025-03-01","remarks":""}],"additional":{"q1":"x"}}')


def state(spark):
    mk = spark.createDataFrame
    return {
        "eval_assignment": mk([(1, 7, 1, 0, dt.date(2024, 1, 1)), (2, 7, 2, 0, dt.date(2024, 1, 1))],
                              "id long, form_id long, user_id long, status int, due_date date"),
        "eval_competency": mk([], "id long, form_id long"), "eval_form": mk([(7,)], "id long"),
        "users": mk([(1, "a"), (2, "b"), (3, "c")], "id long, name string"),
        "eval_kpi_user": mk([(10, 1, 1, None, "old", 5.0, 100, 3.0, 1.0, None, None, None, None, None)],
                            "id long, assignment_id long, idx int, code string, title string, max_score double, weight int,"
                            " expected_score double, score double, note string, measure string, criteria string,"
                            " unit string, updated_at timestamp"),
        "eval_competency_score": mk([], "id long, assignment_id long, comp_id long, score double, note string"),
        "eval_dev_plan": mk([(5, 1, 1, "old plan", "Low", None, None)], "id long, assignment_id long, idx int, content string,"
                            " priority string, timing date, remarks string"),
        "eval_ta_score": mk([(1, 100.0, 10.0)], "assignment_id long, full_score double, score double"),
        "eval_additional": mk([(1, "q", "", "", "", "")], "assignment_id long, q1 string, q2 string, q3 string, q4 string, q5 string"),
        "eval_step": mk([], "id long, assignment_id long, idx int, evaluator_id long, status int, eval_date date")}


def after(spark, *bodies, user=1):
    t = state(spark)
    log = spark.createDataFrame([(i + 1, dt.datetime(2025, 1, 1), user, 7, "", b) for i, b in enumerate(bodies)],
                                "seq long, ts timestamp_ntz, user_id long, form_id long, due_date string, doc string")
    return workflow.apply_save_log(t, log, AS_OF)


@pytest.mark.parametrize("body", ["{broken", "[1]", None, GOOD.replace('"weight":50', '"weight":"abc"'),
                                  GOOD.replace('"title":"new"', '"title":5'), GOOD.replace('"score":2.5', '"score":123456'),
                                  GOOD.replace('"score":50', '"score":1e9'), GOOD.replace("2025-03-01", "2025-02-30")])
def test_a_refused_save_changes_nothing(spark, body):
    out = after(spark, body)
    assert [r["title"] for r in out["eval_kpi_user"].collect()] == ["old"]
    assert [r["content"] for r in out["eval_dev_plan"].collect()] == ["old plan"]
    assert [r["score"] for r in out["eval_ta_score"].collect()] == [10.0]
    assert [r["q1"] for r in out["eval_additional"].collect()] == ["q"]


def test_a_refused_save_stops_no_other_and_makes_no_assignment(spark):
    out = after(spark, "{broken", GOOD.replace('"score":2.5', '"score":123456'), GOOD)
    assert [(r["title"], r["score"]) for r in out["eval_kpi_user"].collect()] == [("new", 2.5)]
    assert [(r["content"], r["timing"]) for r in out["eval_dev_plan"].collect()] == [("c", dt.date(2025, 3, 1))]
    assert after(spark, "{broken", user=3)["eval_assignment"].count() == 2
    assert after(spark, GOOD, user=3)["eval_assignment"].count() == 3


def test_the_due_date_is_the_documents(spark):
    out = after(spark, GOOD.replace('{"status"', '{"due_date":"2025-05-06","status"'))
    assert {r["id"]: r["due_date"] for r in out["eval_assignment"].collect()}[1] == dt.date(2025, 5, 6)


def test_reject_reasons(spark):
    log = spark.createDataFrame([(1, None), (2, "{broken"), (3, "[1]"), (4, '{"status":"x"}'), (5, GOOD), (6, "{}")],
                                "seq long, doc string")
    got = {r["seq"]: r["reject"] for r in docs.rejects(log, docs.SAVE_DOC, ["seq"]).collect()}
    assert got == {1: "no body", 2: "not a JSON object", 3: "not a JSON object", 4: "wrong type"}


def test_refused_attendance_and_user_bodies(spark):
    t = state(spark)
    t["user_time_attendance"] = spark.createDataFrame([(1, 9, 8, 7)], "user_id long, score_max int, score_obtained int, penalty_total int")
    t["user_time_attendance_items"] = spark.createDataFrame([(1, "late", "2")], "user_id long, name string, value string")
    log = spark.createDataFrame([(1, 1, "{broken"), (2, 1, '{"score_max":"many"}')], "seq long, user_id long, doc string")
    out = requests.attendance_requests(t, log)
    assert out["user_time_attendance"].first()["score_max"] == 9 and out["user_time_attendance_items"].count() == 1
    assert requests.user_requests_parsed(log).count() == 1  # the second one has no field of a user that is wrong


def test_cascade_refusals_reach_the_end_of_a_long_chain(spark):
    n = 60  # user i + 1 evaluates the assignment of user i, and user 0 stays
    t = {"users": spark.range(n + 1),
         "eval_assignment": spark.createDataFrame([(i, 1, i) for i in range(n + 1)], "id long, form_id long, user_id long"),
         "eval_step": spark.createDataFrame([(i, i, i + 1) for i in range(n)], "id long, assignment_id long, evaluator_id long")}
    out, gone = changes.cascade_delete_users(t, spark.range(1, n + 1).withColumnRenamed("id", "user_id"))
    assert gone.count() == 0 and out["users"].count() == n + 1


def test_create_users_first_come(spark):
    r = spark.createDataFrame([(1, "e1", "X"), (2, "e2", "X"), (3, "e2", "Y"), (4, "e3", "Y"), (5, "e3", "Z")],
                              "seq long, email string, personcode string")
    assert sorted(x["seq"] for x in changes.first_come(r, ["email", "personcode"]).collect()) == [1, 3, 5]


def test_a_patch_with_a_bad_date_changes_nothing(spark):
    users = spark.createDataFrame([(1, "a", "e", "u", "c", "p", "d", "i", dt.date(2020, 1, 1), None)],
                                  "id long, name string, email string, role string, person_code string, position string,"
                                  " department string, url_image string, start_date date, confirm_date date")
    p = spark.createDataFrame([(1, 1, "new", None, None, None, None, None, None, "2020-02-30", None, None)],
                              "seq long, user_id long, name string, email string, role string, personcode string,"
                              " position string, department string, urlimage string, start_date string,"
                              " confirm_date string, company_ids array<string>")
    links = spark.createDataFrame([], "user_id long, company_id long")
    got, _ = changes.patch_users(users, links, spark.range(1), p)
    assert (got.first()["name"], got.first()["start_date"]) == ("a", dt.date(2020, 1, 1))


def test_step_ids_stay_exact(spark):
    big = (1 << 53) + 1
    steps = spark.createDataFrame([(big, 1, 1, 1, 1, None), (big + 1, 1, 2, 1, 0, None)], workflow.STEP_STATE)
    log = spark.createDataFrame([(1, big, 2, ""), (2, big + 1, 2, "")], "seq long, step_id long, status int, eval_date string")
    got = workflow.update_steps(steps, log, spark.range(3)).collect()
    assert sorted((r["id"], r["status"]) for r in got) == [(big, 2), (big + 1, 2)]


def test_owned_changes_do_not_shuffle_the_child_table_by_assignment(spark):
    kpis = spark.range(1000).select("id", (F.col("id") % 50).alias("assignment_id"))
    a = spark.range(50).select("id", F.lit(1).alias("form_id"), F.lit(1).alias("user_id"))
    d = spark.createDataFrame([(1, 3, 1, 1)], "seq long, kpi_id long, form_id long, user_id long")
    left, _ = changes.delete_owned_kpis(kpis, a, d)
    plan = left._jdf.queryExecution().optimizedPlan().toString()
    semi, inner = plan.index("LeftSemi"), plan.index("Join Inner, (assignment_id")
    assert inner < semi  # the semi join on the named ids lies below the assignment join
    assert left.count() == 999


def test_white_space_is_blank(spark):
    df = spark.createDataFrame([("\t \n",), ("　",), ("x",), (None,)], "s string")
    assert [r[0] for r in df.select(sc.is_blank("s")).collect()] == [True, True, False, True]


def test_attendance_of_a_user_without_a_summary(spark):
    s = spark.createDataFrame([(1, 9, 8, 7)], "user_id long, score_max int, score_obtained int, penalty_total int")
    it = spark.createDataFrame([(1, "late", "2")], "user_id long, name string, value string")
    got = {r["user_id"]: (r["score_max"], len(r["time_attendance"]))
           for r in documents.attendance_documents(spark.range(1, 3), s, it).collect()}
    assert got == {1: (9, 1), 2: (0, 0)}


def test_no_shared_folder_on_a_cluster_is_an_error():
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        ensure_checkpoint_dir(Session())


def test_validators_find_violations(spark):
    kpis = spark.createDataFrame([(1, 1, "t" * 301, 50), (1, 1, None, 150), (2, 1, "ok", 0)],
                                 "id long, assignment_id long, title string, weight int")
    t = {"eval_kpi_user": kpis}
    assert [(r["key_name"], r["key_value"], r["n"]) for r in integrity.dup_keys(t).collect()] == [("id", "1", 2)]
    assert [r["violations"] for r in integrity.check_violations(t).collect()] == [1]
    found = {r["column_name"]: (r["nulls"], r["too_long"]) for r in integrity.length_null_violations(t).collect()}
    assert found["title"] == (1, 1) and found["id"] == (0, 0)
