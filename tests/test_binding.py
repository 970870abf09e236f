"""Request bodies bound as a JSON decoder of a statically typed service binds them."""

import datetime as dt

import pytest
from pyspark.sql import functions as F
from test_refusals import AS_OF, GOOD, after, state

from evalspark.operators import requests, workflow
from evalspark.sources import binding
from evalspark.sources import documents as docs

KPI = '{"kpis":[{"title":"t","weight":%s}]}'
# body, why it is refused (or None), what it is bound to (fields that are not absent)
CASES = [
    ('{"STATUS":2}', None, {"status": 2}), ('{"status":1,"Kpis":[{"TITLE":"t"}]}', None, {"status": 1, "kpis": [{"title": "t"}]}),
    ('{"status":1,"status":2}', None, {"status": 2}), ('{"Status":1,"status":2}', None, {"status": 2}),
    ('{"status":1,"STATUS":3}', None, {"status": 3}), ('{"ſtatus":1}', None, {"status": 1}),
    ('{"status":1,"title":5}', None, {"status": 1}), ('{"status":1,"x":{"note":5}}', None, {"status": 1}), ('{"q1":5}', None, {}),
    ('{"status":1}x', "not a JSON object", None), ('{"status":1}}', "not a JSON object", None), ('{"status":1},{}', "not a JSON object", None),
    ('{"a":1},"body":{"status":2}', "not a JSON object", None), (" \n{}\t ", None, {}), ("null", None, None),
    (KPI % "5000000000", None, {"kpis": [{"title": "t", "weight": 5000000000}]}), (KPI % "99999999999999999999", "wrong type", None),
    (KPI % "1.0", "wrong type", None), (KPI % "1e3", "wrong type", None), (KPI % '"1"', "wrong type", None), (KPI % "true", "wrong type", None),
    (KPI % "null", None, {"kpis": [{"title": "t"}]}), ('{"kpis":[null]}', None, {"kpis": [None]}), ('{"kpis":[{},7]}', "wrong type", None),
    ('{"kpis":{}}', "wrong type", None), ('{"additional":{"q1":5}}', "wrong type", None), ('{"additional":{"Q1":"x"}}', None, {"additional": {"q1": "x"}}),
    ('{"time_attendance":{"score":1e999}}', "wrong type", None), ('{"time_attendance":{"score":"1"}}', "wrong type", None),
    ('{"due_date":"{\\"Status\\": 1, \\"KPIS\\":2}"}', None, {"due_date": '{"Status": 1, "KPIS":2}'}),
    ("{'status':1}", "not a JSON object", None), ('{"status":NaN}', "not a JSON object", None), ('{"status":01}', "not a JSON object", None),
    ("", "not a JSON object", None), ("[1]", "not a JSON object", None), ('"x"', "not a JSON object", None), (None, "no body", None)]


def held(value):
    """Without absent fields."""
    if isinstance(value, dict):
        return {k: held(v) for k, v in value.items() if v is not None}
    return [held(v) for v in value] if isinstance(value, list) else value


def test_bodies(spark):
    df = spark.createDataFrame([(i, b) for i, (b, _, _) in enumerate(CASES)], "seq int, doc string").repartition(1)
    got = {r["seq"]: (r["reject"], r["d"] and held(r["d"].asDict(True))) for r in binding.bind(df, docs.SAVE_DOC).collect()}
    for i, (body, reject, bound) in enumerate(CASES):
        assert got[i] == (reject, bound), body


ODD = ['{"status":null,"status":"x"}', '{"kpis":[{"code":5}]}', '{"kpis":[{"code" :5}]}', '{"kpis":[{"code":\\n true}]}', '{"kpis":[{"\\u0063ode":5}]}',
       '{"kpis":[{"code":"5","title":"\\"code\\":5","note":"A \\": 1"}]}', '{"kpis":[{"title":{"a":1}}]}', '{"kpis":[{"title":["a"]}]}', '{"additional":{"q1": false}}',
       '{"time_attendance":{"score":-0.0,"full_score":1e3}}', '{"time_attendance":{"score":-1e999}}', '{"time_attendance":{"score": -0}}',
       '{"kpis":[null,{"max_score":12345678901234567890123456789012345678901234567890}]}', '{"\u212apis":[{"title":"a"}]}', '{"kpis":[{"title":"a\\ud800"}]}',
       '{"kpis":[{"title":null,"weight":null},{"max_score":"NaN"}]}', '{"x":{"title":5,"Y":[1]},"status":1}', '{"status":1}, "z":{}', '{"status":1}//', 'null}', '5']


def test_bodies_bound_at_once_are_bound_as_one_by_one(spark):
    bodies = [b for b, _, _ in CASES] + ODD
    df = spark.createDataFrame(list(enumerate(bodies)), "seq int, doc string").repartition(1)
    for schema in (docs.SAVE_DOC, docs.KPI_BULK_DOC, docs.USER_DOC, docs.STEP_CHAIN_DOC):
        want, got = (sorted((r["seq"], r["reject"], repr(r["d"])) for r in f(df, schema).collect()) for f in (binding.bind, binding.bind_at_once))
        assert got == want
    usual = [b for b in bodies if b in ('{"status":1,"status":2}', '{"additional":{"q1":"x"}}', "null", KPI % "5000000000", KPI % "null")]
    df = spark.createDataFrame([(b,) for b in usual], "doc string")
    assert df.where(binding.plain(F.col("doc"), binding.text_names(docs.SAVE_DOC))).count() == len(usual) > 3


def test_bodies_beside_the_array_they_are_read_in(spark):
    """Bodies that go on after their value, and texts that read like other values."""
    bodies = ['{"status":1}],"x":[{}', '{"status":1}]', '{"status":1}]}', '{"status":1},{"End":1}],"x":[', '{"status":1},{"End":1}', '{"End":1}',
              '{"Body":[{"status":2}]}', '{"status":1}],"Body":[{"status":2}', '{"status":1}],"\\u0042ody":[{"status":2}', "", " ", "{}", "null", "7", "[{}]",
              '{"kpis":[{"code":"5","title":"true","note":"[1]","weight":1}]}', '{"kpis":[{"code":5.0e3,"title":"a"}]}', '{"kpis":[{"code" : {"a":1}}]}',
              '{"kpis":[{"note":"2024-05-01"}],"due_date":"7"}', '{"kpis":[{"title":[1]},{"title":"b"}]}', '{"kpis":[{"code":5,"code":"x"}]}',
              '{"additional":{"q5":false}}', '{"kpis":[{"score":-0.0},{"score":-0.5}]}']
    df = spark.createDataFrame(list(enumerate(bodies)), "seq int, doc string").repartition(1)
    want, got = ([(r["reject"], repr(r["d"])) for r in f(df, docs.SAVE_DOC).orderBy("seq").collect()] for f in (binding.bind, binding.bind_at_once))
    assert got == want


def test_a_plain_body_is_parsed_once(spark):
    """Numbers in texts and dates do not send a body to be bound value by value."""
    df = spark.createDataFrame([('{"due_date":"2024-05-01","kpis":[{"code":"12","title":"K 1","score":0.0}]}',)], "doc string")
    d = F.from_json("doc", docs.SAVE_DOC)
    assert not df.select(binding.other_than_text(F.col("doc"), d, docs.SAVE_DOC, binding.text_names(docs.SAVE_DOC))).first()[0]
    assert not df.select(binding.off_double(d, docs.SAVE_DOC)).first()[0]


def test_a_refused_body_is_parsed_once(spark):
    df = spark.createDataFrame([(1, "{"), (2, KPI % '"1"'), (3, KPI % "1"), (4, None)], "seq int, doc string")
    found = docs.rejects(df, docs.SAVE_DOC, ["seq"])
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "from_json" not in plan and "parse_json" not in plan
    assert sorted(map(tuple, found.collect())) == [(1, "not a JSON object"), (2, "wrong type"), (4, "no body")]


def test_a_status_in_another_case_locks(spark):
    out = after(spark, GOOD.replace('"status":1', '"STATUS":2'), GOOD.replace('"new"', '"late"'))
    assert {r["id"]: r["status"] for r in out["eval_assignment"].collect()}[1] == 2
    assert [r["title"] for r in out["eval_kpi_user"].collect()] == ["new"]


def test_a_null_body_is_an_empty_document(spark):
    out = after(spark, "null")
    assert out["eval_kpi_user"].count() == 0 and [r["q1"] for r in out["eval_additional"].collect()] == [""]


@pytest.mark.parametrize("number", ['"weight":5000000000', '"weight":50,"idx":5000000000'])
def test_a_number_beyond_its_column_fails_after_the_assignment(spark, number):
    out = after(spark, GOOD.replace('"weight":50', number).replace('{"status"', '{"due_date":"2025-07-07","status"'), user=3)
    made = [r for r in out["eval_assignment"].collect() if r["user_id"] == 3]
    assert [(r["status"], r["due_date"]) for r in made] == [(0, dt.date(2025, 7, 7))]
    assert [r["title"] for r in out["eval_kpi_user"].collect()] == ["old"]


def test_bodies_are_parsed_once_and_items_are_not_sorted(spark):
    t = state(spark)
    log = spark.createDataFrame([(i, 1 + i % 2, 7, '{"items":[{"title":"a"},{"title":"b"}]}') for i in range(1, 9)],
                                "seq long, user_id long, form_id long, doc string")
    out = requests.append_kpi_requests(t, log, AS_OF)["eval_kpi_user"]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "from_json" not in plan and "parse_json" not in plan and "Sort [" not in plan and "RepartitionByExpression" not in plan
    new = [(r["id"], r["title"]) for r in out.where("id > 10").orderBy("id").collect()]
    assert new == [(11 + i, "ab"[i % 2]) for i in range(16)]
    bound = binding.bind(log.select("seq", "doc"), docs.KPI_BULK_DOC)
    assert bound.where(F.col("reject").isNull())._jdf.queryExecution().analyzed().toString().count("from_json") == 1


def test_steps_are_updated_without_python(spark):
    steps = spark.createDataFrame([(i, i // 4, i % 4 + 1, 1, 1 if i % 4 == 0 else 0, None) for i in range(40)], workflow.STEP_STATE)
    log = spark.createDataFrame([(i, i % 40, 2, "") for i in range(200)], "seq long, step_id long, status int, eval_date string")
    out = workflow.update_steps(steps, log, spark.range(3))
    assert "InPandas" not in out._jdf.queryExecution().toString() and out.count() == 40
