"""Emails and person codes stay unique while patches and creations come in order; refusals follow long chains."""

import random

import pytest
from pyspark.sql import functions as F

from evalspark.operators import changes, common, unique

PATCH = ("seq long, user_id long, name string, email string, role string, personcode string, position string,"
         " department string, urlimage string, start_date string, confirm_date string, company_ids array<string>")
USERS = ("id long, name string, email string, role string, person_code string, position string, department string,"
         " url_image string, start_date date, confirm_date date")


def patched(spark, emails, patches):
    """{user: (email, name)} after patches (seq, user, email, name); the codes are the users' ids."""
    users = spark.createDataFrame([(i, "n", e, None, f"c{i}", None, None, None, None, None) for i, e in emails.items()], USERS)
    p = spark.createDataFrame([(s, u, n, e, *[None] * 8) for s, u, e, n in patches], PATCH)
    links = spark.createDataFrame([], "user_id long, company_id long")
    return {r["id"]: (r["email"], r["name"]) for r in changes.patch_users(users, links, spark.range(1), p)[0].collect()}


def test_two_patches_to_one_email(spark):
    assert patched(spark, {1: "a", 2: "b"}, [(1, 1, "same", "x"), (2, 2, "same", "y")]) == {1: ("same", "x"), 2: ("b", "n")}


def test_swap_through_a_third_value(spark):
    assert patched(spark, {1: "a", 2: "b"}, [(1, 1, "t", None), (2, 2, "a", None), (3, 1, "b", None)]) == {1: ("b", "n"), 2: ("a", "n")}


def test_a_value_freed_earlier_can_be_taken(spark):
    got = patched(spark, {1: "a", 2: "b", 3: "c"}, [(1, 2, "a", "early"), (2, 1, "z", None), (3, 3, "a", None), (4, 1, "c", None), (5, 2, "z", None)])
    assert got == {1: ("c", "n"), 2: ("z", "n"), 3: ("a", "n")}
    assert patched(spark, {1: "a"}, [(1, 1, "a", "own")]) == {1: ("a", "own")}


def model(held, requests):
    now, refused = dict(held), []
    for seq, owner, values in requests:
        taken = {(k, v) for o, hs in now.items() if o != owner for k, v in hs.items()}
        if any((k, v) in taken for k, v in values.items()):
            refused.append(seq)
        else:
            now[owner] = {**now.get(owner, {}), **values}
    return refused


@pytest.mark.parametrize("one_task", [10 ** 6, 0])
def test_requests_in_order_against_a_sequential_model(spark, monkeypatch, one_task):
    monkeypatch.setattr(unique, "ONE_TASK_ROWS", one_task)  # in one task and in groups alike
    rng = random.Random(7)
    held = {o: {"e": f"e{o}", "c": f"c{o}"} for o in range(40)}
    reqs = []
    for seq in range(150):
        values = {k: f"{k}{rng.randrange(60)}" for k in "ec" if rng.random() < 0.6}
        reqs.append((seq, rng.randrange(50), values))
    r = spark.createDataFrame([(s, o, v.get("e"), v.get("c")) for s, o, v in reqs], "seq long, owner long, e string, c string")
    h = spark.createDataFrame([(o, v["e"], v["c"]) for o, v in held.items()], "owner long, e string, c string")
    got = sorted(x["seq"] for x in unique.refused_requests(r, h, ["e", "c"]).collect())
    assert got == model(held, [x for x in reqs if x[2]]) and len(got) > 20


def jobs_of(spark, run):
    """How many Spark jobs ``run`` starts."""
    tracker, group = spark.sparkContext.statusTracker(), f"g{random.random()}"
    spark.sparkContext.setJobGroup(group, group)
    run()
    n = len(tracker.getJobIdsForGroup(group))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return n


def test_a_chain_of_creations_costs_no_round_per_link(spark):
    def accepted(n):
        r = spark.createDataFrame([(i + 1, f"e{(i + 1) // 2}", f"c{i // 2}") for i in range(n)], "seq long, email string, personcode string")
        return sorted(x["seq"] for x in changes.first_come(r, ["email", "personcode"]).collect())

    assert accepted(1000) == list(range(1, 1001, 2))
    assert jobs_of(spark, lambda: accepted(1000)) <= jobs_of(spark, lambda: accepted(10)) + 2


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 200)] + [(500, 700), (700, 600), (900, 900), (1000, 1001)]
    got = {r["node"]: r["component"] for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(201)}, 500: 500, 600: 500, 700: 500, 1000: 1000, 1001: 1000}
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_refusals_follow_a_chain_of_a_thousand_in_few_rounds(spark, monkeypatch):
    n, rounds = 1000, []
    at_rest = changes.at_rest
    monkeypatch.setattr(changes, "at_rest", lambda df, name: (rounds.append(name), at_rest(df, name))[1])
    t = {"users": spark.range(n + 1), "eval_assignment": spark.range(n + 1).select("id", F.lit(1).alias("form_id"), F.col("id").alias("user_id")),
         "eval_step": spark.range(n).select("id", F.col("id").alias("assignment_id"), (F.col("id") + 1).alias("evaluator_id"))}
    out, gone = changes.cascade_delete_users(t, spark.range(1, n + 1).withColumnRenamed("id", "user_id"))
    assert gone.count() == 0 and rounds.count("reach") <= 12
    out, gone = changes.cascade_delete_users(t, spark.range(500, n + 1).withColumnRenamed("id", "user_id"))
    assert gone.count() == 0
    _, gone = changes.cascade_delete_users({**t, "eval_step": t["eval_step"].where("id >= 600")}, spark.range(1, n + 1).withColumnRenamed("id", "user_id"))
    assert gone.count() == 600 + 400  # the chain now starts at user 600, who goes too
