"""Nested document assembly.

Children are grouped by their parent key first (one aggregate per child
table), then joined one-to-one on the parent key, so nothing fans out.  Lists
are ``sort_array(collect_list(struct(order keys, ...)))``; their size is the
child count of one parent, the same list the reference returns per request.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import iso_date, null_to, years_of_work
from ..sources.tables import conform
from .relational import competencies_with_scores, user_companies_flat


def _sorted_list(*fields: Column) -> Column:
    return F.sort_array(F.collect_list(F.struct(*fields)))


def user_profiles(users: DataFrame, user_companies: DataFrame, companies: DataFrame,
                  as_of: str | None = None) -> DataFrame:
    """D1 (+J9, F11): user rows with their company list; years_of_work at ``as_of``.

    With ``as_of`` (the login path) years are computed from confirm/start
    date; without it the stored value is returned, as on the other paths.
    """
    u = conform(users, "users")
    # only the links of the users being profiled: for a page this is a
    # broadcast semi-join of a few ids, so the aggregation below never runs
    # over every user's links
    uc = user_companies.join(u.select(F.col("id").alias("user_id")), "user_id", "left_semi")
    links = (user_companies_flat(uc, companies)
             .groupBy("user_id")
             .agg(_sorted_list(F.col("company_id").alias("id"), "code", "name", "image").alias("company")))
    yw = (years_of_work("confirm_date", "start_date", F.lit(as_of)) if as_of
          else F.col("years_of_work"))
    return (u.join(links, u["id"] == links["user_id"], "left")
            .select("id", "name", "email", "role", "person_code", "position", "department", "url_image",
                    iso_date("start_date").alias("start_date"), iso_date("confirm_date").alias("confirm_date"),
                    yw.alias("years_of_work"),
                    F.coalesce("company", F.array().cast("array<struct<id:bigint,code:string,"
                                                         "name:string,image:string>>")).alias("company")))


def flatten_profiles(profiles: DataFrame) -> DataFrame:
    """D1 flattened for comparison: company list -> count and comma-joined codes."""
    return profiles.select(
        "id", "name", "email", "role", "person_code", "department", "start_date", "confirm_date",
        "years_of_work", F.size("company").cast("long").alias("companies"),
        F.concat_ws(",", F.transform("company", lambda c: c["code"])).alias("company_codes"))


def attendance_documents(users: DataFrame, summary: DataFrame, items: DataFrame) -> DataFrame:
    """D3: attendance payload of every user: summary + items ordered by name.

    A user without a summary has zeros and an empty list, as the reference answers.
    """
    it = items.groupBy("user_id").agg(_sorted_list("name", "value").alias("time_attendance"))
    of_user = users.select(F.col("id").alias("user_id"))
    it = it.join(summary.select("user_id"), "user_id", "left_semi")
    return (of_user.join(summary, "user_id", "left").join(it, "user_id", "left")
            .select("user_id", *[F.coalesce(c, F.lit(0)).cast("int").alias(c)
                                 for c in ("score_max", "score_obtained", "penalty_total")],
                    F.coalesce("time_attendance", F.array().cast("array<struct<name:string,value:string>>"))
                    .alias("time_attendance")))


def attendance_sizes(docs: DataFrame) -> DataFrame:
    """D3 flattened: item count and ``name=value`` list in name order."""
    return docs.select(
        "user_id", "score_max", "score_obtained", "penalty_total",
        F.size("time_attendance").cast("long").alias("items"),
        F.concat_ws(";", F.transform("time_attendance",
                                     lambda x: F.concat(x["name"], F.lit("="), x["value"]))).alias("item_text"))


def _ordered_list(sort_keys: list[str], fields: list, out_fields: list[str]) -> Column:
    """Children sorted by ``sort_keys`` (then the rest), reshaped to ``out_fields`` in that order."""
    packed = F.sort_array(F.collect_list(F.struct(*[F.col(k).alias(f"__s{i}") for i, k in enumerate(sort_keys)],
                                                  *fields)))
    return F.transform(packed, lambda x: F.struct(*[x[f].alias(f) for f in out_fields]))


KPI_FIELDS = ["id", "assignment_id", "idx", "code", "title", "max_score", "weight", "expected_score", "score",
              "note", "measure", "criteria", "unit"]
COMP_FIELDS = ["comp_id", "idx", "title", "max_score", "weight", "full_total", "expected_score", "score", "note"]
PLAN_FIELDS = ["idx", "content", "priority", "timing", "remarks"]
SUMMARY_FIELDS = ["form_id", "kpi_weight", "kpi_pct", "comp_weight", "comp_pct", "ta_weight", "ta_pct", "total_pct",
                  "grade", "grade_min", "grade_max"]


def form_documents(tables: dict[str, DataFrame], summary: DataFrame) -> DataFrame:
    """The full form document of every assignment, in the reference's shape.

    kpis[] (idx, id order), competencies[] of the form with scores (J4),
    time_attendance (0/0 when missing), development_plan[] (idx, id order),
    additional (NULL -> ''), summary (A5).  Every child table is aggregated
    by assignment_id before the joins.  List items are sorted by their order
    keys and then reshaped to the reference's field order.
    """
    a = conform(tables["eval_assignment"], "eval_assignment")
    k = conform(tables["eval_kpi_user"], "eval_kpi_user")
    kl = k.select("id", "assignment_id", "idx", null_to("code", "").alias("code"), "title",
                  *[F.col(c).cast("double").alias(c) for c in ("max_score", "expected_score", "score")], "weight",
                  *[null_to(c, "").alias(c) for c in ("note", "measure", "criteria", "unit")])
    kpis = kl.groupBy("assignment_id").agg(
        _ordered_list(["idx", "id"], [F.col(c) for c in KPI_FIELDS], KPI_FIELDS).alias("kpis"))
    cws = competencies_with_scores(tables["eval_assignment"], tables["eval_competency"],
                                   tables["eval_competency_score"])
    comps = cws.groupBy("assignment_id").agg(
        _ordered_list(["idx", "comp_id"], [F.col(c) for c in COMP_FIELDS], COMP_FIELDS).alias("competencies"))
    ta = tables["eval_ta_score"].select(
        "assignment_id", F.struct(F.col("full_score").cast("double").alias("full_score"),
                                  F.col("score").cast("double").alias("score")).alias("ta"))
    dp = conform(tables["eval_dev_plan"], "eval_dev_plan").select(
        "assignment_id", "id", "idx", "content", "priority", null_to(iso_date("timing"), "").alias("timing"),
        null_to("remarks", "").alias("remarks"))
    plans = dp.groupBy("assignment_id").agg(
        _ordered_list(["idx", "id"], [F.col(c) for c in PLAN_FIELDS], PLAN_FIELDS).alias("development_plan"))
    ad = conform(tables["eval_additional"], "eval_additional").select(
        "assignment_id", F.struct(*[null_to(q, "").alias(q) for q in ("q1", "q2", "q3", "q4", "q5")]).alias("ad"))
    s = summary.select("assignment_id", F.struct(*SUMMARY_FIELDS).alias("summary"))
    empty_ta = F.struct(F.lit(0.0).alias("full_score"), F.lit(0.0).alias("score"))
    empty_ad = F.struct(*[F.lit("").alias(q) for q in ("q1", "q2", "q3", "q4", "q5")])
    doc = (a.select(F.col("id").alias("assignment_id"), "form_id", "user_id", "status",
                    iso_date("due_date").alias("due_date"))
           .join(kpis, "assignment_id", "left")
           .join(comps, "assignment_id", "left")
           .join(ta, "assignment_id", "left")
           .join(plans, "assignment_id", "left")
           .join(ad, "assignment_id", "left")
           .join(s, "assignment_id", "left"))
    return doc.select(
        "assignment_id", "form_id", "user_id", "status", "due_date",
        F.coalesce("kpis", F.array().cast(kpis.schema["kpis"].dataType)).alias("kpis"),
        F.coalesce("competencies", F.array().cast(comps.schema["competencies"].dataType)).alias("competencies"),
        F.coalesce("ta", empty_ta).alias("time_attendance"),
        F.coalesce("development_plan", F.array().cast(plans.schema["development_plan"].dataType))
        .alias("development_plan"),
        F.coalesce("ad", empty_ad).alias("additional"),
        "summary")


def form_document_json(docs: DataFrame) -> DataFrame:
    """S8 over D2: (assignment_id, json) with the reference's JSON fields.

    ``due_date`` and each KPI's ``unit`` are dropped when blank (``omitempty``
    in the reference); form_id / user_id stay outside the JSON as keys.
    """
    kpis = F.transform("kpis", lambda x: F.struct(
        *[F.nullif(x[f], F.lit("")).alias(f) if f == "unit" else x[f].alias(f) for f in KPI_FIELDS]))
    body = docs.select("assignment_id", "form_id", "user_id", "status", "due_date", kpis.alias("kpis"),
                       "competencies", "time_attendance", "development_plan", "additional", "summary")
    out = to_document_json(body.withColumn("__aid", F.col("assignment_id")),
                           keys=("__aid", "form_id", "user_id"), omit_blank=("due_date",))
    return out.select(F.col("__aid").alias("assignment_id"), "form_id", "user_id", "json")


def to_document_json(df: DataFrame, keys: tuple[str, ...] = (), omit_blank: tuple[str, ...] = ()) -> DataFrame:
    """``keys`` plus one JSON text (``json``) of the other columns per row.

    ``to_json`` drops NULL fields, so ``omit_blank`` fields are turned from
    '' into NULL first, which mirrors ``omitempty``.
    """
    body = [F.nullif(F.col(c), F.lit("")).alias(c) if c in omit_blank else F.col(c)
            for c in df.columns if c not in keys]
    return df.select(*keys, F.to_json(F.struct(*body)).alias("json"))
