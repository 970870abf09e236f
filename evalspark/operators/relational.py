"""Joins, listings, paging and defaults."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import clamp_page, iso_date, null_to
from ..schemas import TABLES
from ..sources.tables import conform
from .common import sized_broadcast


def _dbl(c: str):
    return F.col(c).cast("double").alias(c)


def user_companies_flat(user_companies: DataFrame, companies: DataFrame) -> DataFrame:
    """Bridge-table inner join user -> company."""
    c = companies.select(F.col("id").alias("company_id"), "code", "name", "image")
    return user_companies.select("user_id", "company_id").join(sized_broadcast(c), "company_id")


def kpi_listing(kpis: DataFrame, assignments: DataFrame) -> DataFrame:
    """KPI rows with the (form_id, user_id) of their assignment; blanks read back as ''."""
    k = conform(kpis, "eval_kpi_user")
    a = assignments.select(F.col("id").alias("assignment_id"), "form_id", "user_id")
    return k.join(a, "assignment_id").select(
        "id", "assignment_id", "form_id", "user_id", "idx",
        null_to("code", "").alias("code"), "title", _dbl("max_score"), "weight",
        _dbl("expected_score"), _dbl("score"), null_to("note", "").alias("note"),
        null_to("measure", "").alias("measure"), null_to("criteria", "").alias("criteria"),
        null_to("unit", "").alias("unit"))


def competencies_with_scores(assignments: DataFrame, comps: DataFrame, scores: DataFrame) -> DataFrame:
    """Every competency of each assignment's form, LEFT JOIN its score (missing -> 0, '')."""
    a = assignments.select(F.col("id").alias("assignment_id"), "form_id")
    c = comps.select(F.col("id").alias("comp_id"), "form_id", "idx", "title", _dbl("max_score"),
                     _dbl("weight"), _dbl("full_total"), _dbl("expected_score"))
    s = scores.select("assignment_id", "comp_id", F.col("score").cast("double").alias("cs_score"),
                      F.col("note").alias("cs_note"))
    return (a.join(sized_broadcast(c), "form_id")
            .join(s, ["assignment_id", "comp_id"], "left")
            .select("assignment_id", "comp_id", "idx", "title", "max_score", "weight", "full_total",
                    "expected_score", F.coalesce("cs_score", F.lit(0.0)).alias("score"),
                    null_to("cs_note", "").alias("note")))


def list_steps(steps: DataFrame, assignments: DataFrame, users: DataFrame) -> DataFrame:
    """Step JOIN assignment JOIN users(evaluator) - inner joins, as in the reference."""
    s = conform(steps, "eval_step")
    a = assignments.select(F.col("id").alias("assignment_id"), "form_id", "user_id")
    u = users.select(F.col("id").alias("evaluator_id"), F.col("name").alias("evaluator_name"))
    return (s.join(a, "assignment_id").join(sized_broadcast(u), "evaluator_id")
            .select("id", "assignment_id", "form_id", "user_id", "idx", "evaluator_id",
                    "evaluator_name", "status", iso_date("eval_date").alias("eval_date")))


def steps_public(listing: DataFrame) -> DataFrame:
    """P5: response narrowing of a step listing to id, evaluator name, status, date."""
    return listing.select("form_id", "user_id", "id", "evaluator_name", "status", "eval_date")


def page(df: DataFrame, limit: int | None = None, offset: int | None = None,
         order_col: str = "id") -> DataFrame:
    """L1: ``ORDER BY id DESC OFFSET o FETCH l`` with the reference's clamps.

    Runs as a top-k (TakeOrderedAndProject): each partition keeps its best
    ``o + l`` rows, so no full sort or shuffle of the table.
    """
    lim, off = clamp_page(limit, offset)
    return df.orderBy(F.col(order_col).desc()).offset(off).limit(lim)


def apply_defaults(df: DataFrame, table: str) -> DataFrame:
    """DDL defaults for absent values, plus the form rule total_weight 0 -> 100."""
    t = TABLES[table]
    out = df
    for name, d in t.defaults.items():
        if name in df.columns:
            out = out.withColumn(name, F.coalesce(F.col(name), F.lit(d).cast(t.col(name).dtype)))
    if table == "eval_form" and "total_weight" in df.columns:
        out = out.withColumn("total_weight",
                             F.when(F.col("total_weight") == 0, F.lit(100)).otherwise(F.col("total_weight")))
    return out


def comps_by_form(comps: DataFrame) -> DataFrame:
    """Competency list of each form (ordered idx, id inside the form)."""
    return comps.select("id", "form_id", "idx", "title", _dbl("max_score"), _dbl("weight"),
                        _dbl("full_total"), _dbl("expected_score"))


def form_listing(forms: DataFrame) -> DataFrame:
    """S1 + F5: forms as the reference returns them, dates as ``yyyy-MM-dd`` text."""
    f = conform(forms, "eval_form")
    dates = ["kpi_cfg_start", "kpi_cfg_end", "eval_start", "eval_end", "other_lv_start",
             "other_lv_end", "annual_lv_start", "annual_lv_end"]
    return f.select("id", "code", "title_th", "title_en", "kpi_weight", "comp_weight", "ta_weight",
                    "total_weight", "calc_method", "score_scheme",
                    *[iso_date(d).alias(d) for d in dates], "remark")

