"""Weighted scoring.

Every percentage is aggregated to assignment grain *before* any join, so the
joins that assemble the summary are one-to-one on ``assignment_id`` and never
fan out.  Operands are cast to DOUBLE and exposed values rounded to 6 digits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import pct, weight_fraction
from .common import sized_broadcast
from .grading import assign_grade


def _d(c: str):
    return F.col(c).cast("double")


def kpi_percent(kpis: DataFrame) -> DataFrame:
    """A1: ``sum(max>0 ? score/max*weight : 0) / nullif(sum(weight), 0) * 100``, NULL -> 0.

    A row with ``max_score <= 0`` adds nothing to the numerator but keeps its
    weight in the denominator.  Output: (assignment_id, kpi_pct) unrounded.
    """
    num = F.sum(F.when(_d("max_score") > 0, _d("score") / _d("max_score") * _d("weight"))
                .otherwise(F.lit(0.0)))
    den = F.nullif(F.sum(_d("weight")), F.lit(0.0))
    return kpis.groupBy("assignment_id").agg(F.coalesce(num / den * 100.0, F.lit(0.0)).alias("kpi_pct"))


def competency_percent(scores: DataFrame, comps: DataFrame) -> DataFrame:
    """A2: ``sum((max>0 ? score/max : 0) * w) * 100`` with w from F12; not divided by sum(w).

    Scores join competencies on ``comp_id`` only (the competency's form is not
    checked, as in the reference).  Competencies are a per-form dimension:
    broadcast after a size check, else a shuffle join.
    """
    c = comps.select(F.col("id").alias("comp_id"), _d("max_score").alias("c_max"),
                     weight_fraction("weight").alias("c_w"))
    s = scores.select("assignment_id", "comp_id", _d("score").alias("c_score"))
    ratio = F.when(F.col("c_max") > 0, F.col("c_score") / F.col("c_max")).otherwise(F.lit(0.0))
    return (s.join(sized_broadcast(c), "comp_id")
            .groupBy("assignment_id")
            .agg(F.coalesce(F.sum(ratio * F.col("c_w")) * 100.0, F.lit(0.0)).alias("comp_pct")))


def attendance_percent(ta: DataFrame) -> DataFrame:
    """A3: ``full > 0 ? score/full*100 : 0`` per assignment, with ``has_ta`` = true."""
    v = F.when(_d("full_score") > 0, _d("score") / _d("full_score") * 100.0).otherwise(F.lit(0.0))
    return ta.select("assignment_id", F.coalesce(v, F.lit(0.0)).alias("ta_pct"), F.lit(True).alias("has_ta"))


def score_assignments(assignments: DataFrame, forms: DataFrame, kpis: DataFrame,
                      comp_scores: DataFrame, comps: DataFrame, ta: DataFrame) -> DataFrame:
    """A1-A4 for every assignment whose form exists.

    Output: assignment_id, form_id, user_id, kpi_weight, kpi_pct, comp_weight,
    comp_pct, ta_weight, ta_pct, has_ta, total_pct (all percentages rounded).
    A4 divides by the constant 100, not by the form's total_weight.
    """
    a = assignments.select(F.col("id").alias("assignment_id"), "form_id", "user_id")
    f = forms.select(F.col("id").alias("form_id"), F.col("kpi_weight").cast("int").alias("kpi_weight"),
                     F.col("comp_weight").cast("int").alias("comp_weight"),
                     F.col("ta_weight").cast("int").alias("ta_weight"))
    j = (a.join(sized_broadcast(f), "form_id")
         .join(kpi_percent(kpis), "assignment_id", "left")
         .join(competency_percent(comp_scores, comps), "assignment_id", "left")
         .join(attendance_percent(ta), "assignment_id", "left"))
    k = F.coalesce(F.col("kpi_pct"), F.lit(0.0))
    c = F.coalesce(F.col("comp_pct"), F.lit(0.0))
    t = F.coalesce(F.col("ta_pct"), F.lit(0.0))
    total = (k * F.col("kpi_weight") + c * F.col("comp_weight") + t * F.col("ta_weight")) / 100.0
    return j.select(
        "assignment_id", "form_id", "user_id",
        "kpi_weight", pct(k).alias("kpi_pct"),
        "comp_weight", pct(c).alias("comp_pct"),
        "ta_weight", pct(t).alias("ta_pct"),
        F.coalesce(F.col("has_ta"), F.lit(False)).alias("has_ta"),
        pct(total).alias("total_pct"),
    )


def evaluation_summary(tables: dict[str, DataFrame]) -> DataFrame:
    """A5: one summary row per assignment (weights, three %, total, grade, band bounds)."""
    scored = score_assignments(tables["eval_assignment"], tables["eval_form"], tables["eval_kpi_user"],
                               tables["eval_competency_score"], tables["eval_competency"],
                               tables["eval_ta_score"])
    return assign_grade(scored, tables["eval_grade_band"])


def active_step_counts(steps: DataFrame) -> DataFrame:
    """Number of steps with status 1 per assignment (0 when none)."""
    return steps.groupBy("assignment_id").agg(
        F.count_if(F.col("status") == 1).cast("long").alias("active_steps"),
        F.count(F.lit(1)).alias("steps"))


def company_counts(users: DataFrame, user_companies: DataFrame, companies: DataFrame) -> DataFrame:
    """Companies linked to each user (J1 inner join, then counted); 0 when none."""
    linked = user_companies.join(sized_broadcast(companies.select(F.col("id").alias("company_id"))),
                                 "company_id")
    per_user = linked.groupBy("user_id").agg(F.count(F.lit(1)).alias("companies"))
    return (users.select(F.col("id").alias("user_id"))
            .join(per_user, "user_id", "left")
            .select("user_id", F.coalesce("companies", F.lit(0)).cast("long").alias("companies")))
