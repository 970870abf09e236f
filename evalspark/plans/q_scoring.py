"""Registered queries: scoring, grading, counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import fixture_tables
from ..operators import grading, scoring
from .registry import query
from .sqlparts import COMP_CTE, KPI_CTE, SUMMARY_CTE, SUMMARY_VIEWS, TA_CTE, oracle

_SUMMARY_COLS = ("assignment_id, form_id, user_id, kpi_weight, kpi_pct, comp_weight, comp_pct, "
                 "ta_weight, ta_pct, has_ta, total_pct, grade, grade_min, grade_max")


@query("evaluation_summary", oracle(SUMMARY_VIEWS, SUMMARY_CTE, f"select {_SUMMARY_COLS} from summary"))
def q_evaluation_summary(spark, sf_dir):
    """A5 flagship: weighted summary with grade for every assignment."""
    return scoring.evaluation_summary(fixture_tables(spark, sf_dir, SUMMARY_VIEWS))


@query("kpi_pct", oracle(("eval_kpi_user",), KPI_CTE,
                         "select assignment_id, round(kpi_pct, 6) as kpi_pct from kpi"))
def q_kpi_pct(spark, sf_dir):
    """A1: KPI percentage per assignment that has KPI rows."""
    t = fixture_tables(spark, sf_dir, ["eval_kpi_user"])
    return scoring.kpi_percent(t["eval_kpi_user"]).select(
        "assignment_id", F.round("kpi_pct", 6).alias("kpi_pct"))


@query("comp_pct", oracle(("eval_competency_score", "eval_competency"), COMP_CTE,
                          "select assignment_id, round(comp_pct, 6) as comp_pct from comp"))
def q_comp_pct(spark, sf_dir):
    """A2 + J3: competency percentage per assignment with scored competencies."""
    t = fixture_tables(spark, sf_dir, ["eval_competency_score", "eval_competency"])
    return scoring.competency_percent(t["eval_competency_score"], t["eval_competency"]).select(
        "assignment_id", F.round("comp_pct", 6).alias("comp_pct"))


@query("ta_pct", oracle(("eval_ta_score",), TA_CTE,
                        "select assignment_id, round(ta_pct, 6) as ta_pct, has_ta from ta"))
def q_ta_pct(spark, sf_dir):
    """A3: attendance percentage per assignment with an attendance row."""
    t = fixture_tables(spark, sf_dir, ["eval_ta_score"])
    return scoring.attendance_percent(t["eval_ta_score"]).select(
        "assignment_id", F.round("ta_pct", 6).alias("ta_pct"), "has_ta")


@query("grade_lookup", oracle(SUMMARY_VIEWS, SUMMARY_CTE,
                              "select assignment_id, form_id, total_pct, grade, grade_min, grade_max,"
                              " grade = 'N/A' as no_band from summary"))
def q_grade_lookup(spark, sf_dir):
    """G1: best band for each assignment total (own form first, then default bands)."""
    t = fixture_tables(spark, sf_dir, SUMMARY_VIEWS)
    scored = scoring.score_assignments(t["eval_assignment"], t["eval_form"], t["eval_kpi_user"],
                                       t["eval_competency_score"], t["eval_competency"], t["eval_ta_score"])
    g = grading.assign_grade(scored.select("assignment_id", "form_id", "total_pct"), t["eval_grade_band"])
    return g.withColumn("no_band", F.col("grade") == grading.NO_GRADE)


@query("active_step_counts", oracle(("eval_step",), "",
                                    "select assignment_id, cast(count(*) filter (where status = 1) as bigint)"
                                    " as active_steps, count(*) as steps from eval_step group by assignment_id"))
def q_active_step_counts(spark, sf_dir):
    """Active steps per assignment."""
    return scoring.active_step_counts(fixture_tables(spark, sf_dir, ["eval_step"])["eval_step"])


@query("first_active_step", oracle(("eval_step",), "",
                                   "select assignment_id, step_id, idx from ("
                                   " select assignment_id, id as step_id, idx, row_number() over"
                                   " (partition by assignment_id order by idx, id) as rn"
                                   " from eval_step where status = 1) x where rn = 1"))
def q_first_active_step(spark, sf_dir):
    """Earliest active step per assignment."""
    return grading.first_active_step(fixture_tables(spark, sf_dir, ["eval_step"])["eval_step"])


@query("company_counts", oracle(("users", "user_companies", "companies"), "",
                                "select u.id as user_id, count(c.id) as companies from users u"
                                " left join user_companies uc on uc.user_id = u.id"
                                " left join companies c on c.id = uc.company_id group by u.id"))
def q_company_counts(spark, sf_dir):
    """Number of companies per user."""
    t = fixture_tables(spark, sf_dir, ["users", "user_companies", "companies"])
    return scoring.company_counts(t["users"], t["user_companies"], t["companies"])

