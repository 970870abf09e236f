"""Declared schemas and constraints of the 15 evaluation tables.

Spark types per table plus primary keys, unique keys, foreign keys (with
their delete action), CHECK rules and NOT NULL / length limits.  The
integrity operators (K1-K4) and the cascade delete (M9) are driven by this
metadata; readers use the StructTypes so nothing is inferred.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

L, I, S, D, TS = T.LongType(), T.IntegerType(), T.StringType(), T.DateType(), T.TimestampType()


def dec(p: int, s: int) -> T.DecimalType:
    return T.DecimalType(p, s)


@dataclass(frozen=True)
class Col:
    name: str
    dtype: T.DataType
    nullable: bool = True
    max_len: int | None = None  # NVARCHAR(n)


@dataclass(frozen=True)
class FK:
    cols: tuple[str, ...]
    ref_table: str
    ref_cols: tuple[str, ...]
    on_delete: str  # "cascade" or "no action"


@dataclass(frozen=True)
class Table:
    name: str
    cols: tuple[Col, ...]
    pk: tuple[str, ...]
    uniques: tuple[tuple[str, ...], ...] = ()
    fks: tuple[FK, ...] = ()
    checks: tuple[tuple[str, str], ...] = ()  # (name, SQL condition that must hold)
    defaults: dict = field(default_factory=dict)

    @property
    def struct(self) -> T.StructType:
        return T.StructType([T.StructField(c.name, c.dtype, c.nullable) for c in self.cols])

    def col(self, name: str) -> Col:
        return next(c for c in self.cols if c.name == name)


def _t(name, cols, pk, **kw) -> Table:
    return Table(name, tuple(cols), tuple(pk), **kw)


# Column lists, lengths, keys, checks and defaults of the
# reference DDL, in table order.
TABLES: dict[str, Table] = {t.name: t for t in [
    _t("users", [
        Col("id", L, False), Col("person_code", S, True, 50), Col("name", S, False, 120),
        Col("email", S, False, 200), Col("role", S, True, 50), Col("position", S, True, 120),
        Col("department", S, True, 120), Col("url_image", S, True, 255), Col("start_date", D),
        Col("confirm_date", D), Col("years_of_work", I, False), Col("created_at", TS, False),
        Col("updated_at", TS, False)],
        ["id"], uniques=(("person_code",), ("email",)), defaults={"years_of_work": 0}),
    _t("companies", [Col("id", L, False), Col("code", S, False, 50), Col("name", S, False, 200),
                     Col("image", S, True, 255)], ["id"]),
    _t("user_companies", [Col("user_id", L, False), Col("company_id", L, False)], ["user_id", "company_id"],
       fks=(FK(("user_id",), "users", ("id",), "cascade"),
            FK(("company_id",), "companies", ("id",), "cascade"))),
    _t("user_time_attendance", [Col("user_id", L, False), Col("score_max", I, False),
                                Col("score_obtained", I, False), Col("penalty_total", I, False)],
       ["user_id"], fks=(FK(("user_id",), "users", ("id",), "cascade"),),
       defaults={"score_max": 0, "score_obtained": 0, "penalty_total": 0}),
    _t("user_time_attendance_items", [Col("user_id", L, False), Col("name", S, False, 64),
                                      Col("value", S, False, 32)],
       ["user_id", "name"], fks=(FK(("user_id",), "users", ("id",), "cascade"),)),
    _t("eval_form", [
        Col("id", L, False), Col("code", S, False, 50), Col("title_th", S, False, 200),
        Col("title_en", S, True, 200), Col("kpi_weight", I, False), Col("comp_weight", I, False),
        Col("ta_weight", I, False), Col("total_weight", I, False), Col("calc_method", I, False),
        Col("score_scheme", I, False), Col("kpi_cfg_start", D), Col("kpi_cfg_end", D),
        Col("eval_start", D), Col("eval_end", D), Col("other_lv_start", D), Col("other_lv_end", D),
        Col("annual_lv_start", D), Col("annual_lv_end", D), Col("remark", S, True, 500),
        Col("created_at", TS, False), Col("updated_at", TS, False)],
        ["id"], uniques=(("code",),),
        defaults={"kpi_weight": 0, "comp_weight": 0, "ta_weight": 0, "total_weight": 100,
                  "calc_method": 1, "score_scheme": 1}),
    _t("eval_assignment", [
        Col("id", L, False), Col("form_id", L, False), Col("user_id", L, False), Col("status", I, False),
        Col("due_date", D), Col("created_at", TS, False), Col("updated_at", TS, False)],
        ["id"], uniques=(("form_id", "user_id"),),
        fks=(FK(("form_id",), "eval_form", ("id",), "cascade"),
             FK(("user_id",), "users", ("id",), "cascade")), defaults={"status": 0}),
    _t("eval_kpi_user", [
        Col("id", L, False), Col("assignment_id", L, False), Col("idx", I, False),
        Col("title", S, False, 300), Col("max_score", dec(6, 2), False), Col("weight", I, False),
        Col("expected_score", dec(6, 2)), Col("measure", S, True, 500), Col("criteria", S, True, 1000),
        Col("unit", S, True, 50), Col("code", S, True, 50), Col("score", dec(6, 2), False),
        Col("note", S, True, 1000), Col("created_at", TS, False), Col("updated_at", TS, False)],
        ["id"], fks=(FK(("assignment_id",), "eval_assignment", ("id",), "cascade"),),
        checks=(("ck_eval_kpi_user_weight", "weight between 0 and 100"),),
        defaults={"idx": 0, "max_score": 5.0, "weight": 0, "score": 0}),
    _t("eval_competency", [
        Col("id", L, False), Col("form_id", L, False), Col("idx", I, False), Col("title", S, False, 300),
        Col("max_score", dec(10, 2), False), Col("weight", dec(18, 4), False),
        Col("full_total", dec(18, 2), False), Col("expected_score", dec(10, 2), False),
        Col("created_at", TS, False), Col("updated_at", TS, False)],
        ["id"], fks=(FK(("form_id",), "eval_form", ("id",), "cascade"),),
        defaults={"idx": 0, "max_score": 0, "weight": 0, "full_total": 0, "expected_score": 0}),
    _t("eval_competency_score", [
        Col("id", L, False), Col("assignment_id", L, False), Col("comp_id", L, False),
        Col("score", dec(6, 2), False), Col("note", S, True, 1000), Col("created_at", TS, False),
        Col("updated_at", TS, False)],
        ["id"], uniques=(("assignment_id", "comp_id"),),
        fks=(FK(("assignment_id",), "eval_assignment", ("id",), "cascade"),
             FK(("comp_id",), "eval_competency", ("id",), "no action")), defaults={"score": 0}),
    _t("eval_ta_score", [
        Col("assignment_id", L, False), Col("full_score", dec(6, 2), False), Col("score", dec(6, 2), False),
        Col("updated_at", TS, False)],
        ["assignment_id"], fks=(FK(("assignment_id",), "eval_assignment", ("id",), "cascade"),),
        defaults={"full_score": 0, "score": 0}),
    _t("eval_dev_plan", [
        Col("id", L, False), Col("assignment_id", L, False), Col("idx", I, False),
        Col("content", S, False, 1000), Col("priority", S, False, 20), Col("timing", D),
        Col("remarks", S, True, 500)],
        ["id"], fks=(FK(("assignment_id",), "eval_assignment", ("id",), "cascade"),),
        defaults={"idx": 0, "priority": "High"}),
    _t("eval_additional", [
        Col("assignment_id", L, False), Col("q1", S, True, 2000), Col("q2", S, True, 2000),
        Col("q3", S, True, 2000), Col("q4", S, True, 2000), Col("q5", S, True, 2000),
        Col("updated_at", TS, False)],
        ["assignment_id"], fks=(FK(("assignment_id",), "eval_assignment", ("id",), "cascade"),)),
    _t("eval_grade_band", [
        Col("id", L, False), Col("form_id", L), Col("grade", S, False, 10), Col("min_pct", dec(5, 2), False),
        Col("max_pct", dec(5, 2), False)],
        ["id"], checks=(("ck_band_range", "min_pct <= max_pct"),)),
    _t("eval_step", [
        Col("id", L, False), Col("assignment_id", L, False), Col("idx", I, False), Col("evaluator_id", L, False),
        Col("status", I, False), Col("eval_date", D), Col("created_at", TS, False),
        Col("updated_at", TS, False)],
        ["id"], fks=(FK(("assignment_id",), "eval_assignment", ("id",), "cascade"),
                     FK(("evaluator_id",), "users", ("id",), "no action")), defaults={"status": 0}),
]}
