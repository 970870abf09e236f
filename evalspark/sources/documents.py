"""JSON request documents: declared schemas and shredding.

Documents are bound to a declared schema (never inferred, see
:mod:`evalspark.sources.binding`) and exploded with ``posexplode`` so the list
position is kept.  Missing scalars are NULL; the zero value of the type is
applied with ``coalesce`` where the reference would see it.  Integers are 64-bit
here: whether one fits its column is a question for the table, later.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.common import spread
from ..session import at_rest
from .binding import bind_at_once

KPI_ITEM = T.StructType([
    T.StructField("idx", T.LongType()), T.StructField("code", T.StringType()),
    T.StructField("title", T.StringType()), T.StructField("max_score", T.DoubleType()),
    T.StructField("weight", T.LongType()), T.StructField("expected_score", T.DoubleType()),
    T.StructField("score", T.DoubleType()), T.StructField("note", T.StringType()),
    T.StructField("measure", T.StringType()), T.StructField("criteria", T.StringType()),
    T.StructField("unit", T.StringType())])

COMP_SCORE_ITEM = T.StructType([
    T.StructField("comp_id", T.LongType()), T.StructField("score", T.DoubleType()),
    T.StructField("note", T.StringType())])

DEV_PLAN_ITEM = T.StructType([
    T.StructField("idx", T.LongType()), T.StructField("content", T.StringType()),
    T.StructField("priority", T.StringType()), T.StructField("timing", T.StringType()),
    T.StructField("remarks", T.StringType())])

QUESTIONS = ("q1", "q2", "q3", "q4", "q5")

SAVE_DOC = T.StructType([
    T.StructField("status", T.LongType()), T.StructField("due_date", T.StringType()),
    T.StructField("kpis", T.ArrayType(KPI_ITEM)),
    T.StructField("competency_scores", T.ArrayType(COMP_SCORE_ITEM)),
    T.StructField("time_attendance", T.StructType([T.StructField("full_score", T.DoubleType()),
                                                   T.StructField("score", T.DoubleType())])),
    T.StructField("development_plan", T.ArrayType(DEV_PLAN_ITEM)),
    T.StructField("additional", T.StructType([T.StructField(q, T.StringType()) for q in QUESTIONS]))])

ATTENDANCE_DOC = T.StructType([
    T.StructField("time_attendance", T.ArrayType(T.StructType([
        T.StructField("name", T.StringType()), T.StructField("value", T.StringType())]))),
    T.StructField("score_max", T.LongType()), T.StructField("score_obtained", T.LongType()),
    T.StructField("penalty_total", T.LongType())])

KPI_BULK_DOC = T.StructType([T.StructField("items", T.ArrayType(KPI_ITEM)),
                             T.StructField("due_date", T.StringType())])

COMP_ITEM = T.StructType([
    T.StructField("idx", T.LongType()), T.StructField("title", T.StringType()),
    T.StructField("max_score", T.DoubleType()), T.StructField("weight", T.DoubleType()),
    T.StructField("full_total", T.DoubleType()), T.StructField("expected_score", T.DoubleType())])
COMP_BULK_DOC = T.StructType([T.StructField("items", T.ArrayType(COMP_ITEM))])

STEP_CHAIN_DOC = T.StructType([T.StructField("evaluators", T.ArrayType(T.LongType()))])

USER_FIELDS = ("name", "email", "role", "personcode", "position", "department", "urlimage",
               "start_date", "confirm_date")
USER_DOC = T.StructType([T.StructField(f, T.StringType()) for f in USER_FIELDS + ("password",)]
                        + [T.StructField("company_ids", T.ArrayType(T.StringType()))])


def parse_or_reject(df: DataFrame, schema: T.StructType, col: str = "doc", into: str = "d") -> DataFrame:
    """``df`` with its body bound to ``into`` instead of ``col``, and ``reject``, at rest: every body is parsed once."""
    return at_rest(bind_at_once(spread(df), schema, col, into).drop(col), "bodies")


def parse(df: DataFrame, schema: T.StructType, col: str = "doc", into: str = "d") -> DataFrame:
    """The rows whose JSON body is accepted, bound to a struct column ``into`` (other columns kept), at rest."""
    return parse_or_reject(df, schema, col, into).where(F.col("reject").isNull()).drop("reject")


def rejects(df: DataFrame, schema: T.StructType, keys: list[str], col: str = "doc") -> DataFrame:
    """``keys`` and the reason of every row whose body is refused, at rest.

    All reasons are at rest before any is looked at: a filter on the reason would be moved below the
    binding and parse a body anew for each of the expression's many uses of it.
    """
    reasons = at_rest(bind_at_once(spread(df.select(*keys, col)), schema, col).select(*keys, "reject"), "reasons")
    return reasons.where(F.col("reject").isNotNull())


def explode_items(df: DataFrame, array_col: str, keys: list[str], item: str = "it") -> DataFrame:
    """One row per list element with its 0-based position ``pos``; empty lists give no rows."""
    return df.select(*keys, F.posexplode(F.col(array_col)).alias("pos", item))


def _z(c, default):
    """Go zero value for an absent JSON field."""
    return F.coalesce(c, F.lit(default))


def kpi_rows(items: DataFrame, keys: list[str]) -> DataFrame:
    """KPI list items as table-shaped columns (zero values for absent fields)."""
    i = F.col("it")
    return items.select(
        *keys, "pos", _z(i.idx, 0).alias("idx"), _z(i.code, "").alias("code"), _z(i.title, "").alias("title"),
        _z(i.max_score, 0.0).alias("max_score"), _z(i.weight, 0).alias("weight"),
        _z(i.expected_score, 0.0).alias("expected_score"), _z(i.score, 0.0).alias("score"),
        _z(i.note, "").alias("note"), _z(i.measure, "").alias("measure"),
        _z(i.criteria, "").alias("criteria"), _z(i.unit, "").alias("unit"))


def shred_save_documents(log: DataFrame, keys: list[str] | None = None) -> dict[str, DataFrame]:
    """Save documents -> kpis, competency scores, TA, development plan, additional.

    ``log`` needs ``doc`` plus the key columns (default ``seq``); every output
    carries the keys, list outputs also the element position ``pos``.
    """
    keys = keys or ["seq"]
    return shred_bound_saves(parse(log.select(*keys, "doc"), SAVE_DOC), keys)


def shred_bound_saves(p: DataFrame, keys: list[str]) -> dict[str, DataFrame]:
    """S5 over save documents that are bound already (column ``d``)."""
    kpis = kpi_rows(explode_items(p, "d.kpis", keys), keys)
    cs = explode_items(p, "d.competency_scores", keys).select(
        *keys, "pos", _z(F.col("it.comp_id"), 0).alias("comp_id"), _z(F.col("it.score"), 0.0).alias("score"),
        _z(F.col("it.note"), "").alias("note"))
    ta = p.select(*keys, _z(F.col("d.time_attendance.full_score"), 0.0).alias("full_score"),
                  _z(F.col("d.time_attendance.score"), 0.0).alias("score"))
    dp = explode_items(p, "d.development_plan", keys).select(
        *keys, "pos", _z(F.col("it.idx"), 0).alias("idx"), _z(F.col("it.content"), "").alias("content"),
        _z(F.col("it.priority"), "").alias("priority"), _z(F.col("it.timing"), "").alias("timing"),
        _z(F.col("it.remarks"), "").alias("remarks"))
    ad = p.select(*keys, *[_z(F.col(f"d.additional.{q}"), "").alias(q) for q in QUESTIONS])
    head = p.select(*keys, _z(F.col("d.status"), 0).alias("status"), _z(F.col("d.due_date"), "").alias("due_date"))
    return {"head": head, "kpis": kpis, "competency_scores": cs, "time_attendance": ta,
            "development_plan": dp, "additional": ad}


def shred_attendance(log: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Attendance payloads -> (summary per request, items per request)."""
    p = parse(log.select(*keys, "doc"), ATTENDANCE_DOC)
    summary = p.select(*keys, *[_z(F.col(f"d.{c}"), 0).alias(c)
                                for c in ("score_max", "score_obtained", "penalty_total")],
                       F.size(F.coalesce(F.col("d.time_attendance"), F.array())).alias("n_items"))
    items = explode_items(p, "d.time_attendance", keys).select(
        *keys, "pos", _z(F.col("it.name"), "").alias("name"), _z(F.col("it.value"), "").alias("value"))
    return summary, items


def shred_items(log: DataFrame, schema: T.StructType, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Bulk lists -> (items, refused).  A request with a refused body or an empty or missing list is refused."""
    p = parse_or_reject(log.select(*keys, "doc"), schema)
    n = F.coalesce(F.size(F.col("d.items")), F.lit(0))
    refused = p.where(n <= 0).select(*keys)
    items = explode_items(p.where(n > 0), "d.items", keys)
    return items, refused
