"""Request logs applied to tables: the set-based form of the reference's handlers.

Each function takes the current tables and a log of requests (one row per
request, ordered by ``seq``, JSON body in ``doc`` where the reference parses
one) and returns new table versions.  Validation mirrors what makes the
reference's statement fail; a failed request changes nothing it would have
rolled back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import blank_to_null, is_blank, try_date
from ..session import at_rest
from ..sources import documents as docs
from ..sources.tables import conform
from . import changes
from .common import latest_per_key, sized_broadcast


def _kpi_requests(log: DataFrame) -> DataFrame:
    """KPI bulk requests with a list (seq, form_id, user_id, due_date, items, n, ok), at rest: parsed once."""
    p = docs.parse(log.select("seq", "form_id", "user_id", "doc"), docs.KPI_BULK_DOC)
    items = F.coalesce("d.items", F.array())
    ok = F.forall(items, lambda i: changes.fits_int(i["idx"]) & changes.kpi_item_valid(
        i["code"], i["title"], F.coalesce(i["weight"], F.lit(0)), i["note"], i["measure"], i["criteria"], i["unit"],
        i["max_score"], i["expected_score"], i["score"]) | i.isNull())
    return p.select("seq", "form_id", "user_id", F.coalesce("d.due_date", F.lit("")).alias("due_date"), F.col("d.items").alias("items"),
                    F.size(items).alias("n"), F.coalesce(ok, F.lit(False)).alias("ok")).where(F.col("n") > 0)


def _numbered(requests: DataFrame, placed: DataFrame, start: int) -> DataFrame:
    """``placed`` (seq, assignment_id, n) with ``first_id``, joined to the items of their requests.

    Ids are dense in request order: the items of all earlier requests, then the
    position.  Only requests are ordered; item rows are never sorted.
    """
    totals = changes.running_totals(placed, ["seq"], ["n"])
    keys = at_rest(placed.select("seq", "assignment_id").join(totals, "seq").select(
        "seq", "assignment_id", (F.lit(start) + F.col("before_n") + 1).alias("first_id")), "numbered")
    return requests.select("seq", "items").join(sized_broadcast(keys), "seq")


def _kpi_table_rows(numbered: DataFrame, code_blank_to_null: bool) -> DataFrame:
    rows = docs.kpi_rows(docs.explode_items(numbered, "items", ["assignment_id", "first_id"]), ["assignment_id", "first_id"])
    code = blank_to_null("code") if code_blank_to_null else F.col("code")
    return rows.select(
        (F.col("first_id") + F.col("pos")).alias("id"), "assignment_id", F.col("idx").try_cast("int").alias("idx"), code.alias("code"), "title",
        F.col("max_score").try_cast("decimal(6,2)").alias("max_score"), F.col("weight").try_cast("int").alias("weight"),
        F.col("expected_score").try_cast("decimal(6,2)").alias("expected_score"),
        F.col("score").try_cast("decimal(6,2)").alias("score"),
        *[blank_to_null(c).alias(c) for c in ("note", "measure", "criteria", "unit")])


def append_kpi_requests(tables: dict[str, DataFrame], log: DataFrame, as_of_ts: str) -> dict[str, DataFrame]:
    """M1 (AddMyKPIsBulk): requests (seq, form_id, user_id, doc{items, due_date}).

    Empty lists are refused before anything happens.  Otherwise the
    assignment is ensured (M4) and the items appended with new ids; a request
    with any invalid item appends nothing (the insert transaction rolls back)
    but its assignment stays.  ``code`` '' is kept on append.
    """
    req = _kpi_requests(log)
    a1 = changes.ensure_assignments(tables["eval_assignment"], req.drop("items"), as_of_ts,
                                    tables.get("eval_form"), tables.get("users"))
    placed = req.where("ok").select("seq", "form_id", "user_id", "n").join(
        a1.select(F.col("id").alias("assignment_id"), "form_id", "user_id"), ["form_id", "user_id"])
    base = conform(tables["eval_kpi_user"], "eval_kpi_user")
    numbered = _numbered(req, at_rest(placed.select("seq", "assignment_id", "n"), "placed"), changes.max_id(base))
    new = _kpi_table_rows(numbered, code_blank_to_null=False)
    out = dict(tables)
    out["eval_assignment"] = a1
    out["eval_kpi_user"] = changes.append_children(base, new, "assignment_id", ["id"], as_of_ts,
                                                   parents=numbered.select("assignment_id"))
    return out


def replace_kpi_requests(tables: dict[str, DataFrame], log: DataFrame, as_of_ts: str) -> dict[str, DataFrame]:
    """M2 (ReplaceMyKPIs): each valid non-empty request replaces the assignment's KPIs.

    Requests apply in order, so the last valid one per assignment decides the
    final list; ``code`` '' becomes NULL on replace.  New ids are dense over
    the surviving rows in (seq, position) order.
    """
    req = _kpi_requests(log)
    a1 = changes.ensure_assignments(tables["eval_assignment"], req.drop("items"), as_of_ts,
                                    tables.get("eval_form"), tables.get("users"))
    good = req.where("ok").select("seq", "form_id", "user_id", "n").join(
        a1.select(F.col("id").alias("assignment_id"), "form_id", "user_id"), ["form_id", "user_id"])
    last = at_rest(good.groupBy("assignment_id").agg(F.max(F.struct("seq", "n")).alias("m")).select(
        F.col("m.seq").alias("seq"), "assignment_id", F.col("m.n").alias("n")), "last")
    base = conform(tables["eval_kpi_user"], "eval_kpi_user")
    new = _kpi_table_rows(_numbered(req, last, changes.max_id(base)), code_blank_to_null=True)
    new = new.withColumn("updated_at", F.lit(as_of_ts).cast("timestamp"))
    shaped = new.select(*[(F.col(f.name) if f.name in new.columns else F.lit(None)).cast(f.dataType).alias(f.name)
                          for f in base.schema.fields])
    out = dict(tables)
    out["eval_assignment"] = a1
    out["eval_kpi_user"] = changes.replace_children(base, last.select("assignment_id"), shaped, "assignment_id")
    return out


def attendance_requests(tables: dict[str, DataFrame], log: DataFrame) -> dict[str, DataFrame]:
    """M3 + M2 (attendance Upsert): requests (seq, user_id, doc).

    A request fails for an unknown user (FK), a repeated item name (PK),
    over-long text or a number over its column; then neither summary nor items change.  The last valid
    request per user upserts the summary and replaces the whole item list
    (an empty list removes the old items).
    """
    summary, items = docs.shred_attendance(log, ["seq", "user_id"])
    users = tables["users"].select(F.col("id").alias("user_id"))
    dup = items.groupBy("seq", "name").count().where(F.col("count") > 1).select("seq")
    too_long = items.where(~changes.within_lengths("user_time_attendance_items",
                                                   {"name": F.col("name"), "value": F.col("value")})).select("seq")
    numbers = ("score_max", "score_obtained", "penalty_total")
    too_large = summary.where(~(changes.fits_int(F.col(numbers[0])) & changes.fits_int(F.col(numbers[1])) & changes.fits_int(F.col(numbers[2])))).select("seq")
    bad = dup.union(too_long).union(too_large).distinct()
    good = summary.join(users, "user_id", "left_semi").join(bad, "seq", "left_anti")
    last = latest_per_key(good.select("seq", "user_id", *[F.col(c).try_cast("int").alias(c) for c in numbers]), ["user_id"])
    out = dict(tables)
    out["user_time_attendance"] = changes.upsert(tables["user_time_attendance"], last, ["user_id"])
    new_items = items.join(last.select("seq"), "seq", "left_semi").select("user_id", "name", "value")
    out["user_time_attendance_items"] = changes.replace_children(
        tables["user_time_attendance_items"], last.select("user_id"), new_items, "user_id")
    return out


def append_competency_requests(tables: dict[str, DataFrame], log: DataFrame, as_of_ts: str) -> DataFrame:
    """M1 (AddCompsBulk): requests (seq, form_id, doc{items}) append competencies to a form.

    Empty lists are refused; a request with an over-long title or a number out
    of range appends nothing.  All competencies of a touched form get ``updated_at``.
    """
    numbers = {"max_score": (10, 2), "weight": (18, 4), "full_total": (18, 2), "expected_score": (10, 2)}
    p = docs.parse(log.select("seq", "form_id", "doc"), docs.COMP_BULK_DOC)
    items = F.coalesce("d.items", F.array())

    def good(i):
        ok = changes.fits_int(i["idx"]) & changes.within_lengths("eval_competency", {"title": i["title"]})
        for c, (precision, scale) in numbers.items():
            ok = ok & changes.fits(i[c], precision, scale)
        return ok

    req = p.where((F.size(items) > 0) & F.forall(items, good)).select(
        "seq", F.col("form_id").alias("assignment_id"), F.col("d.items").alias("items"), F.size(items).alias("n"))
    base = conform(tables["eval_competency"], "eval_competency")
    numbered = _numbered(req, req.select("seq", "assignment_id", "n"), changes.max_id(base))
    it = F.col("it")
    rows = docs.explode_items(numbered, "items", ["assignment_id", "first_id"]).select(
        (F.col("first_id") + F.col("pos")).alias("id"), F.col("assignment_id").alias("form_id"),
        F.coalesce(it.idx, F.lit(0)).try_cast("int").alias("idx"), F.coalesce(it.title, F.lit("")).alias("title"),
        *[F.coalesce(it[c], F.lit(0.0)).try_cast(f"decimal({precision},{scale})").alias(c) for c, (precision, scale) in numbers.items()])
    return changes.append_children(base, rows, "form_id", ["id"], as_of_ts,
                                   parents=numbered.select(F.col("assignment_id").alias("form_id")))


def prepare_forms(forms: DataFrame, requests: DataFrame) -> DataFrame:
    """P8 (CreateForm): form creation requests -> new eval_form rows.

    total_weight 0 -> 100 (handler default), '' -> NULL for the dates and
    remark (title_en is stored as sent); a request fails on a taken code
    (stored or earlier in the log),
    a date that does not parse, or over-long text.  Ids dense in seq order.
    """
    r = requests
    date_cols = [c for c in ("kpi_cfg_start", "kpi_cfg_end", "eval_start", "eval_end", "other_lv_start",
                             "other_lv_end", "annual_lv_start", "annual_lv_end") if c in r.columns]
    bad_date = F.lit(False)
    for c in date_cols:
        bad_date = bad_date | ((~is_blank(c)) & try_date(c).isNull())
    text_ok = changes.within_lengths("eval_form", {c: F.col(c) for c in ("code", "title_th", "title_en", "remark")
                                                   if c in r.columns})
    r = r.where(~bad_date & text_ok)
    r = r.join(forms.select(F.col("code")), "code", "left_anti")
    first = r.groupBy("code").agg(F.min("seq").alias("seq"))
    r = r.join(first, ["code", "seq"], "left_semi")
    created = changes.assign_ids(r, ["seq"], changes.max_id(forms))
    return created.select(
        "id", "seq", "code", "title_th", "title_en",
        "kpi_weight", "comp_weight", "ta_weight",
        F.when(F.col("total_weight") == 0, F.lit(100)).otherwise(F.col("total_weight")).alias("total_weight"),
        "calc_method", "score_scheme", *[try_date(c).alias(c) for c in date_cols],
        blank_to_null("remark").alias("remark"))


def upsert_ta_from_saves(tables: dict[str, DataFrame], log: DataFrame) -> DataFrame:
    """M3 (TA MERGE in SaveAll): the latest TA score of each assignment named in the log."""
    sh = docs.shred_save_documents(log.select("seq", "doc"), ["seq"])
    a = tables["eval_assignment"].select(F.col("id").alias("assignment_id"), "form_id", "user_id")
    ta = (sh["time_attendance"].join(log.select("seq", "form_id", "user_id"), "seq")
          .join(a, ["form_id", "user_id"])
          .where(changes.fits(F.col("full_score"), 6, 2) & changes.fits(F.col("score"), 6, 2))
          .select("seq", "assignment_id", F.col("full_score").try_cast("decimal(6,2)").alias("full_score"),
                  F.col("score").try_cast("decimal(6,2)").alias("score")))
    return changes.upsert(tables["eval_ta_score"], ta, ["assignment_id"])


def user_requests_parsed(log: DataFrame) -> DataFrame:
    """User create / patch bodies -> one column per field (NULL = absent)."""
    p = docs.parse(log, docs.USER_DOC)
    return p.select(*[c for c in log.columns if c != "doc"],
                    *[F.col(f"d.{f}").alias(f) for f in docs.USER_FIELDS], F.transform("d.company_ids", lambda c: F.coalesce(c, F.lit(""))).alias("company_ids"))


def create_user_requests(tables: dict[str, DataFrame], log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """M8: create users from request bodies; returns (new users, new links)."""
    r = user_requests_parsed(log)
    r = r.select("seq", *[F.coalesce(F.col(f), F.lit("")).alias(f) for f in docs.USER_FIELDS], "company_ids")
    return changes.create_users(conform(tables["users"], "users"), tables["companies"], r)


def patch_user_requests(tables: dict[str, DataFrame], log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """M7: patch users from request bodies; returns (users, user_companies)."""
    r = user_requests_parsed(log)
    return changes.patch_users(conform(tables["users"], "users"), tables["user_companies"],
                               tables["companies"], r)



def step_chain_requests(tables: dict[str, DataFrame], log: DataFrame, as_of_ts: str) -> dict[str, DataFrame]:
    """W2 handler: requests (seq, form_id, user_id, doc{evaluators}).

    The assignment is ensured first for every request (before the body is
    checked, as in the reference), then valid chains are appended as steps.
    Returns the new ``eval_assignment`` and ``eval_step`` plus ``new_steps``.
    """
    from .workflow import build_steps
    req = log.select("seq", "form_id", "user_id", F.lit("").alias("due_date"))
    a1 = changes.ensure_assignments(tables["eval_assignment"], req, as_of_ts,
                                    tables.get("eval_form"), tables.get("users"))
    new = build_steps(log, a1, tables["users"], tables["eval_step"])
    steps = tables["eval_step"]
    shaped = new.select(*[(F.col(f.name) if f.name in new.columns else F.lit(None)).cast(f.dataType).alias(f.name)
                          for f in steps.schema.fields])
    return {"eval_assignment": a1, "eval_step": steps.unionByName(shaped), "new_steps": new}
