"""Table changes as pure "old table + change set -> new table" functions.

SURVEY M1-M9, W1 and A9.  Where the reference applies several requests to
one key in order, the last one (by ``seq``) wins unless noted; "last" is a
``max(struct(seq, ...))`` aggregate, which combines map-side and so never
gathers a hot key in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import blank_to_null, is_blank, local_date, try_date
from ..schemas import TABLES
from ..session import at_rest
from .common import broadcast_or_merge, latest_per_key, merged, sized_broadcast
from .unique import refused_requests


# --------------------------------------------------------------------- W1 ids
def max_id(df: DataFrame, col: str = "id") -> int:
    """Largest id in a table (0 for an empty one).  One scalar to the driver."""
    v = df.agg(F.max(col)).first()[0]
    return int(v) if v is not None else 0


def running_totals(df: DataFrame, order: list[str], weights: list[str]) -> DataFrame:
    """Add, per weight ``w``, ``before_<w>``: its sum over all rows that come earlier in ``order`` (unique).

    A distributed prefix sum without a single-partition window.  Only ``order`` and the
    weights are range-partitioned (with their partition number stored beside
    them, so that every later pass sees the same partitions); a row's total is
    that of the partitions before its own, one row each, plus a window within its partition.
    """
    keys = at_rest(df.select(*order, *weights), "totals")
    placed = at_rest(keys.repartitionByRange(*order).withColumn("__pid", F.spark_partition_id()), "placed")
    per_pid = placed.groupBy("__pid").agg(*[F.sum(w).alias(w) for w in weights])
    earlier = Window.orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_pid.select("__pid", *[F.coalesce(F.sum(w).over(earlier), F.lit(0)).alias(f"__{w}") for w in weights])
    within = Window.partitionBy("__pid").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return placed.join(F.broadcast(offsets), "__pid").select(
        *order, *[(F.col(f"__{w}") + F.coalesce(F.sum(w).over(within), F.lit(0))).cast("long").alias(f"before_{w}") for w in weights])


def assign_ids(df: DataFrame, order: list[str], start: int, id_col: str = "id") -> DataFrame:
    """Dense ids ``start+1, start+2, ...`` in ``order`` (which must be unique and hold no NULL)."""
    rows = at_rest(df, "rows")
    totals = running_totals(rows.select(*order, F.lit(1).alias("one")), order, ["one"])
    return rows.join(merged(totals), order).select(*[F.col(c) for c in df.columns], (F.lit(start) + F.col("before_one") + 1).cast("long").alias(id_col))


# ------------------------------------------------------------ K4-style checks
def within_lengths(table: str, cols: dict[str, Column]) -> Column:
    """True when every given text value fits its NVARCHAR(n) limit."""
    t = TABLES[table]
    ok = F.lit(True)
    for name, c in cols.items():
        n = t.col(name).max_len
        if n is not None:
            ok = ok & F.coalesce(F.length(c) <= n, F.lit(True))
    return ok


def fits(value: Column, precision: int, scale: int) -> Column:
    """Whether a number (or NULL) fits DECIMAL(precision, scale) once rounded."""
    return F.coalesce(value.cast("double").try_cast(f"decimal({precision},{scale})").isNotNull(), F.lit(False)) | value.isNull()


def fits_int(value: Column) -> Column:
    """Whether a 64-bit number (or NULL) fits an INT column."""
    return F.coalesce(value.between(-(1 << 31), (1 << 31) - 1), F.lit(True))


def kpi_item_valid(code: Column, title: Column, weight: Column, note: Column, measure: Column,
                   criteria: Column, unit: Column, *scores: Column) -> Column:
    """A KPI row the table accepts: CHECK weight 0..100, text lengths and ``scores`` in range."""
    ok = weight.between(0, 100) & within_lengths(
        "eval_kpi_user", {"code": code, "title": title, "note": note, "measure": measure,
                          "criteria": criteria, "unit": unit})
    for s in scores:
        ok = ok & fits(s, 6, 2)
    return ok


# ----------------------------------------------------------------- M1 append
def append_children(base: DataFrame, rows: DataFrame, parent_key: str, order: list,
                    as_of_ts: str, stamp_col: str = "updated_at", parents: DataFrame | None = None) -> DataFrame:
    """M1: append ``rows`` with new dense ids and stamp every row of a touched parent.

    ``rows`` carry the table's columns except ``id``; ids continue after the
    current maximum in ``order``.  ``updated_at`` of *all* rows of a parent
    that received rows is set to ``as_of_ts`` (the reference stamps the whole
    child set).  Rows that have their ids already (numbered per request, see
    :func:`running_totals`) are taken as they are, with the ``parents`` that they touch.
    """
    new = rows if "id" in rows.columns else assign_ids(rows, order, max_id(base))
    parents = new if parents is None else parents
    cols = [c for c in base.columns]
    new = new.select(*[F.col(c) if c in new.columns else F.lit(None).cast(base.schema[c].dataType).alias(c)
                       for c in cols])
    touched = sized_broadcast(parents.select(F.col(parent_key).alias("__p")).distinct().withColumn("__t", F.lit(True)))
    allrows = base.unionByName(new)
    j = allrows.join(touched, allrows[parent_key] == touched["__p"], "left")
    return j.select(*[F.when(F.col("__t"), F.lit(as_of_ts).cast(base.schema[stamp_col].dataType))
                      .otherwise(F.col(stamp_col)).alias(c) if c == stamp_col else F.col(c) for c in cols])


# ---------------------------------------------------------------- M2 replace
def replace_children(base: DataFrame, parents: DataFrame, rows: DataFrame, parent_key: str) -> DataFrame:
    """M2: delete every child of ``parents`` and insert ``rows``.

    ``parents`` and ``rows`` are separate inputs so a parent whose new list is
    empty still loses its old rows.
    """
    keep = base.join(broadcast_or_merge(parents.select(parent_key).distinct()), parent_key, "left_anti")
    return keep.unionByName(rows.select(*base.columns))


# ----------------------------------------------------------------- M3 upsert
def upsert(base: DataFrame, changes: DataFrame, keys: list[str], order_col: str = "seq") -> DataFrame:
    """M3: one row per key (MERGE): the latest change replaces or inserts."""
    last = latest_per_key(changes, keys, order_col).drop(order_col)
    keep = base.join(broadcast_or_merge(last.select(*keys)), keys, "left_anti")
    return keep.unionByName(last.select(*base.columns))


# ---------------------------------------------------------- M4 get-or-create
def ensure_assignments(assignments: DataFrame, requests: DataFrame, as_of_ts: str,
                       forms: DataFrame | None = None, users: DataFrame | None = None,
                       id_floor: int = 0) -> DataFrame:
    """M4: apply EnsureAssignment requests (seq, form_id, user_id, due_date[, ts]) in order.

    Existing pair: the last non-blank due that parses wins (a bad date's
    update fails and keeps the old value).  New pair: created by its first
    request whose due is blank or parses (a bad date fails the insert), with
    status 0 and due = that date or, when blank, the request day in
    Asia/Bangkok; later parsable dues overwrite it.  With ``forms`` /
    ``users`` given, a pair naming a missing form or user is never created
    (the insert breaks a foreign key).  New ids are dense after the current
    maximum (or ``id_floor`` when only part of the table is given), in order
    of the creating request.
    """
    ts = F.col("ts") if "ts" in requests.columns else F.lit(as_of_ts)
    r = requests.select("seq", "form_id", "user_id", ts.alias("ts"),
                        is_blank("due_date").alias("blank"), try_date("due_date").alias("due"))
    per_key = r.groupBy("form_id", "user_id").agg(
        F.max_by("due", F.when(F.col("due").isNotNull(), F.col("seq"))).alias("last_due"),
        F.min(F.when(F.col("blank") | F.col("due").isNotNull(),
                     F.struct("seq", "ts", "due"))).alias("creator"))
    return ensured(assignments, per_key, forms, users, id_floor)


def ensured(assignments: DataFrame, per_key: DataFrame, forms: DataFrame | None = None, users: DataFrame | None = None,
            id_floor: int = 0) -> DataFrame:
    """M4 from what requests come to per pair (form_id, user_id): ``last_due``, and the ``creator`` (seq, ts, due) or NULL."""
    a = assignments.select("id", "form_id", "user_id", "status", "due_date")
    known = per_key.join(merged(a.select("form_id", "user_id", F.lit(True).alias("exists"))),
                         ["form_id", "user_id"], "left")
    existing_upd = known.where(F.col("exists")).select("form_id", "user_id", "last_due")
    created = known.where(F.col("exists").isNull() & F.col("creator").isNotNull())
    created = with_parents(created, forms, users)
    created = assign_ids(created.select("form_id", "user_id", "last_due", F.col("creator.seq").alias("c_seq"),
                                        F.col("creator.ts").alias("c_ts"), F.col("creator.due").alias("c_due")),
                         ["c_seq"], max(max_id(assignments), id_floor))
    new_rows = created.select(
        "id", "form_id", "user_id", F.lit(0).alias("status"),
        F.coalesce("last_due", "c_due", local_date(F.col("c_ts"))).alias("due_date"))
    upd = a.join(merged(existing_upd), ["form_id", "user_id"], "left").select(
        "id", "form_id", "user_id", "status", F.coalesce("last_due", "due_date").alias("due_date"))
    return upd.unionByName(new_rows)


def with_parents(pairs: DataFrame, forms: DataFrame | None, users: DataFrame | None) -> DataFrame:
    """Keep (form_id, user_id) pairs whose form and user exist (the assignment FKs)."""
    if forms is not None:
        pairs = pairs.join(broadcast_or_merge(forms.select(F.col("id").alias("form_id"))), "form_id", "left_semi")
    if users is not None:
        pairs = pairs.join(broadcast_or_merge(users.select(F.col("id").alias("user_id"))), "user_id", "left_semi")
    return pairs


# --------------------------------------------------------- M5 / M6 / A9 owned
def _owned(children: DataFrame, assignments: DataFrame, changes: DataFrame, child_key: str) -> DataFrame:
    """Changes (seq, <child_key>, form_id, user_id, ...) whose child belongs to (form_id, user_id)."""
    wanted = sized_broadcast(changes.select(F.col(child_key).alias("id")).distinct())
    # only the named children reach the assignment join; the child table is not shuffled by assignment
    owner = children.select("id", "assignment_id").join(wanted, "id", "left_semi").select(
        F.col("id").alias(child_key), "assignment_id").join(
        assignments.select(F.col("id").alias("assignment_id"), F.col("form_id").alias("__f"),
                           F.col("user_id").alias("__u")), "assignment_id")
    j = changes.join(owner, child_key)
    return j.where((F.col("form_id") == F.col("__f")) & (F.col("user_id") == F.col("__u"))).drop("__f", "__u")


def update_owned_kpis(kpis: DataFrame, assignments: DataFrame, changes: DataFrame,
                      as_of_ts: str) -> tuple[DataFrame, DataFrame]:
    """M5: full overwrite of 11 KPI fields where (form_id, user_id) owns the KPI.

    Returns (new table, per-request report with ``updated``).  A change that
    breaks a table rule (weight outside 0..100, text too long) leaves the row
    as it was; several changes to one KPI apply in ``seq`` order, so the last
    valid one wins.
    """
    valid = kpi_item_valid(F.col("code"), F.col("title"), F.col("weight"), F.col("note"),
                           F.col("measure"), F.col("criteria"), F.col("unit"),
                           F.col("max_score"), F.col("expected_score"), F.col("score"))
    auth = _owned(kpis, assignments, changes, "kpi_id").where(valid)
    fields = ["idx", "code", "title", "max_score", "weight", "expected_score", "score", "note",
              "measure", "criteria", "unit"]
    last = latest_per_key(auth.select("kpi_id", "seq", *fields), ["kpi_id"])
    t = TABLES["eval_kpi_user"]
    blanks = {"code", "note", "measure", "criteria", "unit"}
    newv = last.select(
        F.col("kpi_id").alias("id"), F.lit(True).alias("__upd"),
        *[(blank_to_null(f) if f in blanks else F.col(f)).try_cast(t.col(f).dtype).alias("__n_" + f) for f in fields])
    j = kpis.join(newv, "id", "left")
    out = j.select(*[F.when(F.col("__upd"), F.col("__n_" + c)).otherwise(F.col(c)).alias(c) if c in fields
                     else (F.when(F.col("__upd"), F.lit(as_of_ts).cast("timestamp")).otherwise(F.col(c)).alias(c)
                           if c == "updated_at" else F.col(c)) for c in kpis.columns])
    report = changes.select("seq", "kpi_id").join(
        auth.select("seq", F.lit(True).alias("updated")), "seq", "left").select(
        "seq", "kpi_id", F.coalesce("updated", F.lit(False)).alias("updated"))
    return out, report


def delete_owned_kpis(kpis: DataFrame, assignments: DataFrame, deletes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """M6 + A9: delete KPIs owned by the requesting (form_id, user_id).

    Returns (remaining rows, report).  The report says per request whether it
    removed a row (rows affected > 0): only the first owning request for a
    KPI does; a later one finds nothing.
    """
    auth = _owned(kpis, assignments, deletes, "kpi_id")
    first = auth.groupBy("kpi_id").agg(F.min("seq").alias("seq"))
    remaining = kpis.join(first.select(F.col("kpi_id").alias("id")), "id", "left_anti")
    report = deletes.select("seq", "kpi_id").join(first.withColumn("deleted", F.lit(True)),
                                                  ["kpi_id", "seq"], "left").select(
        "seq", "kpi_id", F.coalesce("deleted", F.lit(False)).alias("deleted"))
    return remaining, report


# ------------------------------------------------------------------ M7 patch
PATCH_MAP = {  # document field -> users column (fixed by the reference's JSON tags)
    "name": "name", "email": "email", "role": "role", "personcode": "person_code", "position": "position",
    "department": "department", "urlimage": "url_image", "start_date": "start_date",
    "confirm_date": "confirm_date"}


def dates_parse(*names: str) -> Column:
    """Every given text is blank or a date."""
    ok = F.lit(True)
    for n in names:
        ok = ok & (is_blank(n) | try_date(n).isNotNull())
    return ok


def patch_users(users: DataFrame, user_companies: DataFrame, companies: DataFrame,
                patches: DataFrame) -> tuple[DataFrame, DataFrame]:
    """M7: presence-aware patches (seq, user_id, fields..., company_ids) applied in order.

    A field takes the value of the last patch that supplies it; absent (NULL)
    keeps the stored value.  Dates: '' -> NULL, text -> date.  The company
    list of a user is replaced only by a patch that supplies ``company_ids``
    (an empty list clears it); unknown or repeated ids are skipped.  Patches
    for unknown users, with over-long text, with a date that does not parse or
    with an email or person code that another user holds at that moment
    fail and change nothing.
    """
    u = users
    p = patches.join(u.select(F.col("id").alias("user_id")), "user_id", "left_semi")
    p = p.where(within_lengths("users", {PATCH_MAP[f]: F.col(f) for f in PATCH_MAP
                                         if f not in ("start_date", "confirm_date")}))
    p = at_rest(p.where(dates_parse("start_date", "confirm_date")), "patches")
    asked = p.where(F.col("email").isNotNull() | F.col("personcode").isNotNull()).select(
        "seq", F.col("user_id").alias("owner"), "email", "personcode")
    held = u.select(F.col("id").alias("owner"), "email", F.col("person_code").alias("personcode"))
    p = p.join(sized_broadcast(refused_requests(asked, held, ["email", "personcode"])), "seq", "left_anti")
    aggs = [F.max_by(F.col(f), F.when(F.col(f).isNotNull(), F.col("seq"))).alias("__p_" + f) for f in PATCH_MAP]
    aggs.append(F.max_by(F.col("company_ids"), F.when(F.col("company_ids").isNotNull(), F.col("seq")))
                .alias("__p_company_ids"))
    last = at_rest(p.groupBy("user_id").agg(*aggs), "last-patches")
    j = u.join(last, u["id"] == last["user_id"], "left")
    out_cols = []
    for c in u.columns:
        src = next((f for f, col in PATCH_MAP.items() if col == c), None)
        if src is None:
            out_cols.append(F.col(c))
        elif c in ("start_date", "confirm_date"):
            pv = F.col("__p_" + src)
            out_cols.append(F.when(pv.isNotNull(), try_date(pv)).otherwise(F.col(c)).alias(c))
        else:
            out_cols.append(F.coalesce(F.col("__p_" + src), F.col(c)).cast(u.schema[c].dataType).alias(c))
    new_users = j.select(*out_cols)
    lists = last.where(F.col("__p_company_ids").isNotNull()).select("user_id", "__p_company_ids")
    links = (lists.select("user_id", F.explode("__p_company_ids").alias("cid"))
             .select("user_id", F.col("cid").try_cast("long").alias("company_id"))
             .join(sized_broadcast(companies.select(F.col("id").alias("company_id"))), "company_id", "left_semi")
             .dropDuplicates(["user_id", "company_id"]))
    new_links = replace_children(user_companies.select("user_id", "company_id"), lists, links, "user_id")
    return new_users, new_links


# ----------------------------------------------------------------- M8 create
def first_come(requests: DataFrame, keys: list[str], order: str = "seq", held: DataFrame | None = None) -> DataFrame:
    """The requests that are accepted one after the other: none whose value in a key an earlier accepted one
    (or a row of ``held``) holds.  Every request is an owner of its own, which gives nothing up."""
    rest = at_rest(requests, "requests")
    asked = rest.select(F.col(order).alias("seq"), (-F.col(order) - 1).alias("owner"), *keys)
    if held is None:
        held = asked.where(F.lit(False)).select("owner", *keys)
    refused = refused_requests(asked, held.select("owner", *keys), keys)
    return rest.join(sized_broadcast(refused.select(F.col("seq").alias(order))), order, "left_anti")


def create_users(users: DataFrame, companies: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """M8: create users (seq, fields..., company_ids) with company links.

    A request fails when its email or person code is already taken (by a
    stored user or an earlier request that was itself accepted), text is too
    long or a date does not parse.  New ids are
    dense in ``seq`` order.  Each link to an unknown company, or repeated, is
    silently skipped.  Returns (new user rows, new link rows).
    """
    r = requests.where(within_lengths("users", {PATCH_MAP[f]: F.col(f) for f in PATCH_MAP
                                                if f not in ("start_date", "confirm_date")}))
    held = users.select(F.col("id").alias("owner"), "email", F.col("person_code").alias("personcode"))
    r = first_come(r.where(dates_parse("start_date", "confirm_date")), ["email", "personcode"], held=held)
    created = assign_ids(r, ["seq"], max_id(users))
    new_users = created.select(
        "id", "seq", F.col("name"), F.col("email"), F.col("role"), F.col("personcode").alias("person_code"),
        "position", "department", F.col("urlimage").alias("url_image"),
        try_date("start_date").alias("start_date"), try_date("confirm_date").alias("confirm_date"),
        F.lit(0).alias("years_of_work"))
    links = (created.select(F.col("id").alias("user_id"), F.explode_outer("company_ids").alias("cid"))
             .select("user_id", F.col("cid").try_cast("long").alias("company_id"))
             .join(sized_broadcast(companies.select(F.col("id").alias("company_id"))), "company_id", "left_semi")
             .dropDuplicates(["user_id", "company_id"])
             .select("user_id", "company_id"))
    return new_users, links


# ---------------------------------------------------------------- M9 cascade
ASSIGNMENT_CHILDREN = ("eval_kpi_user", "eval_competency_score", "eval_ta_score", "eval_dev_plan",
                       "eval_additional", "eval_step")
USER_CHILDREN = ("user_companies", "user_time_attendance", "user_time_attendance_items")


def reaching(hops: DataFrame, start: DataFrame) -> DataFrame:
    """(uid) of all nodes that reach ``start`` (uid) over ``hops`` (a -> b).

    Paths are doubled: after k rounds every node at a distance below 2^k is
    found and ``hops`` joins nodes that are 2^k apart, so rounds grow with the
    logarithm of the longest path.  A round first asks for single hops and
    ends when these find nobody, so that wide, shallow graphs are never multiplied.
    """
    one = hops = at_rest(hops, "hops")
    found = at_rest(start, "reach")
    while True:
        def into(edges, found=found):
            new = edges.join(found.select(F.col("uid").alias("b")), "b", "left_semi").select(F.col("a").alias("uid"))
            return new.distinct().join(found, "uid", "left_anti")

        if into(one).isEmpty():
            return found
        found = at_rest(found.unionByName(into(hops)), "reach")
        hops = at_rest(hops.join(hops.select(F.col("a").alias("b"), F.col("b").alias("c")), "b").select(
            "a", F.col("c").alias("b")).distinct(), "hops")


def cascade_delete_users(tables: dict[str, DataFrame], ids: DataFrame,
                         ) -> tuple[dict[str, DataFrame], DataFrame]:
    """M9: delete users with ON DELETE CASCADE; refuse users still named as evaluator.

    ``eval_step.evaluator_id`` has no cascade, so a user who evaluates a step
    that survives the delete is refused.  Steps of the deleted users' own
    assignments go with the cascade.  Refusing one user keeps their
    assignments (and steps) alive, which can refuse others: whoever reaches a
    refused user through the evaluator -> owner pairs is refused (:func:`reaching`).
    Returns (tables after the delete, the user ids actually deleted).
    """
    steps = tables["eval_step"].select("assignment_id", "evaluator_id")
    a_user = tables["eval_assignment"].select(F.col("id").alias("assignment_id"), F.col("user_id").alias("owner"))
    want = at_rest(ids.select(F.col("user_id").alias("uid")).distinct(), "delete")
    named = sized_broadcast(want)
    pairs = (steps.join(named.withColumnRenamed("uid", "evaluator_id"), "evaluator_id", "left_semi")
             .join(a_user, "assignment_id").select("evaluator_id", "owner").distinct())
    pairs = at_rest(pairs.join(named.select(F.col("uid").alias("owner"), F.lit(True).alias("goes")), "owner", "left"), "evaluates")
    stays = pairs.where("goes IS NULL").select(F.col("evaluator_id").alias("uid")).distinct()
    hops = pairs.where("goes").select(F.col("evaluator_id").alias("a"), F.col("owner").alias("b"))
    deleting = want.join(sized_broadcast(reaching(hops, stays)), "uid", "left_anti")
    gone_users = deleting.select(F.col("uid").alias("id"))
    out = dict(tables)
    out["users"] = tables["users"].join(gone_users, "id", "left_anti")
    for t in USER_CHILDREN:
        if t in tables:
            out[t] = tables[t].join(gone_users.select(F.col("id").alias("user_id")), "user_id", "left_anti")
    gone_a = tables["eval_assignment"].join(gone_users.select(F.col("id").alias("user_id")), "user_id",
                                            "left_semi").select(F.col("id").alias("assignment_id"))
    out["eval_assignment"] = tables["eval_assignment"].join(
        gone_users.select(F.col("id").alias("user_id")), "user_id", "left_anti")
    for t in ASSIGNMENT_CHILDREN:
        if t in tables:
            out[t] = tables[t].join(gone_a, "assignment_id", "left_anti")
    return out, deleting.select(F.col("uid").alias("user_id"))
