"""Save/submit workflow over ordered request logs.

The reference handles one HTTP request at a time.  Here a request log (one
row per request, ordered by ``seq``) is resolved for all users and forms at
once.  The lock makes the save log set-based: once a save with status 2 is
accepted for a (user, form), every later save is refused, so

    accepted = valid AND not locked before the log
               AND seq <= first valid submit of that key

which is a per-key ``min`` aggregate, not a sequential scan.  The last
accepted save of a key is the only one whose children survive (each save
replaces them wholesale), and it is the only possible submit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import blank_to_null, is_blank, normalize_status, today_utc, try_date
from ..session import at_rest
from ..sources import documents as docs
from ..sources.tables import save_touched
from . import changes
from .common import broadcast_or_merge, merged, sized_broadcast
from .grading import assign_grade
from .scoring import attendance_percent, competency_percent, kpi_percent

LOCKED = 2  # fixed value: stored assignment status that locks saves


# ----------------------------------------------------------- W2 step chain
def build_steps(requests: DataFrame, assignments: DataFrame, users: DataFrame, steps: DataFrame) -> DataFrame:
    """Create step chains from requests (seq, form_id, user_id, doc{"evaluators":[...]}).

    Chain = the requester, then the evaluators in order; idx 1..n, the first
    step active (1), the rest waiting (0).  A request with no evaluators, or
    naming a user that does not exist (the evaluator FK), creates nothing.
    Calling twice duplicates idx (no unique key) - kept.  New ids are dense in
    (seq, position) order; the evaluator name comes from a left join (J8).
    """
    p = docs.parse(requests.select("seq", "form_id", "user_id", "doc"), docs.STEP_CHAIN_DOC)
    p = p.where(F.coalesce(F.size("d.evaluators"), F.lit(0)) > 0)
    chain = p.select("seq", "form_id", "user_id",
                     F.posexplode(F.concat(F.array(F.col("user_id").cast("long")), F.transform("d.evaluators", lambda e: F.coalesce(e, F.lit(0)))))
                     .alias("pos", "evaluator_id"))
    u = users.select(F.col("id").alias("evaluator_id"), F.col("name").alias("evaluator_name"))
    known = chain.join(sized_broadcast(u), "evaluator_id", "left")
    bad = known.where(F.col("evaluator_name").isNull()).select("seq").distinct()
    a = assignments.select(F.col("id").alias("assignment_id"), "form_id", "user_id")
    good = at_rest(p.select("seq", "form_id", "user_id", (F.size("d.evaluators") + 1).alias("n")).join(bad, "seq", "left_anti")
                   .join(a, ["form_id", "user_id"]).select("seq", "assignment_id", "n"), "chains")
    first = good.join(changes.running_totals(good, ["seq"], ["n"]), "seq").select(
        "seq", "assignment_id", (F.lit(changes.max_id(steps)) + F.col("before_n") + 1).alias("first_id"))
    return known.join(first, "seq").select(
        (F.col("first_id") + F.col("pos")).alias("id"), "assignment_id", (F.col("pos") + 1).cast("int").alias("idx"), "evaluator_id",
        "evaluator_name", F.when(F.col("pos") == 0, 1).otherwise(0).cast("int").alias("status"))


# -------------------------------------------------------- W3 submit advance
def advance_steps(steps: DataFrame, submitted: DataFrame, as_of_ts: str) -> DataFrame:
    """On submit, close the earliest active step and open the next idx.

    For each submitted assignment: the active (1) step with the lowest idx
    (then id) -> done (2), eval_date = UTC day of ``as_of_ts``; steps with the
    next idx still waiting (0) -> active.  No active step: steps with idx 1
    still waiting -> active.  Only idx+1 opens, so a gap stops the chain and a
    duplicated idx opens several rows.
    """
    s = steps if "eval_date" in steps.columns else steps.withColumn("eval_date", F.lit(None).cast("date"))
    sub = submitted.select("assignment_id").distinct().withColumn("__sub", F.lit(True))
    first = (s.where(F.col("status") == 1).join(merged(sub.select("assignment_id")), "assignment_id", "left_semi").groupBy("assignment_id")
             .agg(F.min(F.struct("idx", "id")).alias("__m")))
    j = s.join(merged(sub), "assignment_id", "left").join(merged(first), "assignment_id", "left")
    is_sub = F.coalesce(F.col("__sub"), F.lit(False))
    close = is_sub & (F.col("id") == F.col("__m.id"))
    open_next = is_sub & (F.col("status") == 0) & F.when(
        F.col("__m").isNull(), F.col("idx") == 1).otherwise(F.col("idx") == F.col("__m.idx") + 1)
    status = F.when(close, F.lit(2)).when(open_next, F.lit(1)).otherwise(F.col("status")).cast("int")
    eval_date = F.when(close, today_utc(as_of_ts)).otherwise(F.col("eval_date"))
    return j.select(*[status.alias(c) if c == "status" else eval_date.alias(c) if c == "eval_date"
                      else F.col(c) for c in s.columns])


# ------------------------------------------------------- W4 step updates
STEP_STATE = T.StructType([
    T.StructField("id", T.LongType()), T.StructField("assignment_id", T.LongType()),
    T.StructField("idx", T.IntegerType()), T.StructField("evaluator_id", T.LongType()),
    T.StructField("status", T.IntegerType()), T.StructField("eval_date", T.DateType())])


def _step_change_inputs(steps: DataFrame, change_log: DataFrame, users: DataFrame) -> tuple[DataFrame, DataFrame]:
    s = steps if "eval_date" in steps.columns else steps.withColumn("eval_date", F.lit(None).cast("date"))
    s = s.select(*[f.name for f in STEP_STATE])
    c = change_log.select("seq", "step_id", F.col("status").cast("int").alias("new_status"),
                          is_blank("eval_date").alias("blank"), try_date("eval_date").alias("new_date"))
    # a non-blank date that does not parse fails the UPDATE: no change
    c = c.where(F.col("blank") | F.col("new_date").isNotNull()).drop("blank")
    # the UPDATE joins users on evaluator_id: a step whose evaluator is gone is "not found"
    live = s.select(F.col("id").alias("step_id"), "assignment_id", "evaluator_id").join(
        sized_broadcast(users.select(F.col("id").alias("evaluator_id"))), "evaluator_id", "left_semi")
    c = c.join(live.drop("evaluator_id"), "step_id")
    return s, c


def update_steps(steps: DataFrame, change_log: DataFrame, users: DataFrame) -> DataFrame:
    """Apply step changes (seq, step_id, status, eval_date).

    Each change sets status (any int) and eval_date (blank -> NULL).  When
    the new status is 2 and no step of the assignment is active afterwards,
    the steps with the next idx that are still waiting become active.
    Assignments that receive one change - the common case - are resolved with
    joins and aggregates; assignments with several changes need them in order
    and go through the fold (:func:`replay_step_changes`).
    The change set is materialised once (it is read by both paths); the step
    table is tagged in one pass with a size-checked broadcast of the
    several-change assignments.
    """
    s, c = _step_change_inputs(steps, change_log, users)
    n = c.groupBy("assignment_id").agg(F.count(F.lit(1)).alias("__n"))
    c = at_rest(c.join(n, "assignment_id"), "step-changes")
    multi = c.where(F.col("__n") > 1).select("assignment_id").distinct().withColumn("__multi", F.lit(True))
    tagged = s.join(sized_broadcast(multi), "assignment_id", "left")
    s_single = tagged.where(F.col("__multi").isNull()).drop("__multi")
    s_multi = tagged.where(F.col("__multi")).drop("__multi")

    ch = c.where(F.col("__n") == 1).select(F.col("step_id").alias("id"), "new_status", "new_date",
                                           F.lit(True).alias("__hit"))
    j = s_single.join(sized_broadcast(ch), "id", "left")
    hit = F.coalesce(F.col("__hit"), F.lit(False))
    st1 = F.when(hit, F.col("new_status")).otherwise(F.col("status"))
    dt1 = F.when(hit, F.col("new_date")).otherwise(F.col("eval_date"))
    after = j.select("id", "assignment_id", "idx", "evaluator_id", st1.alias("status"), dt1.alias("eval_date"),
                     F.when(hit & (F.col("new_status") == 2), F.col("idx") + 1).alias("__open_idx"))
    per = after.groupBy("assignment_id").agg(
        F.count_if(F.col("status") == 1).alias("__active"), F.max("__open_idx").alias("__open"))
    k = after.drop("__open_idx").join(per, "assignment_id")
    opens = (F.col("__active") == 0) & F.col("__open").isNotNull() & (F.col("idx") == F.col("__open")) \
        & (F.col("status") == 0)
    single_out = k.select("id", "assignment_id", "idx", "evaluator_id",
                          F.when(opens, F.lit(1)).otherwise(F.col("status")).cast("int").alias("status"),
                          "eval_date")
    return single_out.unionByName(replay_step_changes(s_multi, c.where(F.col("__n") > 1).drop("__n")))


def replay_step_changes(steps: DataFrame, changes_with_assignment: DataFrame) -> DataFrame:
    """W4 with several ordered changes per assignment: a fold over the changes with the steps as its state.

    Per assignment the steps are one array and the changes another, sorted by
    ``seq``; ``aggregate`` applies them in order, all as Column expressions.
    Assignments are folded in parallel.  Changes that a later one makes void are
    left out before they are gathered (:func:`_effective`), so that the array follows
    the steps rather than the log.
    """
    fields = ("id", "idx", "evaluator_id", "status", "eval_date")
    state = F.array_sort(F.collect_list(F.struct(*fields))).alias("state")
    log = F.sort_array(F.collect_list(F.struct("seq", "step_id", "new_status", "new_date"))).alias("log")
    per = steps.groupBy("assignment_id").agg(state).join(
        _effective(changes_with_assignment).groupBy("assignment_id").agg(log), "assignment_id", "left")

    def step_of(s, status, eval_date):
        new = {"status": status, "eval_date": eval_date}
        return F.struct(*[(new.get(f, s[f])).alias(f) for f in fields])

    def apply(current, change):
        hit = lambda s: s["id"] == change["step_id"]
        changed = F.transform(current, lambda s: step_of(
            s, F.when(hit(s), change["new_status"]).otherwise(s["status"]), F.when(hit(s), change["new_date"]).otherwise(s["eval_date"])))
        at = F.get(F.filter(current, hit), 0)["idx"]
        opens = (change["new_status"] == 2) & ~F.exists(changed, lambda s: s["status"] == 1)
        return F.transform(changed, lambda s: step_of(
            s, F.when(F.coalesce(opens & (s["idx"] == at + 1) & (s["status"] == 0), F.lit(False)), F.lit(1)).otherwise(s["status"]), s["eval_date"]))

    done = per.select("assignment_id", F.explode(F.aggregate(F.coalesce("log", F.array()), F.col("state"), apply)).alias("s"))
    return done.select(F.col("s.id").alias("id"), "assignment_id", "s.idx", "s.evaluator_id", F.col("s.status").cast("int").alias("status"), "s.eval_date")


def _effective(log: DataFrame) -> DataFrame:
    """The changes without those that the next change of the same step, right after them in the assignment's order, makes void.

    A change sets its step's status and date and may open the step after it.  It
    opens none when its status is not 2; if the very next change of the
    assignment is one to the same step, nothing has seen what it set.
    """
    by_seq = Window.partitionBy("assignment_id").orderBy("seq")
    return log.withColumn("__next", F.lead("step_id").over(by_seq)).where(
        (F.col("new_status") == 2) | F.col("__next").isNull() | (F.col("__next") != F.col("step_id"))).drop("__next")


def replay_all_step_changes(steps: DataFrame, change_log: DataFrame, users: DataFrame) -> DataFrame:
    """W4 through the ordered fold for every assignment (used to check the set-based path)."""
    s, c = _step_change_inputs(steps, change_log, users)
    return replay_step_changes(s, c)


# ------------------------------------------------------------ W5 save lock
def bind_saves(log: DataFrame) -> DataFrame:
    """The save log with its bodies bound (``d``, ``reject``), at rest: every body is parsed once."""
    p = docs.parse_or_reject(log.select("seq", "ts", "user_id", "form_id", "due_date", "doc"), docs.SAVE_DOC)
    # the document's own due date decides; a log may carry one beside documents that have none
    return p.withColumn("due_date", F.coalesce("d.due_date", "due_date"))


def save_events(log: DataFrame, assignments: DataFrame, comps: DataFrame,
                forms: DataFrame | None = None, users: DataFrame | None = None) -> DataFrame:
    """Per save request: parsed head, ``valid`` (constraint checks) and ``creatable``.

    Invalid = a refused body (see :mod:`evalspark.sources.binding`) or a row the tables would
    refuse: duplicate or unknown comp_id, KPI weight outside 0..100, a number out
    of its column's range, a non-blank development-plan date that does not
    parse, or text over its length.  ``creatable`` is false when a new
    assignment cannot be made: the due date does not parse, or (with
    ``forms`` / ``users``) the form or user does not exist.

    ``log`` is a save log or one that is bound already (:func:`bind_saves`).  The
    flagged rows (:func:`flagged_saves`) are at rest for the aggregates and joins below.
    """
    ev = flagged_saves(log if "d" in log.columns else bind_saves(log), comps)
    a = assignments.select("form_id", "user_id", F.col("status").alias("stored_status"))
    ev = ev.join(a, ["form_id", "user_id"], "left")
    # a refused body ends the request before its assignment is made
    can_create = F.col("reject").isNull() & (is_blank("due_date") | try_date("due_date").isNotNull())
    first_ok = ev.where(can_create).groupBy("form_id", "user_id").agg(F.min("seq").alias("__c"))
    first_ok = changes.with_parents(first_ok, forms, users)
    ev = ev.join(first_ok, ["form_id", "user_id"], "left")
    creatable = F.col("reject").isNull() & F.coalesce(
        F.col("stored_status").isNotNull() | (F.col("seq") >= F.col("__c")), F.lit(False))
    return ev.select("seq", "ts", "user_id", "form_id", "due_date", "req_status",
                     normalize_status("req_status").alias("status"), "stored_status",
                     creatable.alias("creatable"), (creatable & F.col("sound")).alias("valid"))


def flagged_saves(p: DataFrame, comps: DataFrame) -> DataFrame:
    """Bound saves with ``sound``: the tables would take every row of the document.

    The per-list rules are higher-order functions over the bound arrays
    (``exists``), so only the comp_id existence check needs an explode and a join.
    """
    z = lambda c, d: F.coalesce(c, F.lit(d))  # noqa: E731  Go zero value of an absent field
    kpis = F.coalesce(F.col("d.kpis"), F.array())
    bad_kpi = F.exists(kpis, lambda k: ~changes.fits_int(k["idx"]) | ~changes.kpi_item_valid(
        z(k["code"], ""), z(k["title"], ""), z(k["weight"], 0), z(k["note"], ""), z(k["measure"], ""),
        z(k["criteria"], ""), z(k["unit"], ""), k["max_score"], k["expected_score"], k["score"]))
    cs = F.coalesce(F.col("d.competency_scores"), F.array())
    comp_ids = F.transform(cs, lambda c: z(c["comp_id"], 0))
    dup_comp = F.size(F.array_distinct(comp_ids)) < F.size(comp_ids)
    long_note = F.exists(cs, lambda c: ~changes.within_lengths("eval_competency_score", {"note": z(c["note"], "")})
                         | ~changes.fits(c["score"], 6, 2))
    bad_ta = ~changes.fits(F.col("d.time_attendance.full_score"), 6, 2) | ~changes.fits(F.col("d.time_attendance.score"), 6, 2)
    dp = F.coalesce(F.col("d.development_plan"), F.array())
    bad_dp = F.exists(dp, lambda x: (~is_blank(z(x["timing"], "")) & try_date(z(x["timing"], "")).isNull())
                      | ~changes.fits_int(x["idx"])
                      | ~changes.within_lengths("eval_dev_plan", {"content": z(x["content"], ""),
                                                                  "priority": z(x["priority"], ""),
                                                                  "remarks": z(x["remarks"], "")}))
    bad_ad = ~changes.within_lengths("eval_additional", {q: z(F.col(f"d.additional.{q}"), "") for q in docs.QUESTIONS})
    local_bad = bad_kpi | dup_comp | long_note | bad_ta | bad_dp | bad_ad
    ev = at_rest(p.select("seq", "ts", "user_id", "form_id", "due_date",
                          z(F.col("d.status"), 0).alias("req_status"),
                          local_bad.alias("__local_bad"), comp_ids.alias("__comp_ids"), "reject"), "events")
    known = broadcast_or_merge(comps.select(F.col("id").alias("comp_id")))
    unknown = (ev.select("seq", F.explode("__comp_ids").alias("comp_id"))
               .join(known, "comp_id", "left_anti").select("seq").distinct()
               .withColumn("__unknown", F.lit(True)))
    return ev.join(merged(unknown), "seq", "left").select(
        "seq", "ts", "user_id", "form_id", "due_date", "req_status", "reject",
        (~F.col("__local_bad") & F.col("__unknown").isNull()).alias("sound"))


def resolve_save_log(events: DataFrame) -> DataFrame:
    """Which saves are accepted.  Adds ``accepted`` to :func:`save_events` rows."""
    lock = (events.where(F.col("valid") & (F.col("status") == LOCKED))
            .groupBy("user_id", "form_id").agg(F.min("seq").alias("lock_seq")))
    e = events.join(lock, ["user_id", "form_id"], "left")
    pre_locked = F.coalesce(F.col("stored_status") == LOCKED, F.lit(False))
    acc = F.col("valid") & ~pre_locked & (F.col("lock_seq").isNull() | (F.col("seq") <= F.col("lock_seq")))
    return e.withColumn("accepted", acc).drop("lock_seq")


# ------------------------------------------------------- W6 state after log
def apply_save_log(tables: dict[str, DataFrame], log: DataFrame, as_of_ts: str,
                   id_floor: dict[str, int] | None = None) -> dict[str, DataFrame]:
    """All tables after applying the save log.

    Assignments: EnsureAssignment runs for every request (before the lock
    test), so dues follow M4 over all requests; status is the normalised
    status of the last accepted save.  KPIs, competency scores and the
    development plan are replaced by the last accepted save's lists; TA and
    additional are upserted from it.  If that save is a submit the step chain
    advances once (W3).  ``id_floor`` gives per-table id maxima when the
    tables passed are only the part of the state the log touches.
    """
    bound = bind_saves(log)
    # the resolved events feed several joins and aggregates: put them at rest once
    ev = at_rest(resolve_save_log(save_events(bound, tables["eval_assignment"], tables["eval_competency"],
                                              tables.get("eval_form"), tables.get("users"))), "resolved")
    # creatable requests already passed the form/user existence check in save_events
    req = ev.where(F.col("creatable")).select("seq", "form_id", "user_id", "due_date", "ts")
    a1 = changes.ensure_assignments(tables["eval_assignment"], req, as_of_ts,
                                    id_floor=(id_floor or {}).get("eval_assignment", 0))
    last = ev.where(F.col("accepted")).groupBy("user_id", "form_id").agg(F.max(F.struct("seq", "status")).alias("m")).select(
        "user_id", "form_id", F.col("m.seq").alias("seq"), F.col("m.status").alias("status"))
    out = apply_last_saves(tables, a1, last, bound.select("seq", "d"), as_of_ts, id_floor)
    out["__events"] = ev
    return out


def apply_last_saves(tables: dict[str, DataFrame], a1: DataFrame, last: DataFrame, bound: DataFrame, as_of_ts: str,
                     id_floor: dict[str, int] | None = None) -> dict[str, DataFrame]:
    """All tables after the last accepted save (user_id, form_id, seq, status) of each pair.

    ``a1`` are the assignments after every request ensured its own; ``bound`` holds at least
    the last saves' documents (seq, d).
    """
    floor = id_floor or {}
    last = at_rest(last.join(merged(a1.select(F.col("id").alias("assignment_id"), "form_id", "user_id")),
                             ["form_id", "user_id"]), "last")
    a2 = a1.join(merged(last.select("form_id", "user_id", F.col("status").alias("__s"))), ["form_id", "user_id"], "left") \
        .select("id", "form_id", "user_id", F.coalesce("__s", "status").cast("int").alias("status"), "due_date")
    kept = bound.join(merged(last.select("seq", "assignment_id")), "seq")
    # ids per list: the items of all earlier saves, then the position; item rows are never sorted
    lists = {"eval_kpi_user": "kpis", "eval_competency_score": "competency_scores", "eval_dev_plan": "development_plan"}
    sizes = [F.size(F.coalesce(F.col(f"d.{c}"), F.array())).alias(c) for c in lists.values()]
    totals = changes.running_totals(kept.select("seq", *sizes), ["seq"], list(lists.values()))
    starts = {t: max(changes.max_id(tables[t]), floor.get(t, 0)) for t in lists}
    numbers = totals.select("seq", *[(F.lit(starts[t]) + F.col(f"before_{c}") + 1).alias(f"first_{c}") for t, c in lists.items()])
    firsts = [f"first_{c}" for c in lists.values()]
    kept = at_rest(kept.join(merged(numbers), "seq"), "kept")
    sh = docs.shred_bound_saves(kept, ["seq", "assignment_id", *firsts])
    parents = last.select("assignment_id")
    out = dict(tables)
    out["eval_assignment"] = a2

    def replaced(table: str, rows: DataFrame, *cols) -> DataFrame:
        base, first = tables[table], F.col(f"first_{lists[table]}")
        new = rows.select((first + F.col("pos")).alias("id"), "assignment_id", *cols)
        return changes.replace_children(base, parents, _shape(new, base), "assignment_id")

    idx = F.col("idx").try_cast("int").alias("idx")
    score = F.col("score").try_cast("decimal(6,2)").alias("score")
    out["eval_kpi_user"] = replaced(
        "eval_kpi_user", sh["kpis"], idx, blank_to_null("code").alias("code"), "title",
        F.col("max_score").try_cast("decimal(6,2)").alias("max_score"), F.col("weight").try_cast("int").alias("weight"),
        F.col("expected_score").try_cast("decimal(6,2)").alias("expected_score"), score,
        *[blank_to_null(c).alias(c) for c in ("note", "measure", "criteria", "unit")])
    out["eval_competency_score"] = replaced("eval_competency_score", sh["competency_scores"], "comp_id", score,
                                            blank_to_null("note").alias("note"))
    out["eval_dev_plan"] = replaced("eval_dev_plan", sh["development_plan"], idx, "content", "priority",
                                    try_date("timing").alias("timing"), blank_to_null("remarks").alias("remarks"))

    ta = sh["time_attendance"].select(
        "seq", "assignment_id", F.col("full_score").try_cast("decimal(6,2)").alias("full_score"),
        F.col("score").try_cast("decimal(6,2)").alias("score"))
    base_ta = tables["eval_ta_score"]
    out["eval_ta_score"] = changes.upsert(base_ta, _shape(ta, base_ta, keep=["seq"]), ["assignment_id"])
    ad = sh["additional"].select("seq", "assignment_id", *docs.QUESTIONS)
    base_ad = tables["eval_additional"]
    out["eval_additional"] = changes.upsert(base_ad, _shape(ad, base_ad, keep=["seq"]), ["assignment_id"])

    submitted = last.where(F.col("status") == LOCKED).select("assignment_id")
    out["eval_step"] = advance_steps(tables["eval_step"], submitted, as_of_ts)
    out["__last"] = last
    return out


#: Tables that a save log changes, and the key by which they are stored.
SAVED_BY = {"eval_assignment": "id", **{t: "assignment_id" for t in (
    "eval_kpi_user", "eval_competency_score", "eval_dev_plan", "eval_ta_score", "eval_additional", "eval_step")}}


def write_after_saves(out: dict[str, DataFrame], paths: dict[str, str], parts: int) -> dict[str, int]:
    """S9 + W6: store the state after a save log, rewriting only the partitions of assignments that it changed.

    ``out`` is the result of :func:`apply_save_log` over tables stored by
    :func:`save_by_key` at ``paths``.  Returns how many partitions of each table were written.
    """
    pairs = out["__events"].where("creatable").select("form_id", "user_id").distinct()
    named = at_rest(out["eval_assignment"].join(pairs, ["form_id", "user_id"], "left_semi").select("id"), "changed")
    saved = at_rest(out["__last"].select("assignment_id"), "saved")
    rows = {t: at_rest(out[t], t) for t in paths}  # before anything that they are computed from changes
    return {t: save_touched(rows[t], named if t == "eval_assignment" else saved, paths[t], SAVED_BY[t], parts) for t in paths}


def _shape(df: DataFrame, like: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Columns of ``like`` (missing ones NULL, types cast) plus ``keep``."""
    cols = [(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in like.schema.fields]
    return df.select(*cols, *(keep or []))


# ----------------------------------------------------- D4 save responses
def save_results(tables: dict[str, DataFrame], log: DataFrame, as_of_ts: str) -> DataFrame:
    """Response of every accepted save: assignment id, requested status, summary.

    Each accepted save replaces all children, so its summary depends only on
    its own document (plus form weights and bands): the scoring functions run
    keyed by ``seq`` instead of assignment, with no sequential state.
    """
    bound = bind_saves(log)
    ev = at_rest(resolve_save_log(save_events(bound, tables["eval_assignment"], tables["eval_competency"],
                                              tables.get("eval_form"), tables.get("users"))), "resolved")
    acc = ev.where(F.col("accepted")).select("seq", "form_id", "user_id", "req_status")
    sh = docs.shred_bound_saves(bound.join(acc.select("seq"), "seq", "left_semi"), ["seq"])
    k = kpi_percent(sh["kpis"].withColumnRenamed("seq", "assignment_id"))
    c = competency_percent(sh["competency_scores"].withColumnRenamed("seq", "assignment_id"),
                           tables["eval_competency"])
    t = attendance_percent(sh["time_attendance"].withColumnRenamed("seq", "assignment_id"))
    f = tables["eval_form"].select(F.col("id").alias("form_id"), "kpi_weight", "comp_weight", "ta_weight")
    j = (acc.join(sized_broadcast(f), "form_id")
         .join(k.withColumnRenamed("assignment_id", "seq"), "seq", "left")
         .join(c.withColumnRenamed("assignment_id", "seq"), "seq", "left")
         .join(t.withColumnRenamed("assignment_id", "seq"), "seq", "left"))
    kp, cp, tp = (F.coalesce(F.col(x), F.lit(0.0)) for x in ("kpi_pct", "comp_pct", "ta_pct"))
    total = (kp * F.col("kpi_weight") + cp * F.col("comp_weight") + tp * F.col("ta_weight")) / 100.0
    scored = j.select("seq", "form_id", "user_id", F.col("req_status").alias("status"),
                      F.round(kp, 6).alias("kpi_pct"), F.round(cp, 6).alias("comp_pct"),
                      F.round(tp, 6).alias("ta_pct"), F.round(total, 6).alias("total_pct"))
    graded = assign_grade(scored, tables["eval_grade_band"], key="seq")
    # the assignment id a save answers with (after EnsureAssignment)
    a1 = changes.ensure_assignments(
        tables["eval_assignment"],
        ev.where(F.col("creatable")).select("seq", "form_id", "user_id", "due_date", "ts"), as_of_ts)
    return graded.join(a1.select(F.col("id").alias("assignment_id"), "form_id", "user_id"),
                       ["form_id", "user_id"]).select(
        "seq", "assignment_id", "status", "kpi_pct", "comp_pct", "ta_pct", "total_pct", "grade")



def state_by_key(out: dict[str, DataFrame], log: DataFrame) -> DataFrame:
    """W6 summary per (form_id, user_id) of ``log``: assignment, status, due, child counts, TA, q1, steps."""
    keys = log.select("form_id", "user_id").distinct()
    a = out["eval_assignment"].join(merged(keys), ["form_id", "user_id"], "left_semi").select(
        "form_id", "user_id", F.col("id").alias("assignment_id"), "status", "due_date")
    k = out["eval_kpi_user"].groupBy("assignment_id").agg(
        F.count(F.lit(1)).alias("kpis"), F.sum("weight").cast("long").alias("kpi_weight"))
    c = out["eval_competency_score"].groupBy("assignment_id").agg(F.count(F.lit(1)).alias("comp_scores"))
    d = out["eval_dev_plan"].groupBy("assignment_id").agg(F.count(F.lit(1)).alias("plans"))
    ta = out["eval_ta_score"].select("assignment_id", F.col("full_score").cast("double").alias("ta_full"),
                                     F.col("score").cast("double").alias("ta_score"))
    ad = out["eval_additional"].select("assignment_id", "q1")
    st = out["eval_step"].groupBy("assignment_id").agg(
        F.count_if(F.col("status") == 1).alias("active_steps"), F.count_if(F.col("status") == 2).alias("done_steps"))
    j = a
    for part in (k, c, d, ta, ad, st):
        j = j.join(merged(part), "assignment_id", "left")
    z = F.lit(0).cast("long")
    return j.select("form_id", "user_id", "assignment_id", "status", F.date_format("due_date", "yyyy-MM-dd")
                    .alias("due_date"), F.coalesce("kpis", z).alias("kpis"),
                    F.coalesce("kpi_weight", z).alias("kpi_weight"), F.coalesce("comp_scores", z).alias("comp_scores"),
                    F.coalesce("plans", z).alias("plans"), "ta_full", "ta_score", "q1",
                    F.coalesce("active_steps", z).alias("active_steps"),
                    F.coalesce("done_steps", z).alias("done_steps"))
