"""Registered queries: step workflow and the save log."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import AS_OF_DATE, AS_OF_TS, fixture_tables
from ..functions import scalars as sc
from ..operators import requests, workflow
from .registry import query
from .sqlparts import GRADE_CTE, SAVE_EVENTS_CTE, ensure_cte, oracle

# ---------------------------------------------------------------------- W2
_BUILD_SQL = """
sr_docs AS (select seq, form_id, user_id, from_json(doc, '{"evaluators":["BIGINT"]}') as d from step_requests),
sr_ne AS (select seq, form_id, user_id, list_concat([cast(user_id as bigint)], d.evaluators) as chain
          from sr_docs where coalesce(len(d.evaluators), 0) > 0),
sr_ch AS (select seq, form_id, user_id, pos - 1 as pos, chain[pos] as evaluator_id
          from (select *, generate_subscripts(chain, 1) as pos from sr_ne) x),
sr_bad AS (select distinct seq from sr_ch where evaluator_id is null or evaluator_id not in (select id from users)),
sr_rows AS (select c.*, a.id as assignment_id, u.name as evaluator_name from sr_ch c
            join eval_assignment a on a.form_id = c.form_id and a.user_id = c.user_id
            left join users u on u.id = c.evaluator_id where c.seq not in (select seq from sr_bad)),"""


@query("build_steps", oracle(("step_requests", "eval_assignment", "users", "eval_step", "eval_form"),
                             ensure_cte("step_requests_due", AS_OF_TS) + _BUILD_SQL.replace(
                                 "join eval_assignment a on", "join a1 a on"),
                             "select (select max(id) from eval_step) + row_number() over (order by seq, pos) as id,"
                             " assignment_id, cast(pos + 1 as int) as idx, evaluator_id, evaluator_name,"
                             " case when pos = 0 then 1 else 0 end as status from sr_rows").replace(
    "a1_req AS (", "step_requests_due AS (select seq, form_id, user_id, '' as due_date, cast(null as timestamp)"
    " as ts from step_requests),\na1_req AS ("))
def q_build_steps(spark, sf_dir):
    """W2 + J8 + M4: step requests ensure their assignment, then valid chains become steps."""
    t = fixture_tables(spark, sf_dir, ["step_requests", "eval_assignment", "users", "eval_step", "eval_form"])
    return requests.step_chain_requests(t, t["step_requests"], AS_OF_TS)["new_steps"]


# ---------------------------------------------------------------------- W3
_ADV_SQL = """
sub AS (select id as assignment_id from eval_assignment where status = 2),
firsta AS (select assignment_id, id, idx from (select *, row_number() over (partition by assignment_id
           order by idx, id) as rn from eval_step where status = 1) x where rn = 1),"""


@query("advance_steps", oracle(("eval_step", "eval_assignment"), _ADV_SQL,
                               "select s.id, s.assignment_id, s.idx, s.evaluator_id,"
                               " cast(case when b.assignment_id is not null and s.id = f.id then 2"
                               "  when b.assignment_id is not null and s.status = 0 and"
                               "   ((f.id is null and s.idx = 1) or (f.id is not null and s.idx = f.idx + 1)) then 1"
                               "  else s.status end as int) as status,"
                               " case when b.assignment_id is not null and s.id = f.id then '" + AS_OF_DATE +
                               "' end as eval_date"
                               " from eval_step s left join sub b on b.assignment_id = s.assignment_id"
                               " left join firsta f on f.assignment_id = s.assignment_id"))
def q_advance_steps(spark, sf_dir):
    """Steps after the submit hook ran for every submitted (status 2) assignment."""
    t = fixture_tables(spark, sf_dir, ["eval_step", "eval_assignment"])
    sub = t["eval_assignment"].where(F.col("status") == 2).select(F.col("id").alias("assignment_id"))
    s = workflow.advance_steps(t["eval_step"], sub, AS_OF_TS)
    return s.select("id", "assignment_id", "idx", "evaluator_id", "status",
                    sc.iso_date("eval_date").alias("eval_date"))


# ---------------------------------------------------------------------- W4
_UPD_STEPS_SQL = """
live AS (select * from eval_step where evaluator_id in (select id from users)),
ch AS (select c.seq, c.step_id, c.status as new_status, try_cast(nullif(trim(c.eval_date), '') as date) as new_date
       from step_changes c join live l on l.id = c.step_id
       where trim(c.eval_date) = '' or try_cast(nullif(trim(c.eval_date), '') as date) is not null),
aft AS (select s.id, s.assignment_id, s.idx, s.evaluator_id,
               case when c.step_id is not null then c.new_status else s.status end as status,
               case when c.step_id is not null then c.new_date end as eval_date,
               case when c.new_status = 2 then s.idx + 1 end as open_idx
        from eval_step s left join ch c on c.step_id = s.id),
per AS (select assignment_id, count(*) filter (where status = 1) as active, max(open_idx) as op
        from aft group by assignment_id),"""


@query("update_steps", oracle(("eval_step", "users", "step_changes"), _UPD_STEPS_SQL,
                              "select a.id, a.assignment_id, a.idx, a.evaluator_id,"
                              " cast(case when p.active = 0 and p.op is not null and a.idx = p.op and a.status = 0"
                              " then 1 else a.status end as int) as status,"
                              " strftime(a.eval_date, '%Y-%m-%d') as eval_date"
                              " from aft a join per p on p.assignment_id = a.assignment_id"))
def q_update_steps(spark, sf_dir):
    """Steps after one status/date change per assignment (next idx opens when none active)."""
    t = fixture_tables(spark, sf_dir, ["eval_step", "users", "step_changes"])
    s = workflow.update_steps(t["eval_step"], t["step_changes"], t["users"])
    return s.select("id", "assignment_id", "idx", "evaluator_id", "status",
                    sc.iso_date("eval_date").alias("eval_date"))


# The oracle folds each assignment's changes in order with a recursive CTE over
# a list-of-structs state (one recursion step per change).
_REPLAY_SQL = """
rs_steps AS (select id, assignment_id, idx, evaluator_id, status, cast(null as date) as eval_date from eval_step),
rs_ch AS (select c.seq, c.step_id, s.assignment_id, s.idx as tidx, c.status as new_status,
                 try_cast(nullif(trim(c.eval_date), '') as date) as new_date
          from step_replay_log c join rs_steps s on s.id = c.step_id
          where s.evaluator_id in (select id from users)
            and (trim(c.eval_date) = '' or try_cast(nullif(trim(c.eval_date), '') as date) is not null)),
rs_chn AS (select *, row_number() over (partition by assignment_id order by seq) as k from rs_ch),
rs_init AS (select assignment_id, list(struct_pack(id := id, idx := idx, evaluator_id := evaluator_id,
                   status := status, eval_date := eval_date)) as st
            from rs_steps where assignment_id in (select assignment_id from rs_ch) group by assignment_id),
rs_rec AS (
  select assignment_id, 0 as k, st from rs_init
  union all
  select r.assignment_id, r.k + 1,
    list_transform(u.u, lambda y: case when c.new_status = 2 and len(list_filter(u.u, lambda z: z.status = 1)) = 0
                                   and y.idx = c.tidx + 1 and y.status = 0
                              then struct_pack(id := y.id, idx := y.idx, evaluator_id := y.evaluator_id,
                                               status := 1, eval_date := y.eval_date)
                              else y end)
  from rs_rec r join rs_chn c on c.assignment_id = r.assignment_id and c.k = r.k + 1,
  lateral (select list_transform(r.st, lambda x: case when x.id = c.step_id
             then struct_pack(id := x.id, idx := x.idx, evaluator_id := x.evaluator_id,
                              status := c.new_status, eval_date := c.new_date)
             else x end) as u) u),
rs_last AS (select r.assignment_id, r.st from rs_rec r
            where r.k = (select max(k) from rs_chn c where c.assignment_id = r.assignment_id)),
rs_out AS (select assignment_id, unnest(st, recursive := true) from rs_last),"""


@query("replay_step_changes", "WITH RECURSIVE " + oracle(
    ("eval_step", "users", "step_replay_log"), _REPLAY_SQL,
    "select id, assignment_id, idx, evaluator_id, cast(status as int) as status,"
    " strftime(eval_date, '%Y-%m-%d') as eval_date from rs_out"
    " union all select id, assignment_id, idx, evaluator_id, status, cast(null as varchar) from rs_steps"
    " where assignment_id not in (select assignment_id from rs_ch)")[5:])
def q_replay_step_changes(spark, sf_dir):
    """W4 with several ordered changes per assignment: the streamed per-assignment fold."""
    t = fixture_tables(spark, sf_dir, ["eval_step", "users", "step_replay_log"])
    s = workflow.update_steps(t["eval_step"], t["step_replay_log"], t["users"])
    return s.select("id", "assignment_id", "idx", "evaluator_id", "status",
                    sc.iso_date("eval_date").alias("eval_date"))


# ------------------------------------------------------------------- W5/W6
_SAVE_VIEWS = ("save_log", "eval_assignment", "eval_competency", "eval_form", "users")


@query("save_log_accepted", oracle(_SAVE_VIEWS, SAVE_EVENTS_CTE,
                                   "select seq, user_id, form_id, status, valid, accepted from res"))
def q_save_log_accepted(spark, sf_dir):
    """Validity and acceptance (lock) of every save request."""
    t = fixture_tables(spark, sf_dir, list(_SAVE_VIEWS))
    ev = workflow.resolve_save_log(workflow.save_events(t["save_log"], t["eval_assignment"], t["eval_competency"],
                                                        t["eval_form"], t["users"]))
    return ev.select("seq", "user_id", "form_id", "status", "valid", "accepted")


@query("save_log_due", oracle(("save_log", "eval_assignment", "eval_form", "users"), ensure_cte("save_log", AS_OF_TS),
                              "select a.form_id, a.user_id, strftime(a.due_date, '%Y-%m-%d') as due_date from a1 a"
                              " where exists (select 1 from save_log s where s.form_id = a.form_id"
                              " and s.user_id = a.user_id)"))
def q_save_log_due(spark, sf_dir):
    """Due date of every key in the save log (last parsable due of any request wins)."""
    t = fixture_tables(spark, sf_dir, list(_SAVE_VIEWS) + ["eval_step"])
    ev = workflow.resolve_save_log(workflow.save_events(t["save_log"], t["eval_assignment"], t["eval_competency"],
                                                        t["eval_form"], t["users"]))
    from ..operators.changes import ensure_assignments
    a1 = ensure_assignments(t["eval_assignment"],
                            ev.where(F.col("creatable")).select("seq", "form_id", "user_id", "due_date", "ts"),
                            AS_OF_TS, t["eval_form"], t["users"])
    keys = t["save_log"].select("form_id", "user_id")
    return a1.join(keys, ["form_id", "user_id"], "left_semi").select(
        "form_id", "user_id", sc.iso_date("due_date").alias("due_date"))


_STATE_VIEWS = ("save_log", "eval_assignment", "eval_competency", "eval_kpi_user", "eval_competency_score",
                "eval_ta_score", "eval_dev_plan", "eval_additional", "eval_step", "eval_form", "users")
_STATE_SQL = SAVE_EVENTS_CTE + ensure_cte("save_log", AS_OF_TS) + """
keys AS (select distinct form_id, user_id from save_log),
lastacc AS (select r.user_id, r.form_id, r.seq, r.status from res r
            where r.accepted and r.seq = (select max(seq) from res x where x.accepted
                                          and x.user_id = r.user_id and x.form_id = r.form_id)),
st AS (select k.form_id, k.user_id, a.id as assignment_id, coalesce(l.status, a.status) as status, a.due_date,
              l.seq as last_seq
       from keys k join a1 a on a.form_id = k.form_id and a.user_id = k.user_id
       left join lastacc l on l.form_id = k.form_id and l.user_id = k.user_id),
dk AS (select seq, count(*) as n, sum(weight) as w from sv_kpis group by seq),
dc AS (select seq, count(*) as n from sv_cs group by seq),
dd AS (select seq, count(*) as n from sv_dp group by seq),
tk AS (select assignment_id, count(*) as n, sum(weight) as w from eval_kpi_user group by assignment_id),
tc AS (select assignment_id, count(*) as n from eval_competency_score group by assignment_id),
td AS (select assignment_id, count(*) as n from eval_dev_plan group by assignment_id),
sub AS (select assignment_id from st where last_seq is not null and status = 2),
firsta AS (select assignment_id, id, idx from (select *, row_number() over (partition by assignment_id
           order by idx, id) as rn from eval_step where status = 1) x where rn = 1),
adv AS (select s.assignment_id,
          case when b.assignment_id is not null and s.id = f.id then 2
               when b.assignment_id is not null and s.status = 0 and
                 ((f.id is null and s.idx = 1) or (f.id is not null and s.idx = f.idx + 1)) then 1
               else s.status end as status
        from eval_step s left join sub b on b.assignment_id = s.assignment_id
        left join firsta f on f.assignment_id = s.assignment_id),
stp AS (select assignment_id, count(*) filter (where status = 1) as active, count(*) filter (where status = 2) as done
        from adv group by assignment_id),"""


STATE_ORACLE = oracle(_STATE_VIEWS, _STATE_SQL,
                                "select st.form_id, st.user_id, st.assignment_id, cast(st.status as int) as status,"
                                " strftime(st.due_date, '%Y-%m-%d') as due_date,"
                                " case when last_seq is not null then coalesce(dk.n, 0) else coalesce(tk.n, 0) end"
                                "   as kpis,"
                                " cast(case when last_seq is not null then coalesce(dk.w, 0) else coalesce(tk.w, 0) end"
                                "   as bigint) as kpi_weight,"
                                " case when last_seq is not null then coalesce(dc.n, 0) else coalesce(tc.n, 0) end"
                                "   as comp_scores,"
                                " case when last_seq is not null then coalesce(dd.n, 0) else coalesce(td.n, 0) end"
                                "   as plans,"
                                " case when last_seq is not null then cast(cast(ad.ta_full as decimal(6,2)) as double)"
                                "   else cast(ta.full_score as double) end as ta_full,"
                                " case when last_seq is not null then cast(cast(ad.ta_score as decimal(6,2)) as double)"
                                "   else cast(ta.score as double) end as ta_score,"
                                " case when last_seq is not null then ad.q1 else x.q1 end as q1,"
                                " coalesce(stp.active, 0) as active_steps, coalesce(stp.done, 0) as done_steps"
                                " from st left join dk on dk.seq = st.last_seq left join dc on dc.seq = st.last_seq"
                                " left join dd on dd.seq = st.last_seq left join sv_ad ad on ad.seq = st.last_seq"
                                " left join tk on tk.assignment_id = st.assignment_id"
                                " left join tc on tc.assignment_id = st.assignment_id"
                                " left join td on td.assignment_id = st.assignment_id"
                                " left join eval_ta_score ta on ta.assignment_id = st.assignment_id"
                                " left join eval_additional x on x.assignment_id = st.assignment_id"
                                " left join stp on stp.assignment_id = st.assignment_id")


@query("save_log_state", STATE_ORACLE)
def q_save_log_state(spark, sf_dir):
    """Per (user, form) in the save log, the tables' state after the whole log."""
    t = fixture_tables(spark, sf_dir, list(_STATE_VIEWS))
    out = workflow.apply_save_log(t, t["save_log"], AS_OF_TS)
    return workflow.state_by_key(out, t["save_log"])


_LAST = "(select last_seq, assignment_id from st where last_seq is not null) l"


def _rows_after(base: str, kept: str, source: str, fresh: str) -> str:
    """All rows of a child table after the log: those of untouched assignments, and the last saves' lists with new ids."""
    return oracle(_STATE_VIEWS, _STATE_SQL,
                  f"select id, assignment_id, {kept} from {base} where assignment_id not in (select assignment_id from {_LAST})"
                  f" union all select (select coalesce(max(id), 0) from {base}) + row_number() over (order by s.seq, s.pos) as id,"
                  f" l.assignment_id, {fresh} from {source} s join {_LAST} on l.last_seq = s.seq")


def _tables_after(spark, sf_dir):
    t = fixture_tables(spark, sf_dir, list(_STATE_VIEWS))
    return workflow.apply_save_log(t, t["save_log"], AS_OF_TS)


@query("save_log_kpis", _rows_after(
    "eval_kpi_user", "idx, code, title, cast(max_score as double) as max_score, weight, cast(score as double) as score", "sv_kpis",
    "s.idx, nullif(s.code, '') as code, s.title, cast(cast(s.max_score as decimal(6,2)) as double) as max_score, s.weight,"
    " cast(cast(s.score as decimal(6,2)) as double) as score"))
def q_save_log_kpis(spark, sf_dir):
    """The whole KPI table after the save log, new ids included."""
    return _tables_after(spark, sf_dir)["eval_kpi_user"].select(
        "id", "assignment_id", "idx", "code", "title", F.col("max_score").cast("double").alias("max_score"), "weight",
        F.col("score").cast("double").alias("score"))


@query("save_log_comp_scores", _rows_after(
    "eval_competency_score", "comp_id, cast(score as double) as score, note", "sv_cs",
    "s.comp_id, cast(cast(s.score as decimal(6,2)) as double) as score, nullif(s.note, '') as note"))
def q_save_log_comp_scores(spark, sf_dir):
    """The whole competency score table after the save log."""
    return _tables_after(spark, sf_dir)["eval_competency_score"].select(
        "id", "assignment_id", "comp_id", F.col("score").cast("double").alias("score"), "note")


@query("save_log_plans", _rows_after(
    "eval_dev_plan", "idx, content, priority, strftime(timing, '%Y-%m-%d') as timing", "sv_dp",
    "s.idx, s.content, s.priority, strftime(try_cast(nullif(trim(s.timing), '') as date), '%Y-%m-%d') as timing"))
def q_save_log_plans(spark, sf_dir):
    """The whole development plan table after the save log."""
    return _tables_after(spark, sf_dir)["eval_dev_plan"].select(
        "id", "assignment_id", "idx", "content", "priority", F.date_format("timing", "yyyy-MM-dd").alias("timing"))


@query("save_log_assignments", oracle(_STATE_VIEWS, _STATE_SQL,
                                      "select a.id, a.form_id, a.user_id, cast(coalesce(l.status, a.status) as int) as status,"
                                      " strftime(a.due_date, '%Y-%m-%d') as due_date from a1 a"
                                      " left join lastacc l on l.form_id = a.form_id and l.user_id = a.user_id"))
def q_save_log_assignments(spark, sf_dir):
    """The whole assignment table after the save log."""
    return _tables_after(spark, sf_dir)["eval_assignment"].select(
        "id", "form_id", "user_id", "status", F.date_format("due_date", "yyyy-MM-dd").alias("due_date"))


# ---------------------------------------------------------------------- D4
_RESULT_SQL = SAVE_EVENTS_CTE + ensure_cte("save_log", AS_OF_TS) + """
acc AS (select seq, form_id, user_id, req_status from res where accepted),
rk AS (select seq, coalesce(sum(case when max_score > 0 then score / max_score * cast(weight as double) else 0.0 end)
         / nullif(sum(cast(weight as double)), 0.0) * 100.0, 0.0) as k from sv_kpis
       where seq in (select seq from acc) group by seq),
rc AS (select cs.seq, coalesce(sum(case when cast(c.max_score as double) > 0
                                        then cs.score / cast(c.max_score as double) else 0.0 end
         * case when c.weight is null then 0.0 when cast(c.weight as double) <= 1 then cast(c.weight as double)
                else cast(c.weight as double) / 100.0 end) * 100.0, 0.0) as c
       from sv_cs cs join eval_competency c on c.id = cs.comp_id where cs.seq in (select seq from acc)
       group by cs.seq),
rt AS (select seq, case when ta_full > 0 then ta_score / ta_full * 100.0 else 0.0 end as t from sv_ad),
raw_r AS (select a.seq, a.form_id, a.user_id, a.req_status, f.kpi_weight, f.comp_weight, f.ta_weight,
            coalesce(rk.k, 0.0) as k, coalesce(rc.c, 0.0) as c, coalesce(rt.t, 0.0) as t
          from acc a join eval_form f on f.id = a.form_id left join rk on rk.seq = a.seq
          left join rc on rc.seq = a.seq left join rt on rt.seq = a.seq),
scored AS (select seq as assignment_id, form_id, user_id, req_status, round(k, 6) as kpi_pct,
             round(c, 6) as comp_pct, round(t, 6) as ta_pct,
             round((k * kpi_weight + c * comp_weight + t * ta_weight) / 100.0, 6) as total_pct from raw_r),""" + GRADE_CTE


@query("save_results", oracle(_SAVE_VIEWS + ("eval_grade_band",), _RESULT_SQL,
                              "select s.assignment_id as seq, a.id as assignment_id, s.req_status as status,"
                              " s.kpi_pct, s.comp_pct, s.ta_pct, s.total_pct, s.grade"
                              " from summary s join a1 a on a.form_id = s.form_id and a.user_id = s.user_id"))
def q_save_results(spark, sf_dir):
    """Response of each accepted save (assignment id, requested status, its summary)."""
    t = fixture_tables(spark, sf_dir, list(_SAVE_VIEWS) + ["eval_grade_band"])
    return workflow.save_results(t, t["save_log"], AS_OF_TS)


# ------------------------------------------------- W5/W6 over odd request bodies
# Names in another case, names twice, unknown fields, a whole body of null, bodies that are refused, numbers beyond a column.
# The oracle spells these bodies plainly first; what is refused (rej) it tells by JSON rules and the one field that is wrong.
_ODD_SRC = """
odd AS (select seq, ts, user_id, form_id, status, due_date, doc is null or not json_valid(doc) or coalesce(json_type(case when json_valid(doc) then doc end, '$.kpis[0].title') <> 'VARCHAR', false) as rej,
  doc as raw from odd_save_log),
odd_src AS (select * exclude (raw), case when not rej then replace(replace(replace(replace(raw, '"Kpis":', '"kpis":'),
  '"STATUS":', '"status":'), '"Weight":', '"weight":'), '"status":2,"status":', '"status":') end as doc from odd),
odd_ok AS (select * from odd_src where not rej),"""


def _odd(sql: str) -> str:
    """Oracle parts over the save log, over the odd one instead: refused bodies make no assignment."""
    return (sql.replace("from save_log", "from odd_src").replace('"weight":"INTEGER"', '"weight":"BIGINT"')
            .replace("where (coalesce(trim(due_date)", "where seq in (select seq from odd_ok) and (coalesce(trim(due_date)")
            .replace("coalesce(e.stored_status is not null", "e.seq in (select seq from odd_ok) and coalesce(e.stored_status is not null"))


_ODD_VIEWS = ("odd_save_log",) + _STATE_VIEWS[1:]
_ODD_STATE = _ODD_SRC + _odd(_STATE_SQL).replace("from odd_src),\na1_key", "from odd_ok),\na1_key")


def _after_odd_saves(spark, sf_dir):
    t = fixture_tables(spark, sf_dir, list(_ODD_VIEWS))
    return workflow.apply_save_log(t, t["odd_save_log"], AS_OF_TS)


@query("odd_saves_accepted", oracle(("odd_save_log",) + _SAVE_VIEWS[1:], _ODD_SRC + _odd(SAVE_EVENTS_CTE),
                                    "select seq, user_id, form_id, status, valid, accepted, creatable from res"))
def q_odd_saves_accepted(spark, sf_dir):
    """Validity and acceptance of save requests whose bodies are bound as a JSON decoder binds them."""
    t = fixture_tables(spark, sf_dir, ["odd_save_log", *_SAVE_VIEWS[1:]])
    ev = workflow.resolve_save_log(workflow.save_events(t["odd_save_log"], t["eval_assignment"], t["eval_competency"],
                                                        t["eval_form"], t["users"]))
    return ev.select("seq", "user_id", "form_id", "status", "valid", "accepted", "creatable")


@query("odd_saves_kpis", oracle(_ODD_VIEWS, _ODD_STATE,
                                f"select id, assignment_id, idx, title, weight from eval_kpi_user where assignment_id not in (select assignment_id from {_LAST})"
                                " union all select (select coalesce(max(id), 0) from eval_kpi_user) + row_number() over (order by s.seq, s.pos) as id,"
                                f" l.assignment_id, s.idx, s.title, s.weight from sv_kpis s join {_LAST} on l.last_seq = s.seq"))
def q_odd_saves_kpis(spark, sf_dir):
    """The whole KPI table after the odd save log."""
    return _after_odd_saves(spark, sf_dir)["eval_kpi_user"].select("id", "assignment_id", "idx", "title", "weight")


@query("odd_saves_assignments", oracle(_ODD_VIEWS, _ODD_STATE,
                                       "select a.id, a.form_id, a.user_id, cast(coalesce(l.status, a.status) as int) as status,"
                                       " strftime(a.due_date, '%Y-%m-%d') as due_date from a1 a"
                                       " left join lastacc l on l.form_id = a.form_id and l.user_id = a.user_id"))
def q_odd_saves_assignments(spark, sf_dir):
    """The whole assignment table after the odd save log (a number over its column still ensures its assignment)."""
    return _after_odd_saves(spark, sf_dir)["eval_assignment"].select(
        "id", "form_id", "user_id", "status", F.date_format("due_date", "yyyy-MM-dd").alias("due_date"))
