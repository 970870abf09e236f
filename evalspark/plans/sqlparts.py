"""Oracle SQL building blocks (DuckDB dialect) shared by several queries.

Every oracle inlines the fixture views as CTEs, then the reference semantics
written as plain SQL, independent of the Spark code path.
"""

from __future__ import annotations

from ..fixtures import with_clause


def oracle(views: tuple[str, ...], ctes: str, select: str) -> str:
    """``WITH <fixture views>, <ctes> <select>``."""
    head = with_clause(*views).rstrip()
    body = ("," + ctes.rstrip().rstrip(",")) if ctes.strip() else ""
    return f"{head}{body}\n{select}"


SUMMARY_VIEWS = ("eval_assignment", "eval_form", "eval_kpi_user", "eval_competency_score",
                 "eval_competency", "eval_ta_score", "eval_grade_band")

KPI_CTE = """
kpi AS (
  select assignment_id,
    coalesce(sum(case when cast(max_score as double) > 0
                      then cast(score as double) / cast(max_score as double) * cast(weight as double)
                      else 0.0 end)
             / nullif(sum(cast(weight as double)), 0.0) * 100.0, 0.0) as kpi_pct
  from eval_kpi_user group by assignment_id),"""

COMP_CTE = """
comp AS (
  select cs.assignment_id,
    coalesce(sum(case when cast(c.max_score as double) > 0
                      then cast(cs.score as double) / cast(c.max_score as double) else 0.0 end
                 * case when c.weight is null then 0.0
                        when cast(c.weight as double) <= 1 then cast(c.weight as double)
                        else cast(c.weight as double) / 100.0 end) * 100.0, 0.0) as comp_pct
  from eval_competency_score cs join eval_competency c on c.id = cs.comp_id
  group by cs.assignment_id),"""

TA_CTE = """
ta AS (
  select assignment_id,
    coalesce(case when cast(full_score as double) > 0
                  then cast(score as double) / cast(full_score as double) * 100.0 else 0.0 end, 0.0) as ta_pct,
    true as has_ta
  from eval_ta_score),"""

SCORED_CTE = KPI_CTE + COMP_CTE + TA_CTE + """
raw_scores AS (
  select a.id as assignment_id, a.form_id, a.user_id,
    cast(f.kpi_weight as int) as kpi_weight, cast(f.comp_weight as int) as comp_weight,
    cast(f.ta_weight as int) as ta_weight,
    coalesce(k.kpi_pct, 0.0) as k, coalesce(c.comp_pct, 0.0) as c, coalesce(t.ta_pct, 0.0) as t,
    coalesce(t.has_ta, false) as has_ta
  from eval_assignment a join eval_form f on f.id = a.form_id
  left join kpi k on k.assignment_id = a.id
  left join comp c on c.assignment_id = a.id
  left join ta t on t.assignment_id = a.id),
scored AS (
  select assignment_id, form_id, user_id,
    kpi_weight, round(k, 6) as kpi_pct, comp_weight, round(c, 6) as comp_pct,
    ta_weight, round(t, 6) as ta_pct, has_ta,
    round((k * kpi_weight + c * comp_weight + t * ta_weight) / 100.0, 6) as total_pct
  from raw_scores),"""

GRADE_CTE = """
cand AS (
  select s.assignment_id, case when b.form_id = s.form_id then 0 else 1 end as own_rank,
    cast(b.min_pct as double) as gmin, cast(b.max_pct as double) as gmax, b.id as band_id, b.grade
  from scored s join eval_grade_band b
    on (b.form_id = s.form_id or b.form_id is null)
   and s.total_pct between cast(b.min_pct as double) and cast(b.max_pct as double)),
best AS (
  select * from (
    select *, row_number() over (partition by assignment_id order by own_rank, gmin desc, band_id) as rn
    from cand) x where rn = 1),
summary AS (
  select s.*, coalesce(b.grade, 'N/A') as grade, coalesce(b.gmin, 0.0) as grade_min,
    coalesce(b.gmax, 0.0) as grade_max
  from scored s left join best b on b.assignment_id = s.assignment_id),"""

SUMMARY_CTE = SCORED_CTE + GRADE_CTE


# Asia/Bangkok is UTC+7 all year (no daylight saving), so the oracle can add
# the offset; the Spark side converts with the named time zone.
BKK_DATE = "cast({ts} + interval 7 hour as date)"


def ensure_cte(req: str, as_of_ts: str, out: str = "a1") -> str:
    """CTEs applying EnsureAssignment requests ``req(seq, ts, form_id, user_id, due_date)``
    to ``eval_assignment``; defines ``{out}(id, form_id, user_id, status, due_date)``.
    Needs the ``eval_form`` and ``users`` views (new pairs must name existing ones)."""
    bkk = BKK_DATE.format(ts="n.c_ts")
    return f"""
{out}_req AS (
  select seq, coalesce(ts, timestamp '{as_of_ts}') as ts, form_id, user_id,
    coalesce(trim(due_date) = '', true) as blank, try_cast(nullif(trim(due_date), '') as date) as due
  from {req}),
{out}_key AS (
  select form_id, user_id,
    max_by(due, seq) filter (where due is not null) as last_due,
    min(seq) filter (where blank or due is not null) as c_seq
  from {out}_req group by form_id, user_id),
{out}_new AS (
  select k.form_id, k.user_id, k.last_due, k.c_seq, r.ts as c_ts, r.due as c_due
  from {out}_key k join {out}_req r on r.seq = k.c_seq
  where not exists (select 1 from eval_assignment a where a.form_id = k.form_id and a.user_id = k.user_id)
    and k.form_id in (select id from eval_form) and k.user_id in (select id from users)),
{out} AS (
  select a.id, a.form_id, a.user_id, a.status, coalesce(k.last_due, a.due_date) as due_date
  from eval_assignment a left join {out}_key k on k.form_id = a.form_id and k.user_id = a.user_id
  union all
  select (select coalesce(max(id), 0) from eval_assignment) + row_number() over (order by n.c_seq) as id,
    n.form_id, n.user_id, 0 as status, coalesce(n.last_due, n.c_due, {bkk}) as due_date
  from {out}_new n),"""


KPI_JSON = ('[{"idx":"INTEGER","code":"VARCHAR","title":"VARCHAR","max_score":"DOUBLE","weight":"INTEGER",'
            '"expected_score":"DOUBLE","score":"DOUBLE","note":"VARCHAR","measure":"VARCHAR","criteria":"VARCHAR",'
            '"unit":"VARCHAR"}]')

KPI_ITEM_COLS = """coalesce(it.idx, 0) as idx, coalesce(it.code, '') as code, coalesce(it.title, '') as title,
  coalesce(it.max_score, 0.0) as max_score, coalesce(it.weight, 0) as weight,
  coalesce(it.expected_score, 0.0) as expected_score, coalesce(it.score, 0.0) as score,
  coalesce(it.note, '') as note, coalesce(it.measure, '') as measure, coalesce(it.criteria, '') as criteria,
  coalesce(it.unit, '') as unit"""

KPI_INVALID = """(not (weight between 0 and 100) or length(code) > 50 or length(title) > 300 or length(note) > 1000
  or length(measure) > 500 or length(criteria) > 1000 or length(unit) > 50)"""

SAVE_JSON = ('{"status":"INTEGER","due_date":"VARCHAR","kpis":' + KPI_JSON + ','
             '"competency_scores":[{"comp_id":"BIGINT","score":"DOUBLE","note":"VARCHAR"}],'
             '"time_attendance":{"full_score":"DOUBLE","score":"DOUBLE"},'
             '"development_plan":[{"idx":"INTEGER","content":"VARCHAR","priority":"VARCHAR","timing":"VARCHAR",'
             '"remarks":"VARCHAR"}],'
             '"additional":{"q1":"VARCHAR","q2":"VARCHAR","q3":"VARCHAR","q4":"VARCHAR","q5":"VARCHAR"}}')

# save_log -> sv_docs(seq, d), sv_kpis, sv_cs, sv_dp, sv_ad, res(seq, ..., valid, accepted)
SAVE_EVENTS_CTE = """
sv_docs AS (select seq, from_json(doc, '""" + SAVE_JSON + """') as d from save_log),
sv_kpis AS (select seq, pos - 1 as pos, """ + KPI_ITEM_COLS + """
            from (select seq, pos, d.kpis[pos] as it
                  from (select seq, d, generate_subscripts(d.kpis, 1) as pos from sv_docs) x) y),
sv_cs AS (select seq, pos - 1 as pos, it.comp_id as comp_id, coalesce(it.score, 0.0) as score,
                 coalesce(it.note, '') as note
          from (select seq, pos, d.competency_scores[pos] as it
                from (select seq, d, generate_subscripts(d.competency_scores, 1) as pos from sv_docs) x) y),
sv_dp AS (select seq, pos, coalesce(it.idx, 0) as idx, coalesce(it.timing, '') as timing, coalesce(it.content, '') as content,
                 coalesce(it.priority, '') as priority, coalesce(it.remarks, '') as remarks
          from (select seq, pos, d.development_plan[pos] as it
                from (select seq, d, generate_subscripts(d.development_plan, 1) as pos from sv_docs) x) y),
sv_ad AS (select seq, coalesce(d.additional.q1, '') as q1, coalesce(d.additional.q2, '') as q2,
                 coalesce(d.additional.q3, '') as q3, coalesce(d.additional.q4, '') as q4,
                 coalesce(d.additional.q5, '') as q5,
                 coalesce(d.time_attendance.full_score, 0.0) as ta_full, coalesce(d.time_attendance.score, 0.0) as ta_score
          from sv_docs),
sv_bad AS (
  select seq from sv_kpis where """ + KPI_INVALID + """
  union select seq from sv_cs group by seq, comp_id having count(*) > 1
  union select seq from sv_cs where comp_id is null or comp_id not in (select id from eval_competency)
  union select seq from sv_cs where length(note) > 1000
  union select seq from sv_dp where (trim(timing) <> '' and try_cast(nullif(trim(timing), '') as date) is null)
    or length(content) > 1000 or length(priority) > 20 or length(remarks) > 500
  union select seq from sv_ad where length(q1) > 2000 or length(q2) > 2000 or length(q3) > 2000
    or length(q4) > 2000 or length(q5) > 2000),
sv_ev AS (select s.seq, s.ts, s.user_id, s.form_id, s.due_date, coalesce(d.d.status, 0) as req_status,
                 a.status as stored_status
          from save_log s join sv_docs d on d.seq = s.seq
          left join eval_assignment a on a.form_id = s.form_id and a.user_id = s.user_id),
sv_fc AS (select form_id, user_id, min(seq) as c from sv_ev
          where (coalesce(trim(due_date) = '', true) or try_cast(nullif(trim(due_date), '') as date) is not null)
            and form_id in (select id from eval_form) and user_id in (select id from users)
          group by form_id, user_id),
sv_ev2 AS (select e.*, cast(case when req_status between 0 and 2 then req_status else 0 end as int) as status,
                  coalesce(e.stored_status is not null or e.seq >= f.c, false) as creatable
           from sv_ev e left join sv_fc f on f.form_id = e.form_id and f.user_id = e.user_id),
sv_ev3 AS (select *, creatable and seq not in (select seq from sv_bad) as valid from sv_ev2),
sv_lock AS (select user_id, form_id, min(seq) as lock_seq from sv_ev3 where valid and status = 2
            group by user_id, form_id),
res AS (select e.*, e.valid and not coalesce(e.stored_status = 2, false)
               and (l.lock_seq is null or e.seq <= l.lock_seq) as accepted
        from sv_ev3 e left join sv_lock l on l.user_id = e.user_id and l.form_id = e.form_id),"""
