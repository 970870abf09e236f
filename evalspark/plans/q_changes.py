"""Registered queries: table changes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import AS_OF_TS, fixture_tables
from ..functions import scalars as sc
from ..operators import changes, documents, requests
from ..sources.tables import conform
from .registry import query
from .sqlparts import KPI_INVALID, KPI_ITEM_COLS, KPI_JSON, ensure_cte, oracle


def _dbl(c):
    return F.col(c).cast("double").alias(c)


# ------------------------------------------------------------------ W1 / M4
_NEW_KEYS = """
req AS (select seq, form_id, user_id, due_date from save_log),
keys AS (select form_id, user_id, min(seq) as c_seq from req
         where coalesce(trim(due_date) = '', true) or try_cast(nullif(trim(due_date), '') as date) is not null
         group by form_id, user_id),
newk AS (select * from keys k where not exists
         (select 1 from eval_assignment a where a.form_id = k.form_id and a.user_id = k.user_id)
         and k.form_id in (select id from eval_form) and k.user_id in (select id from users)),"""


@query("dense_ids", oracle(("save_log", "eval_assignment", "eval_form", "users"), _NEW_KEYS,
                           "select form_id, user_id, (select max(id) from eval_assignment)"
                           " + row_number() over (order by c_seq) as id from newk"))
def q_dense_ids(spark, sf_dir):
    """Dense new ids for save-log keys that have no assignment, in order of first request."""
    t = fixture_tables(spark, sf_dir, ["save_log", "eval_assignment", "eval_form", "users"])
    s = t["save_log"]
    ok = sc.is_blank("due_date") | sc.try_date("due_date").isNotNull()
    keys = s.where(ok).groupBy("form_id", "user_id").agg(F.min("seq").alias("c_seq"))
    new = changes.with_parents(keys.join(t["eval_assignment"], ["form_id", "user_id"], "left_anti"),
                               t["eval_form"], t["users"])
    return changes.assign_ids(new, ["c_seq"], changes.max_id(t["eval_assignment"])).select(
        "form_id", "user_id", "id")


@query("ensure_assignments", oracle(("save_log", "eval_assignment", "eval_form", "users"),
                                    ensure_cte("save_log", AS_OF_TS),
                                    "select id, form_id, user_id, status,"
                                    " strftime(due_date, '%Y-%m-%d') as due_date from a1"))
def q_ensure_assignments(spark, sf_dir):
    """M4: assignment table after every save-log request's get-or-create and due update."""
    t = fixture_tables(spark, sf_dir, ["save_log", "eval_assignment", "eval_form", "users"])
    a = changes.ensure_assignments(t["eval_assignment"], t["save_log"], AS_OF_TS, t["eval_form"], t["users"])
    return a.select("id", "form_id", "user_id", "status", sc.iso_date("due_date").alias("due_date"))


# ----------------------------------------------------------------- M1 / M2
_KPI_BULK = """
kb_docs AS (select seq, form_id, user_id, from_json(doc, '{"items":""" + KPI_JSON + ""","due_date":"VARCHAR"}') as d
            from kpi_bulk_log),
nonempty AS (select seq, form_id, user_id, coalesce(d.due_date, '') as due_date, cast(null as timestamp) as ts,
             d.items as items from kb_docs where coalesce(len(d.items), 0) > 0),
kb_items AS (select seq, form_id, user_id, pos - 1 as pos, items[pos] as it
             from (select *, generate_subscripts(items, 1) as pos from nonempty) x),
kb_rows AS (select seq, form_id, user_id, pos, """ + KPI_ITEM_COLS + """ from kb_items),
kb_bad AS (select distinct seq from kb_rows where """ + KPI_INVALID + """),""" + ensure_cte("nonempty", AS_OF_TS)

_KPI_OUT = ("id, assignment_id, idx, code, title, max_score, weight, expected_score, score, note, measure,"
            " criteria, unit")
_KPI_BASE = ("select id, assignment_id, idx, code, title, cast(max_score as double) as max_score, weight,"
             " cast(expected_score as double) as expected_score, cast(score as double) as score,"
             " cast(null as varchar) as note, cast(null as varchar) as measure, cast(null as varchar) as criteria,"
             " cast(null as varchar) as unit")
_KPI_NEW = ("(select max(id) from eval_kpi_user) + row_number() over (order by seq, pos) as id, assignment_id, idx,"
            " {code} as code, title, cast(cast(max_score as decimal(6,2)) as double) as max_score, weight,"
            " cast(cast(expected_score as decimal(6,2)) as double) as expected_score,"
            " cast(cast(score as decimal(6,2)) as double) as score, nullif(note, '') as note,"
            " nullif(measure, '') as measure, nullif(criteria, '') as criteria, nullif(unit, '') as unit")

_APPEND_SQL = _KPI_BULK + """
newrows AS (select r.*, a.id as assignment_id from kb_rows r
            join a1 a on a.form_id = r.form_id and a.user_id = r.user_id
            where r.seq not in (select seq from kb_bad)),
allrows AS (""" + _KPI_BASE + """ from eval_kpi_user
            union all select """ + _KPI_NEW.format(code="code") + """ from newrows),"""


def _kpi_out(df):
    return df.select("id", "assignment_id", "idx", "code", "title", _dbl("max_score"), "weight",
                     _dbl("expected_score"), _dbl("score"), "note", "measure", "criteria", "unit",
                     F.col("updated_at").isNotNull().alias("stamped"))


@query("append_kpis", oracle(("eval_assignment", "eval_kpi_user", "kpi_bulk_log", "eval_form", "users"), _APPEND_SQL,
                             f"select {_KPI_OUT}, assignment_id in (select assignment_id from newrows) as stamped"
                             " from allrows"))
def q_append_kpis(spark, sf_dir):
    """M1: KPI table after the bulk-append requests (ensure assignment, append, stamp parent)."""
    t = fixture_tables(spark, sf_dir, ["eval_assignment", "eval_kpi_user", "kpi_bulk_log", "eval_form", "users"])
    out = requests.append_kpi_requests(t, t["kpi_bulk_log"], AS_OF_TS)
    return _kpi_out(out["eval_kpi_user"])


_REPLACE_SQL = _KPI_BULK + """
good AS (select n.seq, a.id as assignment_id from nonempty n
         join a1 a on a.form_id = n.form_id and a.user_id = n.user_id where n.seq not in (select seq from kb_bad)),
lastreq AS (select assignment_id, max(seq) as seq from good group by assignment_id),
keep AS (select r.*, l.assignment_id from kb_rows r join lastreq l on l.seq = r.seq),
allrows AS (""" + _KPI_BASE + """, false as stamped from eval_kpi_user
            where assignment_id not in (select assignment_id from lastreq)
            union all select """ + _KPI_NEW.format(code="nullif(code, '')") + """, true as stamped from keep),"""


@query("replace_kpis", oracle(("eval_assignment", "eval_kpi_user", "kpi_bulk_log", "eval_form", "users"),
                              _REPLACE_SQL,
                              f"select {_KPI_OUT}, stamped from allrows"))
def q_replace_kpis(spark, sf_dir):
    """M2: KPI table after the replace-all requests (last valid list per assignment wins)."""
    t = fixture_tables(spark, sf_dir, ["eval_assignment", "eval_kpi_user", "kpi_bulk_log", "eval_form", "users"])
    out = requests.replace_kpi_requests(t, t["kpi_bulk_log"], AS_OF_TS)
    return _kpi_out(out["eval_kpi_user"])


_COMP_BULK = """
cb_docs AS (select seq, form_id, from_json(doc, '{"items":[{"idx":"INTEGER","title":"VARCHAR","max_score":"DOUBLE",
  "weight":"DOUBLE","full_total":"DOUBLE","expected_score":"DOUBLE"}]}') as d from comp_bulk_log),
cb_items AS (select seq, form_id, pos - 1 as pos, items[pos] as it
             from (select seq, form_id, d.items as items, generate_subscripts(d.items, 1) as pos
                   from cb_docs where coalesce(len(d.items), 0) > 0) x),
cb_rows AS (select seq, form_id, pos, coalesce(it.idx, 0) as idx, coalesce(it.title, '') as title,
            cast(coalesce(it.max_score, 0) as decimal(10,2)) as max_score,
            cast(coalesce(it.weight, 0) as decimal(18,4)) as weight,
            cast(coalesce(it.full_total, 0) as decimal(18,2)) as full_total,
            cast(coalesce(it.expected_score, 0) as decimal(10,2)) as expected_score from cb_items),
cb_ok AS (select * from cb_rows where seq not in (select seq from cb_rows where length(title) > 300)),"""


@query("append_competencies", oracle(("eval_competency", "comp_bulk_log"), _COMP_BULK,
                                     "select id, form_id, idx, title, cast(max_score as double) as max_score,"
                                     " cast(weight as double) as weight, cast(full_total as double) as full_total,"
                                     " cast(expected_score as double) as expected_score,"
                                     " form_id in (select form_id from cb_ok) as stamped from eval_competency"
                                     " union all select (select max(id) from eval_competency)"
                                     " + row_number() over (order by seq, pos), form_id, idx, title,"
                                     " cast(max_score as double), cast(weight as double), cast(full_total as double),"
                                     " cast(expected_score as double), true from cb_ok"))
def q_append_competencies(spark, sf_dir):
    """M1: competency table after the bulk-append requests per form."""
    t = fixture_tables(spark, sf_dir, ["eval_competency", "comp_bulk_log"])
    out = requests.append_competency_requests(t, t["comp_bulk_log"], AS_OF_TS)
    return out.select("id", "form_id", "idx", "title", _dbl("max_score"), _dbl("weight"), _dbl("full_total"),
                      _dbl("expected_score"), F.col("updated_at").isNotNull().alias("stamped"))


# ---------------------------------------------------------------------- M3
_TA_SQL = """
ta_docs AS (select s.seq, a.id as assignment_id,
              from_json(s.doc, '{"time_attendance":{"full_score":"DOUBLE","score":"DOUBLE"}}') as d
            from save_log s join eval_assignment a on a.form_id = s.form_id and a.user_id = s.user_id),
ta_last AS (select assignment_id, max_by(d, seq) as d from ta_docs group by assignment_id),"""


@query("upsert_ta", oracle(("save_log", "eval_assignment", "eval_ta_score"), _TA_SQL,
                           "select assignment_id, cast(full_score as double) as full_score,"
                           " cast(score as double) as score from eval_ta_score"
                           " where assignment_id not in (select assignment_id from ta_last)"
                           " union all select assignment_id,"
                           " cast(cast(coalesce(d.time_attendance.full_score, 0) as decimal(6,2)) as double),"
                           " cast(cast(coalesce(d.time_attendance.score, 0) as decimal(6,2)) as double) from ta_last"))
def q_upsert_ta(spark, sf_dir):
    """M3: TA score table after merging the latest TA of each assignment named in the save log."""
    t = fixture_tables(spark, sf_dir, ["save_log", "eval_assignment", "eval_ta_score"])
    out = requests.upsert_ta_from_saves(t, t["save_log"])
    return out.select("assignment_id", _dbl("full_score"), _dbl("score"))


_ATT_SQL = """
at_docs AS (select seq, user_id, from_json(doc, '{"time_attendance":[{"name":"VARCHAR","value":"VARCHAR"}],
  "score_max":"INTEGER","score_obtained":"INTEGER","penalty_total":"INTEGER"}') as d from attendance_log),
at_items AS (select seq, user_id, coalesce(it.name, '') as name, coalesce(it.value, '') as value
             from (select seq, user_id, unnest(d.time_attendance) as it from at_docs) x),
at_bad AS (select seq from at_items group by seq, name having count(*) > 1
           union select seq from at_items where length(name) > 64 or length(value) > 32),
at_good AS (select * from at_docs where user_id in (select id from users) and seq not in (select seq from at_bad)),
at_last AS (select user_id, max(seq) as seq from at_good group by user_id),
at_lastd AS (select g.* from at_good g join at_last l on l.seq = g.seq),"""
_ATT_VIEWS = ("users", "attendance_log", "user_time_attendance", "user_time_attendance_items")


@query("upsert_attendance", oracle(_ATT_VIEWS, _ATT_SQL,
                                   "select user_id, score_max, score_obtained, penalty_total from user_time_attendance"
                                   " where user_id not in (select user_id from at_last)"
                                   " union all select user_id, coalesce(d.score_max, 0), coalesce(d.score_obtained, 0),"
                                   " coalesce(d.penalty_total, 0) from at_lastd"))
def q_upsert_attendance(spark, sf_dir):
    """M3: per-user attendance summary after the attendance upserts (last valid per user)."""
    t = fixture_tables(spark, sf_dir, list(_ATT_VIEWS))
    return requests.attendance_requests(t, t["attendance_log"])["user_time_attendance"]


@query("replace_attendance_items", oracle(_ATT_VIEWS, _ATT_SQL,
                                          "select user_id, name, value from user_time_attendance_items"
                                          " where user_id not in (select user_id from at_last)"
                                          " union all select i.user_id, i.name, i.value from at_items i"
                                          " join at_last l on l.seq = i.seq"))
def q_replace_attendance_items(spark, sf_dir):
    """M2: attendance items after the upserts (whole list replaced, empty list clears)."""
    t = fixture_tables(spark, sf_dir, list(_ATT_VIEWS))
    return requests.attendance_requests(t, t["attendance_log"])["user_time_attendance_items"]


# ----------------------------------------------------------------- M5 / M6
_UPD_SQL = """
auth AS (select c.* from kpi_changes c join eval_kpi_user k on k.id = c.kpi_id
         join eval_assignment a on a.id = k.assignment_id
         where a.form_id = c.form_id and a.user_id = c.user_id and c.weight between 0 and 100
           and length(c.code) <= 50 and length(c.title) <= 300 and length(c.note) <= 1000
           and length(c.measure) <= 500 and length(c.criteria) <= 1000 and length(c.unit) <= 50),
lastc AS (select * from (select *, row_number() over (partition by kpi_id order by seq desc) as rn from auth) x
          where rn = 1),"""


@query("update_kpis", oracle(("kpi_changes", "eval_kpi_user", "eval_assignment"), _UPD_SQL,
                             "select k.id, k.assignment_id,"
                             " case when l.kpi_id is null then k.idx else l.idx end as idx,"
                             " case when l.kpi_id is null then k.code else nullif(l.code, '') end as code,"
                             " case when l.kpi_id is null then k.title else l.title end as title,"
                             " cast(case when l.kpi_id is null then k.max_score"
                             "      else cast(l.max_score as decimal(6,2)) end as double) as max_score,"
                             " case when l.kpi_id is null then k.weight else l.weight end as weight,"
                             " cast(case when l.kpi_id is null then k.expected_score"
                             "      else cast(l.expected_score as decimal(6,2)) end as double) as expected_score,"
                             " cast(case when l.kpi_id is null then k.score"
                             "      else cast(l.score as decimal(6,2)) end as double) as score,"
                             " case when l.kpi_id is null then null else nullif(l.note, '') end as note,"
                             " case when l.kpi_id is null then null else nullif(l.measure, '') end as measure,"
                             " case when l.kpi_id is null then null else nullif(l.criteria, '') end as criteria,"
                             " case when l.kpi_id is null then null else nullif(l.unit, '') end as unit,"
                             " l.kpi_id is not null as stamped"
                             " from eval_kpi_user k left join lastc l on l.kpi_id = k.id"))
def q_update_kpis(spark, sf_dir):
    """M5: KPI table after owned full-overwrite updates (unowned or invalid changes skipped)."""
    t = fixture_tables(spark, sf_dir, ["kpi_changes", "eval_kpi_user", "eval_assignment"])
    new, _report = changes.update_owned_kpis(conform(t["eval_kpi_user"], "eval_kpi_user"), t["eval_assignment"],
                                             t["kpi_changes"], AS_OF_TS)
    return _kpi_out(new)


@query("update_report", oracle(("kpi_changes", "eval_kpi_user", "eval_assignment"), _UPD_SQL,
                               "select c.seq, c.kpi_id, c.seq in (select seq from auth) as updated from kpi_changes c"))
def q_update_report(spark, sf_dir):
    """Per owned-update request, whether it changed a row (owned and within the table rules)."""
    t = fixture_tables(spark, sf_dir, ["kpi_changes", "eval_kpi_user", "eval_assignment"])
    _, report = changes.update_owned_kpis(conform(t["eval_kpi_user"], "eval_kpi_user"), t["eval_assignment"],
                                          t["kpi_changes"], AS_OF_TS)
    return report


_DEL_SQL = """
dauth AS (select d.* from kpi_deletes d join eval_kpi_user k on k.id = d.kpi_id
          join eval_assignment a on a.id = k.assignment_id where a.form_id = d.form_id and a.user_id = d.user_id),
dfirst AS (select kpi_id, min(seq) as seq from dauth group by kpi_id),"""


@query("delete_kpis", oracle(("kpi_deletes", "eval_kpi_user", "eval_assignment"), _DEL_SQL,
                             "select id, assignment_id from eval_kpi_user where id not in (select kpi_id from dfirst)"))
def q_delete_kpis(spark, sf_dir):
    """M6: KPI rows left after owned deletes."""
    t = fixture_tables(spark, sf_dir, ["kpi_deletes", "eval_kpi_user", "eval_assignment"])
    remaining, _ = changes.delete_owned_kpis(t["eval_kpi_user"], t["eval_assignment"], t["kpi_deletes"])
    return remaining.select("id", "assignment_id")


@query("delete_report", oracle(("kpi_deletes", "eval_kpi_user", "eval_assignment"), _DEL_SQL,
                               "select d.seq, d.kpi_id, f.seq is not null as deleted from kpi_deletes d"
                               " left join dfirst f on f.kpi_id = d.kpi_id and f.seq = d.seq"))
def q_delete_report(spark, sf_dir):
    """Per delete request, whether it removed a row (rows affected > 0)."""
    t = fixture_tables(spark, sf_dir, ["kpi_deletes", "eval_kpi_user", "eval_assignment"])
    _, report = changes.delete_owned_kpis(t["eval_kpi_user"], t["eval_assignment"], t["kpi_deletes"])
    return report


# ----------------------------------------------------------------- M7 / M8
_USER_JSON = ('{"name":"VARCHAR","email":"VARCHAR","role":"VARCHAR","personcode":"VARCHAR","position":"VARCHAR",'
              '"department":"VARCHAR","urlimage":"VARCHAR","start_date":"VARCHAR","confirm_date":"VARCHAR",'
              '"password":"VARCHAR","company_ids":["VARCHAR"]}')
_FIELDS = ("name", "email", "role", "personcode", "position", "department", "urlimage", "start_date", "confirm_date")
_LEN_OK = ("coalesce(length(name), 0) <= 120 and coalesce(length(email), 0) <= 200"
           " and coalesce(length(role), 0) <= 50 and coalesce(length(personcode), 0) <= 50"
           " and coalesce(length(position), 0) <= 120 and coalesce(length(department), 0) <= 120"
           " and coalesce(length(urlimage), 0) <= 255")

_DATES_OK = " and ".join(f"(coalesce(trim({c}), '') = '' or try_cast(trim({c}) as date) is not null)"
                         for c in ("start_date", "confirm_date"))

_PATCH_SQL = """
pd AS (select seq, user_id, from_json(doc, '""" + _USER_JSON + """') as d from user_patches
       where json_valid(doc) and user_id in (select id from users)),
pp AS (select seq, user_id, """ + ", ".join(f"d.{f} as {f}" for f in _FIELDS) + """, d.company_ids as company_ids
       from pd),
pok AS (select * from pp where """ + _LEN_OK + " and " + _DATES_OK + """),
plast AS (select user_id, """ + ", ".join(f"max_by({f}, seq) filter (where {f} is not null) as {f}" for f in _FIELDS) + """,
          max_by(company_ids, seq) filter (where company_ids is not null) as company_ids from pok group by user_id),
nu AS (select u.id, coalesce(l.name, u.name) as name, coalesce(l.email, u.email) as email,
         coalesce(l.role, u.role) as role, coalesce(l.personcode, u.person_code) as person_code,
         coalesce(l.position, cast(null as varchar)) as position, coalesce(l.department, u.department) as department,
         case when l.start_date is not null then try_cast(nullif(trim(l.start_date), '') as date)
              else u.start_date end as start_date,
         case when l.confirm_date is not null then try_cast(nullif(trim(l.confirm_date), '') as date)
              else u.confirm_date end as confirm_date
       from users u left join plast l on l.user_id = u.id),
plists AS (select user_id, company_ids from plast where company_ids is not null),
pnew AS (select distinct user_id, company_id from (
           select user_id, try_cast(unnest(company_ids) as bigint) as company_id from plists) x
         where company_id in (select id from companies)),
nlinks AS (select user_id, company_id from user_companies where user_id not in (select user_id from plists)
           union all select user_id, company_id from pnew),
nl AS (select l.user_id, count(*) as companies, string_agg(c.code, ',' order by c.id) as company_codes
       from nlinks l join companies c on c.id = l.company_id group by l.user_id),"""


@query("patch_users", oracle(("users", "user_companies", "companies", "user_patches"), _PATCH_SQL,
                             "select u.id, u.name, u.email, u.role, u.person_code, u.position, u.department,"
                             " strftime(u.start_date, '%Y-%m-%d') as start_date,"
                             " strftime(u.confirm_date, '%Y-%m-%d') as confirm_date,"
                             " coalesce(nl.companies, 0) as companies, coalesce(nl.company_codes, '') as company_codes"
                             " from nu u left join nl on nl.user_id = u.id"))
def q_patch_users(spark, sf_dir):
    """M7: user profiles after presence-aware patches (fields and company lists)."""
    t = fixture_tables(spark, sf_dir, ["users", "user_companies", "companies", "user_patches"])
    users, links = requests.patch_user_requests(t, t["user_patches"])
    prof = documents.user_profiles(users, links, t["companies"])
    return prof.select("id", "name", "email", "role", "person_code", "position", "department", "start_date",
                       "confirm_date", F.size("company").cast("long").alias("companies"),
                       F.concat_ws(",", F.transform("company", lambda c: c["code"])).alias("company_codes"))


# each patch in order against the values in use then: the table as (id, email, code) lists carried from patch to patch
_UNIQUE_SQL = """
kd AS (select seq, user_id, from_json(doc, '""" + _USER_JSON + """') as d from key_patches where user_id in (select id from users)),
kp AS (select seq, user_id, d.name as name, d.email as email, d.personcode as code, d.role as role, d.position as position,
         row_number() over (order by seq) as rn from kd),
walk(rn, emails, codes, failed) AS (
  select cast(0 as bigint), map_from_entries(list((id, email))), map_from_entries(list((id, person_code))), cast([] as bigint[]) from users
  union all
  select p.rn, case when ok and p.email is not null then map_concat(w.emails, map([p.user_id], [p.email])) else w.emails end,
    case when ok and p.code is not null then map_concat(w.codes, map([p.user_id], [p.code])) else w.codes end,
    case when ok then w.failed else list_append(w.failed, p.seq) end
  from walk w join kp p on p.rn = w.rn + 1,
    lateral (select not (p.email is not null and coalesce(w.emails[p.user_id] <> p.email, true) and list_contains(map_values(w.emails), p.email))
               and not (p.code is not null and coalesce(w.codes[p.user_id] <> p.code, true) and list_contains(map_values(w.codes), p.code)) as ok) x),
good AS (select * from kp where seq not in (select unnest(failed) from walk where rn = (select max(rn) from walk))),
glast AS (select user_id, max_by(name, seq) filter (where name is not null) as name, max_by(email, seq) filter (where email is not null) as email,
            max_by(code, seq) filter (where code is not null) as code, max_by(role, seq) filter (where role is not null) as role
          from good group by user_id),"""


@query("patch_unique_users", "WITH RECURSIVE " + oracle(("users", "key_patches"), _UNIQUE_SQL,
                                                        "select u.id, coalesce(g.name, u.name) as name, coalesce(g.email, u.email) as email,"
                                                        " coalesce(g.code, u.person_code) as person_code, coalesce(g.role, u.role) as role"
                                                        " from users u left join glast g on g.user_id = u.id")[5:])
def q_patch_unique_users(spark, sf_dir):
    """M7: users after patches that ask for emails and codes others hold, held, or ask for too."""
    t = fixture_tables(spark, sf_dir, ["users", "user_companies", "companies", "key_patches"])
    users, _ = requests.patch_user_requests(t, t["key_patches"])
    return users.select("id", "name", "email", "person_code", "role")


_CREATE_SQL = """
cd AS (select seq, from_json(doc, '""" + _USER_JSON + """') as d from user_creates where json_valid(doc)),
cr AS (select seq, """ + ", ".join(f"coalesce(d.{f}, '') as {f}" for f in _FIELDS) + """, d.company_ids as company_ids
       from cd),
c1 AS (select * from cr where """ + _LEN_OK + " and " + _DATES_OK + """ and email not in (select email from users)
       and personcode not in (select person_code from users where person_code is not null)),
cn AS (select *, row_number() over (order by seq) as rn from c1),
walk(rn, seqs, emails, codes) AS (
  select cast(0 as bigint), cast([] as bigint[]), cast([] as varchar[]), cast([] as varchar[])
  union all
  select nrn, case when ok then list_append(seqs, seq) else seqs end,
    case when ok then list_append(emails, email) else emails end,
    case when ok then list_append(codes, personcode) else codes end
  from (select w.seqs, w.emails, w.codes, n.seq, n.email, n.personcode, n.rn as nrn,
          not list_contains(w.emails, n.email) and not list_contains(w.codes, n.personcode) as ok
        from walk w join cn n on n.rn = w.rn + 1) x),
taken AS (select unnest(seqs) as seq from walk where rn = (select max(rn) from walk)),
created AS (select (select max(id) from users) + row_number() over (order by seq) as id, * from c1
            where seq in (select seq from taken)),"""


def _recursive(sql: str) -> str:
    return "WITH RECURSIVE " + sql[5:]


@query("create_users", _recursive(oracle(("users", "user_creates"), _CREATE_SQL,
                              "select id, seq, name, email, role, personcode as person_code, position, department,"
                              " urlimage as url_image,"
                              " strftime(try_cast(nullif(trim(start_date), '') as date), '%Y-%m-%d') as start_date,"
                              " strftime(try_cast(nullif(trim(confirm_date), '') as date), '%Y-%m-%d')"
                              "   as confirm_date from created")))
def q_create_users(spark, sf_dir):
    """M8: users created by the create requests (duplicates by email / person code refused)."""
    t = fixture_tables(spark, sf_dir, ["users", "companies", "user_creates"])
    new_users, _ = requests.create_user_requests(t, t["user_creates"])
    return new_users.select("id", "seq", "name", "email", "role", "person_code", "position", "department",
                            "url_image", sc.iso_date("start_date").alias("start_date"),
                            sc.iso_date("confirm_date").alias("confirm_date"))


@query("create_user_links", _recursive(oracle(("users", "user_creates", "companies"), _CREATE_SQL,
                                   "select distinct user_id, company_id from ("
                                   " select id as user_id, try_cast(unnest(company_ids) as bigint) as company_id"
                                   " from created) x where company_id in (select id from companies)")))
def q_create_user_links(spark, sf_dir):
    """M8: company links of the created users (unknown and repeated ids skipped)."""
    t = fixture_tables(spark, sf_dir, ["users", "companies", "user_creates"])
    _, links = requests.create_user_requests(t, t["user_creates"])
    return links.select("user_id", "company_id")


# ---------------------------------------------------------------------- M9
_CASCADE_TABLES = ("users", "user_companies", "user_time_attendance", "user_time_attendance_items",
                   "eval_assignment", "eval_kpi_user", "eval_competency_score", "eval_ta_score", "eval_dev_plan",
                   "eval_additional", "eval_step")
_CASCADE_SQL = """
req AS (select distinct user_id as uid from user_deletes),
step_owner AS (select distinct s.evaluator_id, a.user_id as owner from eval_step s
               join eval_assignment a on a.id = s.assignment_id),
refused(uid) AS (
  select evaluator_id from step_owner where evaluator_id in (select uid from req)
    and owner not in (select uid from req)
  union
  select so.evaluator_id from step_owner so join refused r on so.owner = r.uid
  where so.evaluator_id in (select uid from req)),
gone AS (select uid from req where uid not in (select uid from refused)),
gone_a AS (select id from eval_assignment where user_id in (select uid from gone)),
counts AS (
  select 'users' as table_name, count(*) as n from users where id not in (select uid from gone)
  union all select 'user_companies', count(*) from user_companies where user_id not in (select uid from gone)
  union all select 'user_time_attendance', count(*) from user_time_attendance where user_id not in (select uid from gone)
  union all select 'user_time_attendance_items', count(*) from user_time_attendance_items
    where user_id not in (select uid from gone)
  union all select 'eval_assignment', count(*) from eval_assignment where user_id not in (select uid from gone)
  union all select 'eval_kpi_user', count(*) from eval_kpi_user where assignment_id not in (select id from gone_a)
  union all select 'eval_competency_score', count(*) from eval_competency_score
    where assignment_id not in (select id from gone_a)
  union all select 'eval_ta_score', count(*) from eval_ta_score where assignment_id not in (select id from gone_a)
  union all select 'eval_dev_plan', count(*) from eval_dev_plan where assignment_id not in (select id from gone_a)
  union all select 'eval_additional', count(*) from eval_additional where assignment_id not in (select id from gone_a)
  union all select 'eval_step', count(*) from eval_step where assignment_id not in (select id from gone_a)
  union all select 'deleted_users', count(*) from gone),"""


@query("cascade_delete_counts", "WITH RECURSIVE " + oracle(_CASCADE_TABLES + ("user_deletes",), _CASCADE_SQL,
                                                           "select table_name, n as rows from counts")[5:])
def q_cascade_delete_counts(spark, sf_dir):
    """M9: row count of every table after deleting users with cascades (evaluators refused)."""
    t = fixture_tables(spark, sf_dir, list(_CASCADE_TABLES) + ["user_deletes"])
    tables = {k: t[k] for k in _CASCADE_TABLES}
    out, gone = changes.cascade_delete_users(tables, t["user_deletes"])
    parts = [out[k].agg(F.count(F.lit(1)).alias("rows")).select(F.lit(k).alias("table_name"), "rows")
             for k in _CASCADE_TABLES]
    parts.append(gone.agg(F.count(F.lit(1)).alias("rows")).select(F.lit("deleted_users").alias("table_name"), "rows"))
    res = parts[0]
    for p in parts[1:]:
        res = res.unionByName(p)
    return res


# ---------------------------------------------------------------------- P8
_FORM_REQ_SQL = """
fr AS (select * from form_requests
       where not ((nullif(trim(eval_start), '') is not null and try_cast(nullif(trim(eval_start), '') as date) is null)
               or (nullif(trim(eval_end), '') is not null and try_cast(nullif(trim(eval_end), '') as date) is null))
         and coalesce(length(code), 0) <= 50 and coalesce(length(title_th), 0) <= 200
         and coalesce(length(title_en), 0) <= 200 and coalesce(length(remark), 0) <= 500
         and code not in (select code from eval_form)),
fr2 AS (select * from fr where seq in (select min(seq) from fr group by code)),
fc AS (select (select max(id) from eval_form) + row_number() over (order by seq) as id, * from fr2),"""


@query("prepare_forms", oracle(("eval_form", "form_requests"), _FORM_REQ_SQL,
                               "select id, seq, code, title_th, title_en, kpi_weight,"
                               " comp_weight, ta_weight, case when total_weight = 0 then 100 else total_weight end"
                               " as total_weight, calc_method, score_scheme,"
                               " strftime(try_cast(nullif(trim(eval_start), '') as date), '%Y-%m-%d') as eval_start,"
                               " strftime(try_cast(nullif(trim(eval_end), '') as date), '%Y-%m-%d') as eval_end,"
                               " nullif(remark, '') as remark from fc"))
def q_prepare_forms(spark, sf_dir):
    """P8 + W1 + P6: forms created from requests (defaults, blank dates/remark -> NULL, taken codes refused)."""
    t = fixture_tables(spark, sf_dir, ["eval_form", "form_requests"])
    f = requests.prepare_forms(t["eval_form"], t["form_requests"])
    return f.select("id", "seq", "code", "title_th", "title_en", "kpi_weight", "comp_weight", "ta_weight",
                    "total_weight", "calc_method", "score_scheme", sc.iso_date("eval_start").alias("eval_start"),
                    sc.iso_date("eval_end").alias("eval_end"), "remark")
