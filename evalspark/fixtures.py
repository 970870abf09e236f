"""Fixture views over the driver's TPC-H-style parquet tables.

Each view gives rows in the schema of one evaluation table (see
``evalspark.schemas``).  The same SQL text runs on Spark and DuckDB, so the
oracle queries inline exactly what the Spark queries read.  The views only
shape input; no operator in the library looks at how they were made.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

RAW_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
)

# The fixture as-of instant (FIXTURES.md) used by every query
# that needs "today" or "now".
AS_OF_DATE = "2025-02-28"
AS_OF_TS = "2025-02-28 00:00:00"

# name -> (SQL text, fixture views it reads)
VIEWS: dict[str, tuple[str, tuple[str, ...]]] = {
    "users": ("""
select c_custkey as id, concat('P', lpad(cast(c_custkey as varchar(10)), 6, '0')) as person_code,
 c_name as name, concat(lower(c_name), '@example.com') as email,
 case when c_custkey % 7 = 0 then null when c_custkey % 10 = 0 then 'admin' else 'user' end as role,
 c_mktsegment as department, date '2010-01-01' + cast((c_custkey * 37) % 5000 as int) as start_date,
 case when c_custkey % 5 = 0 then null else date '2010-01-01' + cast((c_custkey * 37) % 5000 + 119 as int) end as confirm_date,
 0 as years_of_work
from customer""", ()),
    "companies": ("""
select n_nationkey as id, concat('C', cast(n_nationkey as varchar(10))) as code, n_name as name, cast(null as varchar(255)) as image from nation""", ()),
    "user_companies": ("""
select c_custkey as user_id, c_nationkey as company_id from customer where c_custkey % 4 <> 0
union
select c_custkey as user_id, (c_nationkey + 7) % 25 as company_id from customer where c_custkey % 3 = 0""", ()),
    "user_time_attendance": ("""
select c_custkey as user_id, 100 as score_max, cast(100 - c_custkey % 40 as int) as score_obtained, cast(c_custkey % 40 as int) as penalty_total
from customer where c_custkey % 6 <> 0""", ()),
    "user_time_attendance_items": ("""
select c_custkey as user_id, t.name, cast((c_custkey + t.k) % 9 as varchar(32)) as value
from customer cross join (values (1, 'late'), (2, 'absent'), (3, 'sick_leave')) t(k, name)
where c_custkey % 6 <> 0 and (c_custkey + t.k) % 4 <> 0""", ()),
    "eval_form": ("""
select p_partkey as id, concat('F', cast(p_partkey as varchar(10))) as code, p_name as title_th,
 case when p_partkey % 4 = 0 then null else p_type end as title_en,
 case p_partkey % 3 when 0 then 60 when 1 then 40 else 20 end as kpi_weight,
 case p_partkey % 3 when 0 then 20 when 1 then 40 else 60 end as comp_weight, 20 as ta_weight,
 case when p_partkey % 9 = 0 then 0 else 100 end as total_weight, 1 as calc_method, 1 as score_scheme,
 date '2024-01-01' + cast(p_partkey % 365 as int) as eval_start,
 case when p_partkey % 2 = 1 then null else date '2024-01-31' + cast(p_partkey % 365 as int) end as eval_end
from part""", ()),
    "eval_assignment": ("""
select o_orderkey as id, cast(row_number() over (partition by o_custkey order by o_orderkey) - 1 as bigint) as form_id, o_custkey as user_id,
 case o_orderstatus when 'P' then 1 when 'F' then 2 else 0 end as status, cast(o_orderdate as date) as due_date
from orders""", ()),
    "eval_kpi_user": ("""
select l_orderkey * 100 + rn as id, l_orderkey as assignment_id, rn as idx, concat('KPI ', cast(l_linenumber as varchar(10))) as title,
 cast(case when l_quantity >= 50 then 0 else 5 end as decimal(6,2)) as max_score, cast(round(l_discount * 100) as int) as weight,
 cast(3 as decimal(6,2)) as expected_score, cast(l_quantity / 10 as decimal(6,2)) as score,
 case when l_returnflag = 'N' then null else l_returnflag end as code
from (select l.*, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate, l_tax) as rn from lineitem l) x""", ()),
    "eval_competency": ("""
select p_partkey * 10 + t.k as id, p_partkey as form_id, t.k as idx, concat('Competency ', cast(t.k as varchar(10))) as title,
 cast(case when t.k = 4 and p_partkey % 5 = 0 then 0 else 5 end as decimal(10,2)) as max_score,
 cast(case when p_partkey % 7 = 6 then 1 when p_partkey % 2 = 0 then 0.25 else 25 end as decimal(18,4)) as weight,
 cast(100 as decimal(18,2)) as full_total, cast(3 as decimal(10,2)) as expected_score
from part cross join (values (1), (2), (3), (4)) t(k)""", ()),
    "eval_competency_score": ("""
select a.id * 10 + t.k as id, a.id as assignment_id, a.form_id * 10 + t.k as comp_id,
 cast(((a.id * 3 + t.k * 7) % 51) / 10.0 as decimal(6,2)) as score, case when a.id % 2 = 0 then null else 'note' end as note
from eval_assignment a cross join (values (1), (2), (3), (4)) t(k)
where (a.id + t.k) % 5 <> 0 and a.id % 17 <> 0""", ("eval_assignment",)),
    "eval_ta_score": ("""
select o_orderkey as assignment_id, cast(case when o_orderkey % 13 = 0 then 0 else 100 end as decimal(6,2)) as full_score,
 cast((o_orderkey * 7) % 101 as decimal(6,2)) as score
from orders where o_orderkey % 11 <> 0""", ()),
    "eval_dev_plan": ("""
select o_orderkey * 10 + t.k as id, o_orderkey as assignment_id, t.k as idx, concat('plan ', o_orderpriority) as content,
 case o_orderkey % 3 when 0 then 'High' when 1 then 'Medium' else 'Low' end as priority,
 case when o_orderkey % 4 = 0 then null else cast(o_orderdate as date) + t.k end as timing
from orders cross join (values (1), (2)) t(k) where (o_orderkey + t.k) % 3 <> 0""", ()),
    "eval_additional": ("""
select o_orderkey as assignment_id, o_orderpriority as q1, cast(null as varchar(10)) as q2, '' as q3, o_orderstatus as q4, 'ok' as q5
from orders where o_orderkey % 4 <> 0""", ()),
    "eval_grade_band": ("""
select id, form_id, grade, cast(lo as decimal(5,2)) as min_pct, cast(hi as decimal(5,2)) as max_pct from (values
 (1, null, 'A+', 90.00, 100.00), (2, null, 'A', 80.00, 100.00), (3, null, 'B', 70.00, 79.99), (4, null, 'C', 60.00, 69.99),
 (5, null, 'D', 50.00, 59.99), (6, null, 'F', 10.00, 49.99), (7, 0, 'P', 50.00, 100.00), (8, 1, 'S', 55.00, 100.00)) t(id, form_id, grade, lo, hi)""", ()),
    "eval_step": ("""
select o_orderkey * 10 + t.i as id, o_orderkey as assignment_id, t.i as idx, (o_custkey + t.i - 1) % 150 as evaluator_id,
 case o_orderkey % 8 when 0 then case when t.i = 1 then 1 else 0 end when 2 then case when t.i = 1 then 2 when t.i = 2 then 1 else 0 end
  when 4 then case when t.i < 3 then 2 else 1 end else 0 end as status
from orders cross join (values (1), (2), (3)) t(i) where o_orderkey % 2 = 0""", ()),
    "save_log": ("""
select event_id as seq, ts, user_id, (event_id % 3) * 12 as form_id,
 case event_type when 'purchase' then 2 when 'click' then 1 when 'signup' then 3 else 0 end as status,
 case when event_id % 4 = 0 then concat('2024-02-', lpad(cast(1 + event_id % 28 as varchar(10)), 2, '0')) else '' end as due_date,
 concat('{"status":', cast(case event_type when 'purchase' then 2 when 'click' then 1 when 'signup' then 3 else 0 end as varchar(10)),
  ',"kpis":[{"idx":1,"code":"","title":"K1","max_score":5.0,"weight":', case when event_id % 31 = 0 then '150' else '60' end,
  ',"score":', cast(event_id % 6 as varchar(10)), '.0},{"idx":2,"title":"K2","max_score":5.0,"weight":40,"score":3.5}],"competency_scores":[{"comp_id":',
  case when event_id % 29 = 0 then '99999999' else cast((event_id % 3) * 120 + 1 as varchar(10)) end, ',"score":4.0},{"comp_id":',
  cast((event_id % 3) * 120 + case when event_id % 37 = 0 then 1 else 2 end as varchar(10)),
  ',"score":2.5}],"time_attendance":{"full_score":100.0,"score":', cast(event_id % 101 as varchar(10)),
  '.0},"development_plan":[', case when event_id % 3 = 0 then
   concat('{"idx":1,"content":"grow","priority":"High","timing":"2024-05-0', cast(1 + event_id % 9 as varchar(10)), '","remarks":""},{"idx":2,"content":"rest","timing":"","remarks":"r"}') else '' end,
  '],"additional":{"q1":"a","q2":"","q3":"","q4":"","q5":""}}') as doc
from events""", ()),
    "step_changes": ("""
select s.id as step_id, s.id as seq, case when s.assignment_id % 3 = 0 then 0 else 2 end as status,
 case when s.assignment_id % 3 = 0 then '' else '2024-03-01' end as eval_date
from eval_step s where s.status = 1""", ("eval_step",)),
    "login_requests": ("""
select event_id as req_id, concat('P', lpad(cast(user_id * 11 as varchar(10)), 6, '0')) as person_code
from events""", ()),
    "attendance_log": ("""
select event_id as seq, user_id * 7 as user_id, concat('{"time_attendance":[',
  case when event_id % 5 = 0 then '' else concat('{"name":"late","value":"', cast(event_id % 7 as varchar(10)),
  '"},{"name":"absent","value":"', cast(event_id % 3 as varchar(10)), '"}') end,
  '],"score_max":100,"score_obtained":', cast(100 - event_id % 30 as varchar(10)),
  ',"penalty_total":', cast(event_id % 30 as varchar(10)), '}') as doc
from events where event_type in ('view', 'error')""", ()),
    "kpi_bulk_log": ("""
select event_id as seq, user_id, (event_id % 3) * 12 as form_id,
 concat('{"items":[', case when event_id % 9 = 0 then '' else concat(
   '{"idx":', cast(1 + event_id % 4 as varchar(10)), ',"code":"', case when event_id % 2 = 0 then '' else 'B' end,
   '","title":"Bulk ', cast(event_id as varchar(10)), '","max_score":5.0,"weight":', cast(10 + event_id % 50 as varchar(10)),
   ',"expected_score":3.0,"score":', cast(event_id % 5 as varchar(10)), '.5,"note":"","measure":"count","criteria":"","unit":"pt"}') end,
 '],"due_date":"', case when event_id % 6 = 0 then '2024-03-15' else '' end, '"}') as doc
from events where event_type = 'click'""", ()),
    "comp_bulk_log": ("""
select p_partkey as seq, p_partkey as form_id, concat('{"items":[', case when p_partkey % 20 = 0 then '' else
  concat('{"idx":5,"title":"Extra ', cast(p_partkey as varchar(10)), '","max_score":5.0,"weight":',
  case when p_partkey % 3 = 0 then '0.1' else '10' end,
  ',"full_total":100.0,"expected_score":3.0},{"idx":6,"title":"Extra B","max_score":4.0,"weight":0.2,"full_total":100.0,"expected_score":2.0}') end,
  ']}') as doc
from part where p_partkey % 10 = 0""", ()),
    "step_requests": ("""
select a.id as seq, a.form_id, a.user_id, concat('{"evaluators":[', case when a.id % 27 = 3 then '' else
  concat(cast((a.user_id + 1) % 1000 as varchar(10)), ',', cast((a.user_id * 7 + 3) % 2000 as varchar(10))) end, ']}') as doc
from eval_assignment a where a.id % 6 = 3""", ("eval_assignment",)),
    "kpi_changes": ("""
select k.id as seq, k.id as kpi_id, a.form_id, case when k.id % 5 = 0 then a.user_id + 1 else a.user_id end as user_id,
 k.idx + 10 as idx, case when k.id % 2 = 0 then '' else 'U' end as code, 'Updated' as title, cast(5 as double) as max_score,
 50 as weight, cast(3 as double) as expected_score, cast(k.id % 6 as double) as score, '' as note, 'm2' as measure,
 '' as criteria, '' as unit
from eval_kpi_user k join eval_assignment a on a.id = k.assignment_id where k.id % 7 = 0""", ("eval_kpi_user", "eval_assignment")),
    "kpi_deletes": ("""
select k.id as seq, k.id as kpi_id, a.form_id, case when k.id % 4 = 0 then a.user_id + 1 else a.user_id end as user_id
from eval_kpi_user k join eval_assignment a on a.id = k.assignment_id where k.id % 11 = 0""", ("eval_kpi_user", "eval_assignment")),
    "user_patches": ("""
select c_custkey as seq, c_custkey as user_id, concat('{',
  case when c_custkey % 3 = 0 then concat('"name":"', c_name, ' II",') else '' end,
  case when c_custkey % 4 = 0 then '"role":"",' else '' end,
  case when c_custkey % 5 = 0 then '"department":"HR",' else '' end,
  case when c_custkey % 6 = 0 then '"start_date":"2015-06-01",' else '' end,
  case when c_custkey % 7 = 0 then '"company_ids":[]'
       when c_custkey % 8 = 0 then concat('"company_ids":["', cast(c_nationkey as varchar(10)), '","3","99"]')
       else '"position":"staff"' end,
  case when c_custkey % 44 = 4 then ',"confirm_date":"2015-02-30"}' when c_custkey % 46 = 6 then '' else '}' end) as doc
from customer where c_custkey % 2 = 0""", ()),
    "user_creates": ("""
select s_suppkey as seq, concat('{"name":"New ', s_name, '","email":"',
  case when s_suppkey % 10 = 0 then 'dup@example.com' else concat('new', cast(s_suppkey as varchar(10)), '@example.com') end,
  '","role":"user","password":"x","personcode":"N', cast(s_suppkey - case when s_suppkey % 10 = 1 then 1 else 0 end as varchar(10)), '","position":"","department":"Ops",',
  '"urlimage":"","start_date":"2023-', case when s_suppkey % 15 = 7 then '13' else '01' end, '-0', cast(1 + s_suppkey % 9 as varchar(10)), '","confirm_date":"",',
  '"company_ids":["', cast(s_nationkey as varchar(10)), '","', cast(s_nationkey as varchar(10)), '","77"]', case when s_suppkey % 17 = 3 then '' else '}' end) as doc
from supplier""", ()),
    "save_bodies": ("""
select seq, case seq % 20 when 1 then '{broken' when 2 then replace(doc, '"weight":40', '"weight":"abc"')
  when 3 then replace(doc, '"title":"K1"', '"title":5') when 4 then null when 5 then '[1]' when 6 then concat(doc, 'x')
  when 7 then 'null' when 8 then replace(doc, '"status":', '"title":5,"x":{"note":5,"weight":"w"},"q1":7,"status":')
  when 9 then replace(replace(doc, '"status":', '"STATUS":'), '"kpis":', '"Kpis":') when 10 then replace(doc, '"title":"K1"', '"TITLE":5')
  when 11 then replace(doc, '"weight":40', '"weight":40.5') when 12 then replace(doc, '"weight":40', '"weight":5000000000')
  when 13 then replace(doc, '"weight":40', '"weight":99999999999999999999') when 14 then replace(doc, '"additional":{', '"additional":[],"y":{')
  when 15 then replace(doc, '"score":3.5', '"score":"3.5"') when 16 then replace(doc, '"status":', '"status":null,"status":')
  when 17 then replace(doc, '"kpis":[', '"kpis":[null,') when 18 then concat(doc, '}') when 19 then '' else doc end as doc
from save_log""", ("save_log",)),
    "odd_save_log": ("""
select seq, ts, user_id, form_id, status, due_date, case when seq % 41 = 7 then replace(doc, '"status":', '"STATUS":')
  when seq % 43 = 5 then replace(replace(doc, '"kpis":', '"Kpis":'), '"weight":', '"Weight":') when seq % 47 = 3 then concat(doc, 'x')
  when seq % 53 = 2 then replace(doc, '"weight":40', '"weight":5000000000') when seq % 59 = 1 then replace(doc, '"status":', '"title":5,"x":{"note":5,"q1":[1]},"status":')
  when seq % 61 = 4 then replace(doc, '"status":', '"status":2,"status":') when seq % 67 = 6 then 'null'
  when seq % 71 = 8 then replace(doc, '"title":"K1"', '"title":5') when seq % 73 = 9 then null else doc end as doc
from save_log""", ("save_log",)),
    "key_users": ("""
select id, case when id % 50 = 0 then concat('P', lpad(cast(id + 1 as varchar(10)), 6, '0')) else person_code end as person_code, name,
 case when id % 70 = 1 then 'same@example.com' else email end as email, role, department, start_date, confirm_date, years_of_work
from users""", ("users",)),
    "key_links": ("""
select user_id, company_id from user_companies union all select user_id, company_id from user_companies where user_id % 40 = 3""", ("user_companies",)),
    "key_patches": ("""
select c_custkey * 10 + t.k as seq, c_custkey as user_id, case t.k
  when 1 then case when c_custkey % 9 = 0 then '{"email":"same@example.com"}' when c_custkey % 9 = 1 then concat('{"name":"moved","email":"free', cast(c_custkey as varchar(10)), '@example.com"}') else '{"position":"p"}' end
  when 2 then case when c_custkey % 9 = 2 then concat('{"email":"', lower(replace(c_name, lpad(cast(c_custkey as varchar(10)), 9, '0'), lpad(cast(c_custkey - 1 as varchar(10)), 9, '0'))), '@example.com"}')
    when c_custkey % 9 = 0 then concat('{"name":"left","email":"left', cast(c_custkey as varchar(10)), '@example.com"}') else '{}' end
  else case when c_custkey % 9 = 5 then concat('{"personcode":"P', lpad(cast(c_custkey + 9 as varchar(10)), 6, '0'), '","email":"five', cast(c_custkey % 7 as varchar(10)), '@example.com"}')
    when c_custkey % 9 = 6 then '{"personcode":"swap"}' else '{"role":"r"}' end end as doc
from customer cross join (values (1), (2), (3)) t(k) where c_custkey % 9 in (0, 1, 2, 5, 6)""", ()),
    "user_deletes": ("""
select c_custkey as user_id from customer where c_custkey % 13 = 0""", ()),
    "form_requests": ("""
select s_suppkey as seq, case when s_suppkey % 7 = 0 then concat('F', cast(s_suppkey as varchar(10)))
   else concat('NF', cast(s_suppkey as varchar(10))) end as code, s_name as title_th,
 case when s_suppkey % 2 = 0 then '' else 'Form EN' end as title_en,
 cast((s_suppkey % 3) * 20 as int) as kpi_weight, 40 as comp_weight, 20 as ta_weight,
 case when s_suppkey % 4 = 0 then 0 else 100 end as total_weight, 1 as calc_method, 1 as score_scheme,
 case when s_suppkey % 5 = 0 then '' else '2024-04-01' end as eval_start, '' as eval_end,
 case when s_suppkey % 3 = 0 then '' else 'remark' end as remark
from supplier""", ()),
    "step_replay_log": ("""
select s.id as step_id, s.id as seq, case when s.assignment_id % 5 = 0 then 0 else 2 end as status,
 case when s.id % 4 = 0 then '' else '2024-03-02' end as eval_date
from eval_step s where s.status <> 2""", ("eval_step",)),
}


def _closure(names) -> list[str]:
    """Views needed for ``names`` in dependency order."""
    out: list[str] = []

    def visit(n: str) -> None:
        if n in out:
            return
        for dep in VIEWS[n][1]:
            visit(dep)
        out.append(n)

    for n in names:
        visit(n)
    return out


def with_clause(*names: str) -> str:
    """``WITH`` prefix defining ``names`` (and their deps) as CTEs, for DuckDB oracles."""
    parts = [f"{n} AS ({VIEWS[n][0]}\n)" for n in _closure(names)]
    return "WITH " + ",\n".join(parts) + "\n"


def register_raw(spark: SparkSession, sf_dir: str) -> None:
    for t in RAW_TABLES:
        spark.read.parquet(os.path.join(sf_dir, f"{t}.parquet")).createOrReplaceTempView(t)


def fixture_tables(spark: SparkSession, sf_dir: str, names=None) -> dict[str, DataFrame]:
    """Register the raw tables and return fixture views as DataFrames.

    Views are defined lazily; nothing is read until an action runs.
    """
    register_raw(spark, sf_dir)
    out: dict[str, DataFrame] = {}
    for n in _closure(names or list(VIEWS)):
        df = spark.sql(VIEWS[n][0])
        df.createOrReplaceTempView(n)
        out[n] = df
    return out


# Columns each fixture view provides (checked against Spark in the tests);
# lets oracle SQL be written for exactly the columns the views carry.
FIXTURE_COLUMNS: dict[str, tuple[str, ...]] = {
    "users": ("id", "person_code", "name", "email", "role", "department", "start_date", "confirm_date",
              "years_of_work"),
    "companies": ("id", "code", "name", "image"),
    "user_companies": ("user_id", "company_id"),
    "user_time_attendance": ("user_id", "score_max", "score_obtained", "penalty_total"),
    "user_time_attendance_items": ("user_id", "name", "value"),
    "eval_form": ("id", "code", "title_th", "title_en", "kpi_weight", "comp_weight", "ta_weight", "total_weight",
                  "calc_method", "score_scheme", "eval_start", "eval_end"),
    "eval_assignment": ("id", "form_id", "user_id", "status", "due_date"),
    "eval_kpi_user": ("id", "assignment_id", "idx", "title", "max_score", "weight", "expected_score", "score",
                      "code"),
    "eval_competency": ("id", "form_id", "idx", "title", "max_score", "weight", "full_total", "expected_score"),
    "eval_competency_score": ("id", "assignment_id", "comp_id", "score", "note"),
    "eval_ta_score": ("assignment_id", "full_score", "score"),
    "eval_dev_plan": ("id", "assignment_id", "idx", "content", "priority", "timing"),
    "eval_additional": ("assignment_id", "q1", "q2", "q3", "q4", "q5"),
    "eval_grade_band": ("id", "form_id", "grade", "min_pct", "max_pct"),
    "eval_step": ("id", "assignment_id", "idx", "evaluator_id", "status"),
}
