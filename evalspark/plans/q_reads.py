"""Registered queries: scans, lookups, joins, paging, profiles, scalar rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import AS_OF_DATE, fixture_tables
from ..functions import scalars as sc
from ..operators import documents, relational
from ..sources.tables import by_keys, conform
from .registry import query
from .sqlparts import oracle

_FORM_SQL_COLS = (
    "id, code, title_th, title_en, kpi_weight, comp_weight, ta_weight, total_weight, calc_method, score_scheme, "
    "cast(null as varchar) as kpi_cfg_start, cast(null as varchar) as kpi_cfg_end, "
    "strftime(eval_start, '%Y-%m-%d') as eval_start, strftime(eval_end, '%Y-%m-%d') as eval_end, "
    "cast(null as varchar) as other_lv_start, cast(null as varchar) as other_lv_end, "
    "cast(null as varchar) as annual_lv_start, cast(null as varchar) as annual_lv_end, cast(null as varchar) as remark")


@query("scan_forms", oracle(("eval_form",), "", f"select {_FORM_SQL_COLS} from eval_form"))
def q_scan_forms(spark, sf_dir):
    """S1 + F5: every form in its declared schema, dates as text."""
    return relational.form_listing(fixture_tables(spark, sf_dir, ["eval_form"])["eval_form"])


@query("forms_page", oracle(("eval_form",), "",
                            f"select {_FORM_SQL_COLS} from eval_form order by id desc limit 20 offset 40"))
def q_forms_page(spark, sf_dir):
    """L1: page of forms, newest id first (limit 20, offset 40)."""
    f = relational.form_listing(fixture_tables(spark, sf_dir, ["eval_form"])["eval_form"])
    return relational.page(f, 20, 40)


_USERS_PAGE_SQL = """
pg AS (select * from users order by id desc limit 50 offset 10),
links AS (select uc.user_id, count(*) as companies, string_agg(c.code, ',' order by c.id) as company_codes
          from user_companies uc join companies c on c.id = uc.company_id group by uc.user_id),"""


@query("users_page", oracle(("users", "user_companies", "companies"), _USERS_PAGE_SQL,
                            "select p.id, p.name, p.email, p.role, p.person_code, p.department,"
                            " strftime(p.start_date, '%Y-%m-%d') as start_date,"
                            " strftime(p.confirm_date, '%Y-%m-%d') as confirm_date, p.years_of_work,"
                            " coalesce(l.companies, 0) as companies, coalesce(l.company_codes, '') as company_codes"
                            " from pg p left join links l on l.user_id = p.id"))
def q_users_page(spark, sf_dir):
    """L1 + J9: users page (limit 0 -> default 50, offset 10), then its companies.

    The page is cut first (top-k), so the company join only touches 50 users.
    """
    t = fixture_tables(spark, sf_dir, ["users", "user_companies", "companies"])
    pg = relational.page(conform(t["users"], "users"), 0, 10)
    prof = documents.user_profiles(pg, t["user_companies"], t["companies"])
    return documents.flatten_profiles(prof)


@query("users_by_keys", oracle(("users", "eval_step"), "",
                               "select id, name, email, person_code from users"
                               " where id in (select evaluator_id from eval_step)"))
def q_users_by_keys(spark, sf_dir):
    """Users looked up by id - every user that evaluates some step."""
    t = fixture_tables(spark, sf_dir, ["users", "eval_step"])
    keys = t["eval_step"].select(F.col("evaluator_id").alias("id"))
    return by_keys(t["users"], keys, "id").select("id", "name", "email", "person_code")


_LOGIN_SQL = """
login AS (
  select r.req_id, u.id, u.name, u.person_code, u.confirm_date, u.start_date
  from login_requests r join users u on u.person_code = r.person_code),
base AS (select *, coalesce(confirm_date, start_date) as b, date '""" + AS_OF_DATE + """' as n from login),"""


@query("users_by_code", oracle(("users", "login_requests"), _LOGIN_SQL,
                               "select req_id, id, name, person_code, cast(case when b is null then 0 else greatest(0,"
                               " year(n) - year(b) - case when (month(n), day(n)) < ("
                               "   case when month(b) = 2 and day(b) = 29 and day(last_day(make_date(year(n), 2, 1))) = 28"
                               "        then 3 else month(b) end,"
                               "   case when month(b) = 2 and day(b) = 29 and day(last_day(make_date(year(n), 2, 1))) = 28"
                               "        then 1 else day(b) end) then 1 else 0 end) end as int) as years_of_work"
                               " from base"))
def q_users_by_code(spark, sf_dir):
    """S3 + F11: login lookups by person_code, with years of work at the as-of date."""
    t = fixture_tables(spark, sf_dir, ["users", "login_requests"])
    u = t["users"]
    hit = t["login_requests"].join(u, "person_code")
    return hit.select("req_id", "id", "name", "person_code",
                      sc.years_of_work("confirm_date", "start_date", F.lit(AS_OF_DATE)).alias("years_of_work"))


@query("assignments_by_pair", oracle(("eval_assignment", "save_log"), "",
                                     "select id, form_id, user_id, status, strftime(due_date, '%Y-%m-%d') as due_date"
                                     " from eval_assignment a where exists (select 1 from save_log s"
                                     " where s.form_id = a.form_id and s.user_id = a.user_id)"))
def q_assignments_by_pair(spark, sf_dir):
    """Assignments looked up by (form_id, user_id) pairs named in the save log."""
    t = fixture_tables(spark, sf_dir, ["eval_assignment", "save_log"])
    a = by_keys(t["eval_assignment"], t["save_log"], ["form_id", "user_id"])
    return a.select("id", "form_id", "user_id", "status", sc.iso_date("due_date").alias("due_date"))


@query("user_companies_flat", oracle(("user_companies", "companies"), "",
                                     "select uc.user_id, uc.company_id, c.code, c.name, c.image"
                                     " from user_companies uc join companies c on c.id = uc.company_id"))
def q_user_companies_flat(spark, sf_dir):
    """User -> company bridge join."""
    t = fixture_tables(spark, sf_dir, ["user_companies", "companies"])
    return relational.user_companies_flat(t["user_companies"], t["companies"])


@query("kpi_listing", oracle(("eval_kpi_user", "eval_assignment"), "",
                             "select k.id, k.assignment_id, a.form_id, a.user_id, k.idx, coalesce(k.code, '') as code,"
                             " k.title, cast(k.max_score as double) as max_score, k.weight,"
                             " cast(k.expected_score as double) as expected_score, cast(k.score as double) as score,"
                             " '' as note, '' as measure, '' as criteria, '' as unit"
                             " from eval_kpi_user k join eval_assignment a on a.id = k.assignment_id"))
def q_kpi_listing(spark, sf_dir):
    """KPI rows joined to their assignment (form_id, user_id)."""
    t = fixture_tables(spark, sf_dir, ["eval_kpi_user", "eval_assignment"])
    return relational.kpi_listing(t["eval_kpi_user"], t["eval_assignment"])


@query("competencies_with_scores", oracle(("eval_assignment", "eval_competency", "eval_competency_score"), "",
                                          "select a.id as assignment_id, c.id as comp_id, c.idx, c.title,"
                                          " cast(c.max_score as double) as max_score, cast(c.weight as double) as weight,"
                                          " cast(c.full_total as double) as full_total,"
                                          " cast(c.expected_score as double) as expected_score,"
                                          " coalesce(cast(cs.score as double), 0.0) as score, coalesce(cs.note, '') as note"
                                          " from eval_assignment a join eval_competency c on c.form_id = a.form_id"
                                          " left join eval_competency_score cs on cs.comp_id = c.id"
                                          " and cs.assignment_id = a.id"))
def q_competencies_with_scores(spark, sf_dir):
    """Each assignment's form competencies LEFT JOIN its scores."""
    t = fixture_tables(spark, sf_dir, ["eval_assignment", "eval_competency", "eval_competency_score"])
    return relational.competencies_with_scores(t["eval_assignment"], t["eval_competency"],
                                               t["eval_competency_score"])


_STEP_LIST_SQL = ("select s.id, s.assignment_id, a.form_id, a.user_id, s.idx, s.evaluator_id, u.name as evaluator_name,"
                  " s.status, cast(null as varchar) as eval_date"
                  " from eval_step s join eval_assignment a on a.id = s.assignment_id"
                  " join users u on u.id = s.evaluator_id")


@query("step_listing", oracle(("eval_step", "eval_assignment", "users"), "", _STEP_LIST_SQL))
def q_step_listing(spark, sf_dir):
    """Steps with assignment keys and evaluator name."""
    t = fixture_tables(spark, sf_dir, ["eval_step", "eval_assignment", "users"])
    return relational.list_steps(t["eval_step"], t["eval_assignment"], t["users"])


@query("steps_public", oracle(("eval_step", "eval_assignment", "users"), f"sl AS ({_STEP_LIST_SQL}),",
                              "select form_id, user_id, id, evaluator_name, status, eval_date from sl"))
def q_steps_public(spark, sf_dir):
    """P5: step listing narrowed to the public fields."""
    t = fixture_tables(spark, sf_dir, ["eval_step", "eval_assignment", "users"])
    return relational.steps_public(relational.list_steps(t["eval_step"], t["eval_assignment"], t["users"]))


@query("comps_by_form", oracle(("eval_competency",), "",
                               "select id, form_id, idx, title, cast(max_score as double) as max_score,"
                               " cast(weight as double) as weight, cast(full_total as double) as full_total,"
                               " cast(expected_score as double) as expected_score from eval_competency"))
def q_comps_by_form(spark, sf_dir):
    """D5 + P2: competency list of every form."""
    return relational.comps_by_form(fixture_tables(spark, sf_dir, ["eval_competency"])["eval_competency"])


_PROFILE_SQL = """
links AS (select uc.user_id, count(*) as companies, string_agg(c.code, ',' order by c.id) as company_codes
          from user_companies uc join companies c on c.id = uc.company_id group by uc.user_id),
base AS (select u.*, coalesce(u.confirm_date, u.start_date) as b, date '""" + AS_OF_DATE + """' as n from users u),"""


@query("user_profiles", oracle(("users", "user_companies", "companies"), _PROFILE_SQL,
                               "select u.id, u.name, u.email, u.role, u.person_code, u.department,"
                               " strftime(u.start_date, '%Y-%m-%d') as start_date,"
                               " strftime(u.confirm_date, '%Y-%m-%d') as confirm_date,"
                               " cast(case when b is null then 0 else greatest(0,"
                               " year(n) - year(b) - case when (month(n), day(n)) < ("
                               "   case when month(b) = 2 and day(b) = 29 and day(last_day(make_date(year(n), 2, 1))) = 28"
                               "        then 3 else month(b) end,"
                               "   case when month(b) = 2 and day(b) = 29 and day(last_day(make_date(year(n), 2, 1))) = 28"
                               "        then 1 else day(b) end) then 1 else 0 end) end as int) as years_of_work,"
                               " coalesce(l.companies, 0) as companies, coalesce(l.company_codes, '') as company_codes"
                               " from base u left join links l on l.user_id = u.id"))
def q_user_profiles(spark, sf_dir):
    """D1 + J9 + F11: every user with companies (flattened) and years of work at login."""
    t = fixture_tables(spark, sf_dir, ["users", "user_companies", "companies"])
    prof = documents.user_profiles(t["users"], t["user_companies"], t["companies"], as_of=AS_OF_DATE)
    return documents.flatten_profiles(prof)


@query("years_of_work", oracle(("users",), "base AS (select id, confirm_date, start_date,"
                               " coalesce(confirm_date, start_date) as b, date '" + AS_OF_DATE + "' as n from users),",
                               "select id, cast(case when b is null then 0 else greatest(0,"
                               " year(n) - year(b) - case when (month(n), day(n)) < ("
                               "   case when month(b) = 2 and day(b) = 29 and day(last_day(make_date(year(n), 2, 1))) = 28"
                               "        then 3 else month(b) end,"
                               "   case when month(b) = 2 and day(b) = 29 and day(last_day(make_date(year(n), 2, 1))) = 28"
                               "        then 1 else day(b) end) then 1 else 0 end) end as int) as years_of_work"
                               " from base"))
def q_years_of_work(spark, sf_dir):
    """years of work for every user at the as-of date."""
    u = fixture_tables(spark, sf_dir, ["users"])["users"]
    return u.select("id", sc.years_of_work("confirm_date", "start_date", F.lit(AS_OF_DATE)).alias("years_of_work"))


@query("attendance_sizes", oracle(("users", "user_time_attendance", "user_time_attendance_items"),
                                  "it AS (select user_id, count(*) as items,"
                                  " string_agg(name || '=' || value, ';' order by name) as item_text"
                                  " from user_time_attendance_items group by user_id),",
                                  "select u.id as user_id, coalesce(s.score_max, 0) as score_max,"
                                  " coalesce(s.score_obtained, 0) as score_obtained,"
                                  " coalesce(s.penalty_total, 0) as penalty_total, coalesce(it.items, 0) as items,"
                                  " coalesce(it.item_text, '') as item_text from users u"
                                  " left join user_time_attendance s on s.user_id = u.id"
                                  " left join it on it.user_id = s.user_id"))
def q_attendance_sizes(spark, sf_dir):
    """D3: attendance payload per user, flattened (item count, items in name order)."""
    t = fixture_tables(spark, sf_dir, ["users", "user_time_attendance", "user_time_attendance_items"])
    docs = documents.attendance_documents(t["users"], t["user_time_attendance"], t["user_time_attendance_items"])
    return documents.attendance_sizes(docs)


@query("forms_with_defaults", oracle(("eval_form",), "",
                                     "select id, coalesce(kpi_weight, 0) as kpi_weight,"
                                     " coalesce(comp_weight, 0) as comp_weight, coalesce(ta_weight, 0) as ta_weight,"
                                     " case when coalesce(total_weight, 100) = 0 then 100"
                                     " else coalesce(total_weight, 100) end as total_weight,"
                                     " coalesce(calc_method, 1) as calc_method, coalesce(score_scheme, 1) as score_scheme"
                                     " from eval_form"))
def q_forms_with_defaults(spark, sf_dir):
    """DDL column defaults and total_weight 0 -> 100."""
    f = fixture_tables(spark, sf_dir, ["eval_form"])["eval_form"]
    d = relational.apply_defaults(f, "eval_form")
    return d.select("id", "kpi_weight", "comp_weight", "ta_weight", "total_weight", "calc_method", "score_scheme")


@query("status_normalized", oracle(("save_log",), "",
                                   "select seq, status as requested_status,"
                                   " cast(case when status between 0 and 2 then status else 0 end as int) as status"
                                   " from save_log"))
def q_status_normalized(spark, sf_dir):
    """Requested save status and the stored (normalised) status."""
    s = fixture_tables(spark, sf_dir, ["save_log"])["save_log"]
    return s.select("seq", F.col("status").alias("requested_status"),
                    sc.normalize_status("status").alias("status"))


@query("scalar_conversions", oracle(("save_log",), "",
                                    "select seq,"
                                    " nullif(due_date, '') as due_text,"
                                    " coalesce(nullif(due_date, ''), '-') as due_or_dash,"
                                    " coalesce(trim(due_date) = '', true) as due_blank,"
                                    " strftime(try_cast(nullif(trim(due_date), '') as date), '%Y-%m-%d') as due_parsed,"
                                    " strftime(cast(ts + interval 7 hour as date), '%Y-%m-%d')"
                                    "   as bangkok_date,"
                                    " coalesce(case when regexp_full_match(right(due_date, 2), '[+-]?[0-9]+')"
                                    "   then try_cast(right(due_date, 2) as int) end, 0) as due_day"
                                    " from save_log"))
def q_scalar_conversions(spark, sf_dir):
    """F1, F2, F5, F6, F9, F10, F14 over the save log columns."""
    s = fixture_tables(spark, sf_dir, ["save_log"])["save_log"]
    return s.select(
        "seq",
        sc.blank_to_null("due_date").alias("due_text"),
        sc.null_to(sc.blank_to_null("due_date"), "-").alias("due_or_dash"),
        sc.is_blank("due_date").alias("due_blank"),
        sc.iso_date(sc.try_date("due_date")).alias("due_parsed"),
        sc.iso_date(sc.local_date(F.col("ts"))).alias("bangkok_date"),
        sc.int_or_zero(F.right("due_date", F.lit(2))).alias("due_day"),
    )
