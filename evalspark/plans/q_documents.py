"""Registered queries: JSON shredding and document assembly."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import fixture_tables
from ..operators import documents, scoring
from ..sources import documents as docs
from .registry import query
from .sqlparts import KPI_INVALID, KPI_ITEM_COLS, KPI_JSON, SAVE_EVENTS_CTE, SUMMARY_CTE, SUMMARY_VIEWS, oracle

_SAVE_VIEWS = ("save_log", "eval_assignment", "eval_competency", "eval_form", "users")


@query("shred_kpis", oracle(_SAVE_VIEWS, SAVE_EVENTS_CTE,
                            "select seq, pos, idx, code, title, max_score, weight, expected_score, score, note,"
                            " measure, criteria, unit from sv_kpis"))
def q_shred_kpis(spark, sf_dir):
    """KPI list of every save document, one row per element with its position."""
    s = fixture_tables(spark, sf_dir, ["save_log"])["save_log"]
    return docs.shred_save_documents(s)["kpis"]


@query("shred_comp_scores", oracle(_SAVE_VIEWS, SAVE_EVENTS_CTE,
                                   "select seq, pos, comp_id, score, note from sv_cs"))
def q_shred_comp_scores(spark, sf_dir):
    """Competency-score list of every save document."""
    s = fixture_tables(spark, sf_dir, ["save_log"])["save_log"]
    return docs.shred_save_documents(s)["competency_scores"]


_DOC_VIEWS = SUMMARY_VIEWS + ("eval_dev_plan", "eval_additional")


@query("shred_dev_plan", oracle(_DOC_VIEWS, "",
                                "select assignment_id, row_number() over (partition by assignment_id"
                                " order by idx, id) - 1 as pos, idx, content, priority,"
                                " coalesce(strftime(timing, '%Y-%m-%d'), '') as timing, '' as remarks"
                                " from eval_dev_plan where assignment_id in (select id from eval_assignment)"))
def q_shred_dev_plan(spark, sf_dir):
    """S8 then S5: form documents written as JSON and shredded back; the development plans.

    A round trip through ``to_json`` and ``from_json`` with the save-document
    schema; it must give back every stored plan row in (idx, id) order.
    """
    t = fixture_tables(spark, sf_dir, list(_DOC_VIEWS))
    summary = scoring.evaluation_summary(t)
    d = documents.form_documents(t, summary)
    j = documents.form_document_json(d).select("assignment_id", F.col("json").alias("doc"))
    return docs.shred_save_documents(j, ["assignment_id"])["development_plan"]


@query("shred_attendance_items", oracle(("attendance_log",), "",
                                        "select seq, user_id, pos - 1 as pos, coalesce(it.name, '') as name,"
                                        " coalesce(it.value, '') as value from (select seq, user_id, pos,"
                                        " d.time_attendance[pos] as it from (select seq, user_id, d,"
                                        " generate_subscripts(d.time_attendance, 1) as pos from ("
                                        " select seq, user_id, from_json(doc, '{\"time_attendance\":"
                                        "[{\"name\":\"VARCHAR\",\"value\":\"VARCHAR\"}]}') as d"
                                        " from attendance_log) a) b) c"))
def q_shred_attendance_items(spark, sf_dir):
    """Attendance payload items, one row per element."""
    log = fixture_tables(spark, sf_dir, ["attendance_log"])["attendance_log"]
    _, items = docs.shred_attendance(log, ["seq", "user_id"])
    return items


_BULK_SQL = """
kb_docs AS (select seq, from_json(doc, '{"items":""" + KPI_JSON + """}') as d from kpi_bulk_log),
kb_items AS (select seq, pos - 1 as pos, d.items[pos] as it
             from (select seq, d, generate_subscripts(d.items, 1) as pos from kb_docs) x),
kb_rows AS (select seq, pos, """ + KPI_ITEM_COLS + """ from kb_items),"""


@query("shred_bulk_items", oracle(("kpi_bulk_log",), _BULK_SQL,
                                  "select seq, pos, title, weight, " + KPI_INVALID + " as invalid,"
                                  " false as rejected from kb_rows"
                                  " union all select seq, cast(null as bigint), cast(null as varchar), cast(null as int),"
                                  " cast(null as boolean), true from kb_docs where coalesce(len(d.items), 0) = 0"))
def q_shred_bulk_items(spark, sf_dir):
    """Bulk KPI lists -> item rows (with table-rule check) and rejected empty requests."""
    log = fixture_tables(spark, sf_dir, ["kpi_bulk_log"])["kpi_bulk_log"]
    items, rejects = docs.shred_items(log, docs.KPI_BULK_DOC, ["seq"])
    rows = docs.kpi_rows(items, ["seq"])
    from ..operators.changes import kpi_item_valid
    valid = kpi_item_valid(F.col("code"), F.col("title"), F.col("weight"), F.col("note"), F.col("measure"),
                           F.col("criteria"), F.col("unit"))
    ok = rows.select("seq", F.col("pos").cast("long").alias("pos"), "title", "weight",
                     (~valid).alias("invalid"), F.lit(False).alias("rejected"))
    rej = rejects.select("seq", F.lit(None).cast("long").alias("pos"), F.lit(None).cast("string").alias("title"),
                         F.lit(None).cast("int").alias("weight"), F.lit(None).cast("boolean").alias("invalid"),
                         F.lit(True).alias("rejected"))
    return ok.unionByName(rej)


_SIZES_SQL = SUMMARY_CTE + """
dk AS (select assignment_id, count(*) as n from eval_kpi_user group by assignment_id),
dcomp AS (select a.id as assignment_id, count(*) as n, sum(coalesce(cast(cs.score as double), 0.0)) as s
          from eval_assignment a join eval_competency c on c.form_id = a.form_id
          left join eval_competency_score cs on cs.comp_id = c.id and cs.assignment_id = a.id group by a.id),
dd AS (select assignment_id, count(*) as n from eval_dev_plan group by assignment_id),"""


@query("form_document_sizes", oracle(_DOC_VIEWS, _SIZES_SQL,
                                     "select a.id as assignment_id, a.form_id, a.user_id, a.status,"
                                     " strftime(a.due_date, '%Y-%m-%d') as due_date, coalesce(dk.n, 0) as kpis,"
                                     " coalesce(dcomp.n, 0) as competencies,"
                                     " round(coalesce(dcomp.s, 0.0), 6) as comp_score_sum,"
                                     " coalesce(cast(ta.full_score as double), 0.0) as ta_full,"
                                     " coalesce(cast(ta.score as double), 0.0) as ta_score,"
                                     " coalesce(dd.n, 0) as plans, coalesce(x.q1, '') as q1, coalesce(x.q2, '') as q2,"
                                     " s.total_pct, s.grade"
                                     " from eval_assignment a left join dk on dk.assignment_id = a.id"
                                     " left join dcomp on dcomp.assignment_id = a.id"
                                     " left join eval_ta_score ta on ta.assignment_id = a.id"
                                     " left join dd on dd.assignment_id = a.id"
                                     " left join eval_additional x on x.assignment_id = a.id"
                                     " left join summary s on s.assignment_id = a.id"))
def q_form_document_sizes(spark, sf_dir):
    """Every assignment's full form document, reduced to list sizes and key values."""
    t = fixture_tables(spark, sf_dir, list(_DOC_VIEWS))
    d = documents.form_documents(t, scoring.evaluation_summary(t))
    return d.select(
        "assignment_id", "form_id", "user_id", "status", "due_date",
        F.size("kpis").cast("long").alias("kpis"), F.size("competencies").cast("long").alias("competencies"),
        F.round(F.aggregate("competencies", F.lit(0.0), lambda acc, x: acc + x["score"]), 6).alias("comp_score_sum"),
        F.col("time_attendance.full_score").alias("ta_full"), F.col("time_attendance.score").alias("ta_score"),
        F.size("development_plan").cast("long").alias("plans"), F.col("additional.q1").alias("q1"),
        F.col("additional.q2").alias("q2"), F.col("summary.total_pct").alias("total_pct"),
        F.col("summary.grade").alias("grade"))


# The oracle writes the same JSON text by concatenation: same field order, blank
# due_date / unit left out, numbers as shortest decimal text (as Spark writes them
# for these magnitudes).
_JSON_SQL = SUMMARY_CTE + """
dk AS (select assignment_id, string_agg('{"id":' || id || ',"assignment_id":' || assignment_id || ',"idx":' || idx
          || ',"code":' || to_json(coalesce(code, '')) || ',"title":' || to_json(title)
          || ',"max_score":' || cast(cast(max_score as double) as varchar) || ',"weight":' || weight
          || ',"expected_score":' || cast(cast(expected_score as double) as varchar)
          || ',"score":' || cast(cast(score as double) as varchar)
          || ',"note":"","measure":"","criteria":""}', ',' order by idx, id) as items
       from eval_kpi_user group by assignment_id),
dc AS (select a.id as assignment_id, string_agg('{"comp_id":' || c.id || ',"idx":' || c.idx || ',"title":' || to_json(c.title)
          || ',"max_score":' || cast(cast(c.max_score as double) as varchar)
          || ',"weight":' || cast(cast(c.weight as double) as varchar)
          || ',"full_total":' || cast(cast(c.full_total as double) as varchar)
          || ',"expected_score":' || cast(cast(c.expected_score as double) as varchar)
          || ',"score":' || cast(coalesce(cast(cs.score as double), 0.0) as varchar)
          || ',"note":' || to_json(coalesce(cs.note, '')) || '}', ',' order by c.idx, c.id) as items
       from eval_assignment a join eval_competency c on c.form_id = a.form_id
       left join eval_competency_score cs on cs.comp_id = c.id and cs.assignment_id = a.id group by a.id),
dd AS (select assignment_id, string_agg('{"idx":' || idx || ',"content":' || to_json(content)
          || ',"priority":' || to_json(priority) || ',"timing":' || to_json(coalesce(strftime(timing, '%Y-%m-%d'), ''))
          || ',"remarks":""}', ',' order by idx, id) as items
       from eval_dev_plan group by assignment_id),"""
_JSON_SELECT = """select a.id as assignment_id, a.form_id, a.user_id,
  '{"assignment_id":' || a.id || ',"status":' || a.status
  || case when a.due_date is null then '' else ',"due_date":"' || strftime(a.due_date, '%Y-%m-%d') || '"' end
  || ',"kpis":[' || coalesce(dk.items, '') || '],"competencies":[' || coalesce(dc.items, '')
  || '],"time_attendance":{"full_score":' || cast(coalesce(cast(ta.full_score as double), 0.0) as varchar)
  || ',"score":' || cast(coalesce(cast(ta.score as double), 0.0) as varchar)
  || '},"development_plan":[' || coalesce(dd.items, '') || '],"additional":{"q1":' || to_json(coalesce(x.q1, ''))
  || ',"q2":' || to_json(coalesce(x.q2, '')) || ',"q3":' || to_json(coalesce(x.q3, ''))
  || ',"q4":' || to_json(coalesce(x.q4, '')) || ',"q5":' || to_json(coalesce(x.q5, '')) || '}'
  || case when s.assignment_id is null then '' else ',"summary":{"form_id":' || s.form_id
     || ',"kpi_weight":' || s.kpi_weight || ',"kpi_pct":' || cast(s.kpi_pct as varchar)
     || ',"comp_weight":' || s.comp_weight || ',"comp_pct":' || cast(s.comp_pct as varchar)
     || ',"ta_weight":' || s.ta_weight || ',"ta_pct":' || cast(s.ta_pct as varchar)
     || ',"total_pct":' || cast(s.total_pct as varchar) || ',"grade":' || to_json(s.grade)
     || ',"grade_min":' || cast(s.grade_min as varchar) || ',"grade_max":' || cast(s.grade_max as varchar) || '}' end
  || '}' as json
from eval_assignment a left join dk on dk.assignment_id = a.id left join dc on dc.assignment_id = a.id
left join eval_ta_score ta on ta.assignment_id = a.id left join dd on dd.assignment_id = a.id
left join eval_additional x on x.assignment_id = a.id left join summary s on s.assignment_id = a.id"""


@query("form_document_json", oracle(_DOC_VIEWS, _JSON_SQL, _JSON_SELECT))
def q_form_document_json(spark, sf_dir):
    """D2 + S8: every assignment's form document as one JSON text."""
    t = fixture_tables(spark, sf_dir, list(_DOC_VIEWS))
    d = documents.form_documents(t, scoring.evaluation_summary(t))
    return documents.form_document_json(d)


# by path: every value that a document has at the place of a known field, whatever the case of its name
_BODY_TYPES = """
known AS (select * from (values ('whole', ['UBIGINT','BIGINT','NULL']), ('number', ['UBIGINT','BIGINT','DOUBLE','NULL']),
  ('text', ['VARCHAR','NULL']), ('list', ['ARRAY','NULL']), ('object', ['OBJECT','NULL'])) t(kind, types)),
fields AS (select * from (values ('$.status', 'whole'), ('$.due_date', 'text'), ('$.kpis', 'list'), ('$.kpis[]', 'object'),
  ('$.competency_scores', 'list'), ('$.competency_scores[]', 'object'), ('$.competency_scores[].comp_id', 'whole'),
  ('$.competency_scores[].score', 'number'), ('$.competency_scores[].note', 'text'), ('$.time_attendance', 'object'),
  ('$.time_attendance.full_score', 'number'), ('$.time_attendance.score', 'number'), ('$.development_plan', 'list'),
  ('$.development_plan[]', 'object'), ('$.development_plan[].idx', 'whole'), ('$.additional', 'object')) t(path, kind)
  union all select concat('$.kpis[].', unnest(['idx', 'weight'])), 'whole'
  union all select concat('$.kpis[].', unnest(['max_score', 'expected_score', 'score'])), 'number'
  union all select concat('$.kpis[].', unnest(['code', 'title', 'note', 'measure', 'criteria', 'unit'])), 'text'
  union all select concat('$.development_plan[].', unnest(['content', 'priority', 'timing', 'remarks'])), 'text'
  union all select concat('$.additional.', unnest(['q1', 'q2', 'q3', 'q4', 'q5'])), 'text'),
wrong AS (select distinct b.seq from (select seq, doc from save_bodies where json_valid(doc)) b, json_tree(b.doc) t
  join fields f on f.path = regexp_replace(lower(t.fullkey), '\\[[0-9]+\\]', '[]', 'g') join known k on k.kind = f.kind
  where not list_contains(k.types, t.type)),"""


@query("document_rejects", oracle(("save_bodies",), _BODY_TYPES,
                                  "select seq, reject from (select seq, case when doc is null then 'no body'"
                                  " when not json_valid(doc) or json_type(doc) not in ('OBJECT', 'NULL') then 'not a JSON object'"
                                  " when seq in (select seq from wrong) then 'wrong type' end as reject"
                                  " from save_bodies) x where reject is not null"))
def q_document_rejects(spark, sf_dir):
    """Save bodies that are refused before anything happens, and why."""
    bodies = fixture_tables(spark, sf_dir, ["save_bodies"])["save_bodies"]
    return docs.rejects(bodies, docs.SAVE_DOC, ["seq"])
