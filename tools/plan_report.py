"""Physical-plan report for the main operators over tables read from Parquet.

The fixture tables are written once to a scratch folder so the plans show
what a production run over stored tables does (no fixture-view subplans).
For each operator it counts shuffles (Exchange), broadcasts, join kinds and
flags nested-loop / cartesian joins and Python evaluation.

Usage: python tools/plan_report.py [sf_dir] [--formatted name]
"""

from __future__ import annotations

import os
import re
import sys
import tempfile

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import functions as F  # noqa: E402

from evalspark.fixtures import AS_OF_TS, VIEWS, fixture_tables  # noqa: E402
from evalspark.operators import (changes, documents, grading, requests, scoring,  # noqa: E402
                                 workflow)

NODES = ("Exchange hashpartitioning", "Exchange rangepartitioning", "Exchange RoundRobin", "BroadcastExchange",
         "SortMergeJoin", "BroadcastHashJoin", "ShuffledHashJoin", "BroadcastNestedLoopJoin", "CartesianProduct",
         "HashAggregate", "ObjectHashAggregate", "SortAggregate", "Window", "ArrowEvalPython", "BatchEvalPython",
         "MapInPandas", "Generate")
PYTHON = ("ArrowEvalPython", "BatchEvalPython", "MapInPandas")


def operators(t):
    return {
        "evaluation_summary (A5+G1)": lambda: scoring.evaluation_summary(t),
        "kpi_percent (A1)": lambda: scoring.kpi_percent(t["eval_kpi_user"]),
        "competencies_with_scores (J4)": lambda: __import__("evalspark.operators.relational", fromlist=["x"])
        .competencies_with_scores(t["eval_assignment"], t["eval_competency"], t["eval_competency_score"]),
        "first_active_step (G2)": lambda: grading.first_active_step(t["eval_step"]),
        "form_documents (D2)": lambda: documents.form_documents(t, scoring.evaluation_summary(t)),
        "user_profiles (D1)": lambda: documents.user_profiles(t["users"], t["user_companies"], t["companies"],
                                                              "2025-02-28"),
        "advance_steps (W3)": lambda: workflow.advance_steps(
            t["eval_step"], t["eval_assignment"].where(F.col("status") == 2)
            .select(F.col("id").alias("assignment_id")), AS_OF_TS),
        "update_steps (W4)": lambda: workflow.update_steps(t["eval_step"], t["step_changes"], t["users"]),
        "save_log_accepted (W5)": lambda: workflow.resolve_save_log(
            workflow.save_events(t["save_log"], t["eval_assignment"], t["eval_competency"])),
        "ensure_assignments (M4)": lambda: changes.ensure_assignments(t["eval_assignment"], t["save_log"], AS_OF_TS),
        "upsert_attendance (M3)": lambda: requests.attendance_requests(t, t["attendance_log"])["user_time_attendance"],
        "delete_owned_kpis (M6)": lambda: changes.delete_owned_kpis(t["eval_kpi_user"], t["eval_assignment"],
                                                                   t["kpi_deletes"])[0],
    }


def summarize(plan: str) -> dict[str, int]:
    return {n: len(re.findall(re.escape(n), plan)) for n in NODES}


def main() -> None:
    args = [a for a in sys.argv[1:] if not a.startswith("--")]
    sf_dir = args[0] if args else "/root/testdata/sf0.1"
    formatted = sys.argv[sys.argv.index("--formatted") + 1] if "--formatted" in sys.argv else None
    from evalspark.session import get_spark
    spark = get_spark("local[8]", shuffle_partitions=16)
    views = fixture_tables(spark, sf_dir, list(VIEWS))
    d = tempfile.mkdtemp(prefix="plan-report-")
    t = {}
    for n, df in views.items():
        df.write.parquet(f"{d}/{n}")
        t[n] = spark.read.parquet(f"{d}/{n}")
    shown = [n for n in NODES if n not in PYTHON]
    print("| operator | " + " | ".join(n.replace("Exchange ", "X:") for n in shown) + " | python |")
    print("|---" * (len(shown) + 2) + "|")
    for name, build in operators(t).items():
        df = build()
        p = df._jdf.queryExecution().executedPlan().toString()
        s = summarize(p)
        py = sum(s[n] for n in PYTHON)
        cells = [str(s[n]) for n in shown]
        print(f"| {name} | " + " | ".join(cells) + f" | {py} |")
        if formatted and formatted in name:
            df.explain("formatted")


if __name__ == "__main__":
    main()
