"""Benchmark the headline queries; prints one JSON line.

Env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
Each query's result is fully computed with the ``noop`` sink (no collect);
each query runs BENCH_REPEAT times (default 2) and the best time is reported.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = ("evaluation_summary", "form_document_sizes", "save_log_state", "grade_lookup", "kpi_listing",
            "competencies_with_scores", "user_profiles", "save_log_accepted", "advance_steps", "update_steps",
            "append_kpis", "cascade_delete_counts")


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    names = sys.argv[1:] or list(HEADLINE)
    from evalspark.plans import QUERIES
    from evalspark.session import get_spark
    spark = get_spark(f"local[{cpus}]", shuffle_partitions=max(8, cpus * 2),
                      extra={"spark.driver.memory": os.environ.get("BENCH_DRIVER_MEMORY", "16g")})
    # warm-up: JVM, code generation and parquet metadata
    QUERIES["kpi_pct"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    repeat = int(os.environ.get("BENCH_REPEAT", "2"))
    times = {}
    for n in names:
        best = None
        for _ in range(repeat):
            t0 = time.time()
            QUERIES[n](spark, sf_dir).write.format("noop").mode("overwrite").save()
            el = time.time() - t0
            best = el if best is None else min(best, el)
        times[n] = round(best, 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "total_headline_sec", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": sf}))


if __name__ == "__main__":
    main()
