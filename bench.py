"""Time the headline queries; prints one JSON line.

Each query runs from the silver event table (written before the clock starts), with nothing
shared between queries.
"""

import json
import os
import sys
import time

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINE = [
    "project_rollup", "session_detail_document", "project_operations", "token_ledger", "task_rollup", "theil_sen_trend",
    "normalize_session_records", "thread_state", "list_sessions", "annotate_events",
]


def main() -> None:
    sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
    from loomtrace.plans import fixtures, registry, tables
    from loomtrace.session import build_session

    spark = build_session(
        "bench", f"local[{CPUS}]", **{"spark.sql.shuffle.partitions": CPUS, "spark.ui.enabled": "false", "spark.driver.memory": "16g"}
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries, times = registry.queries(), {}
    fixtures.log_events(spark, SF_DIR).count()
    queries["session_counts"](spark, SF_DIR).collect()  # warm-up
    for name in HEADLINE:
        tables.forget(keep=("log_events",))
        start = time.perf_counter()
        queries[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "headline_total", "value": total, "unit": "sec", "queries": times, "sf": os.path.basename(SF_DIR.rstrip("/"))}))


if __name__ == "__main__":
    main()
