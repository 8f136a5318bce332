"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) names the tables, BENCH_CPUS (default 8) the local
threads, BENCH_RUNS (default 3) the timed runs per query after one warm-up; the median counts.
Every result row is produced in full (noop sink), staging and streaming included.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from martspark.plans.queries import QUERIES  # noqa: E402
from martspark.session import build_session  # noqa: E402

HEADLINE = (
    "rfm_features", "rfm_scores", "standardize", "assign_cluster", "segment_customers",
    "age_count", "gender_count", "trans_by_hour", "service_count", "user_geo", "dashboard_stats",
    "daily_mart_tables", "top_services", "gender_distribution", "age_distribution", "share_of_total",
    "check_not_empty", "check_unique", "check_fk", "check_predicates",
    "active_sessions", "list_sessions", "chat_detail", "collect_images", "session_stats",
    "last_n_per_group", "prompt_payloads", "route_questions", "first_sql",
    "numeric_summary", "positions", "upsert", "cascade_delete", "read_fact_parts", "stream_session_stats",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = build_session(
        "martspark-bench",
        master=f"local[{cpus}]",
        spark__checkpoint__dir=tempfile.mkdtemp(prefix="bench-"),
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
        spark__driver__memory="12g",
        spark__sql__shuffle__partitions=cpus,
    )
    spark.sparkContext.setLogLevel("ERROR")

    def once(name: str) -> float:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    seconds = {}
    for name in HEADLINE:
        once(name)
        seconds[name] = round(statistics.median(once(name) for _ in range(runs)), 4)
    print(json.dumps({
        "metric": "total_median_query_seconds",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": sf_dir.rsplit("/sf", 1)[-1],
    }))
    spark.stop()


if __name__ == "__main__":
    main()
