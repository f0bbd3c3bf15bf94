"""Times the headline queries; prints one JSON line.

BENCH_SF_DIR  folder of the tables (default /root/testdata/sf0.1)
BENCH_CPUS    local cores (default 8)
BENCH_QUERIES comma-separated names, or "all"
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from meguri.catalog import QUERIES  # noqa: E402
from meguri.session import local_session  # noqa: E402

HEADLINE = [
    "undistributed_list", "o2_list_page", "a1_history_rollup", "a3_status_counts", "p1_normalized_address", "p7_name_tokens",
    "p9_use_classification", "f7_acceptance", "j1_past_row_target", "j6_confirmed_by_address", "j6_duplicate_candidates",
    "j8_nearest_point", "w1_name_verdicts", "t2_past_ingest", "t7_apply_decisions", "t11_research_plan",
    "s2_building_list", "s14_configured_extraction", "x1_streamed_rollup",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    asked = os.environ.get("BENCH_QUERIES", "")
    names = list(QUERIES) if asked == "all" else [n for n in asked.split(",") if n] or HEADLINE
    spark = local_session(cores, int(cores), "bench")
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["undistributed_list"](spark, folder).count()  # start the workers
    times = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": os.path.basename(folder.rstrip("/")),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
