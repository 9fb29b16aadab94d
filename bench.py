"""Time the registered queries.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS
(default 8).  Prints one JSON line; each query is the median of its timed runs
after a warm-up on the same session, and includes binding the tables.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from patronage.plans.catalog import QUERIES
from patronage.session import local_session

# Training is bounded by the number of small jobs, so one timed run is enough.
SINGLE_RUN = {"ltv_scores_decision_tree", "suite_result_sizes"}
HEADLINE = [
    "bind_rows",
    "bind_all_filters",
    "basic_total_revenue",
    "basic_customer_revenue",
    "basic_segment_revenue",
    "basic_segment_unique_customer",
    "growth_monthly_revenue",
    "growth_monthly_customer",
    "growth_segment_monthly_revenue",
    "growth_monthly_revenue_lineitem",
    "new_existing_rows",
    "new_existing_month_new_percent",
    "new_existing_type_percent",
    "new_existing_segment_monthly_new_percent",
    "retention_by_customer",
    "retention_by_month",
    "cohort_by_revenue_pct",
    "cohort_by_retention_pct",
    "rfm_measures",
    "rfm_measures_lineitem",
    "rfm_segment",
    "rfm_trends",
    "ltv_feature_frame",
    "ltv_cluster_hint",
    "ltv_trim_quantile",
    "ltv_cluster_info",
    "ltv_scores_decision_tree",
    "suite_result_sizes",
]


def seconds(query, spark, sf_dir) -> float:
    start = time.perf_counter()
    # Every column is computed and no row is collected.
    query(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    spark = local_session(cpus, "patronage-bench")
    timings = {}
    for name in sys.argv[1:] or HEADLINE:
        query = QUERIES[name]
        timed = []
        if name not in SINGLE_RUN:
            seconds(query, spark, sf_dir)
        for _ in range(1 if name in SINGLE_RUN else runs):
            timed.append(seconds(query, spark, sf_dir))
        timings[name] = round(statistics.median(timed), 3)
        print(f"{name} {timings[name]}", file=sys.stderr, flush=True)
    report = {
        "metric": "total seconds of the headline queries",
        "value": round(sum(timings.values()), 3),
        "unit": "sec",
        "queries": timings,
        "sf": os.path.basename(sf_dir).removeprefix("sf"),
        "cpus": cpus,
        "runs": runs,
        "cached_base": False,
        "spark": spark.version,
    }
    spark.stop()
    print(json.dumps(report))


if __name__ == "__main__":
    main()
