"""Time the headline queries and print one JSON line.

Every query runs once to warm the JVM and then three times; the median counts.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from terrace.session import local_session
from workload.queries import QUERIES

HEADLINE = (
    "status_summary", "clean_currency", "infer_types", "validate_flag", "validate_unique",
    "outlier_iqr", "categorize_tiers", "calc_filter", "filters_combined", "join_left", "join_full",
    "rollup_monthly", "pivot_status_priority", "topn_customers", "sort_rows_nulls_last",
    "kpi_cards", "chart_bar", "auto_report", "mask_pii", "quality_score", "insight_facts",
    "anomaly_zscore", "anomaly_forest", "forecast_linear", "classify_text", "upsert_merge",
    "latest_run_per_pipeline", "medallion_flow",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = local_session(cores, int(cores) if cores.isdigit() else 8)
    seconds = {}
    for name in HEADLINE:
        times = []
        for _ in range(runs + 1):
            start = time.perf_counter()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(times[1:]), 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "total_seconds_headline_queries",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": Path(folder).name.removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
