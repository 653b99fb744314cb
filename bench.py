"""Time the headline queries on $BENCH_SF_DIR and print one JSON line.

Every query is forced in full with the ``noop`` sink: one warm-up run, then the
median of the timed runs.
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import tempfile
import time

from depotlens.plans import QUERIES
from depotlens.session import build_session, release

HEADLINE = [
    "A01_monthly_rollup", "A01_driver_rollup", "A03_region_per_depot_month", "A11_driver_vs_depot", "A15_earnings_by_depot",
    "A16_eight_ratios", "A27_steering_pivot", "A31_distinct_counts", "J02_with_service", "J10_match_schedule", "J17_asof_weather",
    "J19_fuzzy_depot", "U01_upsert", "V16_preflight", "P10_clean_daily_ops", "W03_rolling", "W05_same_dow_median",
    "W13_festival_intensity", "W17_festival_runs", "W24_driver_score", "W25_rank", "M04_trip_schedule", "M11_suggest_slot",
    "M12_slot_summary", "E01_close_pending", "E03_accuracy_metrics", "F01_features", "D01_kpi_documents", "T04_top_bottom",
    "T07_vector_topk", "W25_rank_days", "R03_late_correction", "F07_future_rows",
]


def force(spark, name: str, folder: str) -> float:
    start = time.perf_counter()
    QUERIES[name].run(spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    names = sys.argv[1:] or HEADLINE
    spark = build_session(
        f"local[{cpus}]", app="bench",
        **{"spark.checkpoint.dir": tempfile.mkdtemp(prefix="bench-"), "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": os.environ.get("BENCH_MEMORY", "8g")},
    )
    times = {}
    for name in names:
        force(spark, name, folder)
        times[name] = round(statistics.median(force(spark, name, folder) for _ in range(runs)), 3)
    scale = re.search(r"sf([0-9.]+)", folder)
    print(json.dumps({
        "metric": "headline queries, total wall time", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": float(scale.group(1)) if scale else None,
    }), flush=True)
    release(spark)
    spark.stop()


if __name__ == "__main__":
    main()
