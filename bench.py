"""Headline queries at one scale; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINES = [
    "flagship_persistence", "event_metrics", "zero_fill_all", "lag_days", "features_calendar",
    "features_trend", "features_neighbour", "features_grid", "grouped_metrics", "agreement",
    "roc_auc", "average_precision", "threshold_sweep", "pick_threshold_scores", "prob_summary",
    "dedup_events", "point_in_polygon_inner", "cell_overlaps", "moore_neighbours",
    "grid_panel_entities", "verify_predictions", "complete_panel",
    "daily_counts_stream", "rolling_state_stream", "sketch_windows", "deploy_model",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    from daymosaic.session import build_session
    from daymosaic.suite import QUERIES

    spark = build_session(f"local[{cpus}]", cpus, "bench")
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{folder}/lineitem.parquet").count()  # JVM start is not measured
    times = {}
    for name in HEADLINES:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(json.dumps({"metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
