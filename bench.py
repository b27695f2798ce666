"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from panelspark.registry import queries
from panelspark.session import local_session

HEADLINES = (
    "w9_feature_table", "w9_feature_table_b", "r4_explode_held", "r4_explode_held_b",
    "m2_map_popularity", "m2_map_popularity_b", "e3_search_weights", "e3_search_weights_b",
    "n1_capture_curve", "n1_capture_curve_b", "w14_trajectories_b", "m10_threshold_sweep_b",
    "c5_null_audit", "o3_enrich_group_mean",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores, "panelspark-bench")
    spark.sparkContext.setLogLevel("ERROR")
    registered = queries()
    registered["o2_rows_by_period"](spark, folder).collect()  # start the JVM's code paths
    seconds = {}
    for name in HEADLINES:
        start = time.perf_counter()
        registered[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "headline queries, total wall clock",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(os.path.normpath(folder)).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
