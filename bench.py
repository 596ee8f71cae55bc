"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from spanwise.plans import catalog

HEADLINE = [
    "overlaps_all", "overlaps_first", "overlaps_contained_all", "count_overlaps", "non_overlaps", "nearest_any_k1", "nearest_any_k3",
    "map_to_global", "merge", "merge_slack", "cluster", "boundary", "max_disjoint", "subtract", "complement_gaps", "split",
    "tile_fwd", "window_mixed", "group_cumsum", "spliced_subseq", "extend_grp", "outside_bounds_clip", "sort_order",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    catalog.QUERIES["boundary"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # the session's first job
    took = {}
    for name in HEADLINE:
        runs = []
        for _ in range(2):
            began = time.perf_counter()
            catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - began)
        took[name] = round(min(runs), 3)
    scale = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": scale}))
    spark.stop()


if __name__ == "__main__":
    main()
