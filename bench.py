"""Time the headline queries on the tables in $BENCH_SF_DIR; print one JSON line."""

import json
import os
import time

from pyspark.sql import SparkSession

import tessera.plans  # noqa: F401  registers every query
from tessera.plans.queries import QUERIES

HEADLINE = [
    "tree_diff", "diff3_changes", "apply_changes", "dir_rollup", "glob_filter", "history_list", "branch_point", "bisect_step",
    "dep_closure", "fixed_chunks", "dedup_stats", "missing_fragments", "match_level", "line_diff_counts", "lru_evict", "lock_status",
    "tumbling_events", "session_events", "node_diff", "merge_result", "lines_meet", "read_ranges", "kv_list",
]


def main() -> None:
    folder, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["tree_scan"](spark, folder).write.format("noop").mode("overwrite").save()  # starts executors and compiles
    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(folder)}))
    spark.stop()


if __name__ == "__main__":
    main()
