"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS], and the published workloads of 10 and 100 MB (12 bytes an op):
puts into a store, ten gets and ten ranges. One JSON line; each query is warmed up once and timed once, the workloads run cold."""

from __future__ import annotations

import json
import os
import shutil
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tidemark.operators import reads
from tidemark.plans.catalog import CATALOG
from tidemark.sources.workload import Workload, generate
from tidemark.store import Store

QUERIES = (
    "live_pairs latest_versions point_get multi_get range_pairs range_count multi_range_counts delete_view as_of_snapshot version_intervals "
    "replay_gets replay_outcomes replay_deletes replay_range_counts run_min_max physical_keys_per_level live_by_location merge_runs_newest_wins "
    "orders_live bloom_bits bloom_probe positional_zip parse_commands"
).split()


def timed(f) -> float:
    t = time.perf_counter()
    f()
    return round(time.perf_counter() - t, 3)


def workload(spark: SparkSession, folder: str, name: str, ops: int) -> dict[str, float]:
    store = Store(spark, f"file://{folder}/{name}", partitions=8)
    puts = generate(spark, Workload(puts=ops)).select("seq", F.col("a").alias("key"), F.col("b").alias("value"), F.lit(False).alias("tombstone"))
    out = {f"put_{name}": timed(lambda: store.put(puts))}
    log = store.log()
    keys = [r["key"] for r in log.limit(10).collect()]
    out[f"get10_{name}"] = timed(lambda: [store.get(k) for k in keys])
    ranges = [(i, -(2**31) + i * 10**8, -(2**31) + i * 10**8 + 10**7) for i in range(10)]
    out[f"range10_{name}"] = timed(lambda: [reads.range_count(store.log(a, b), a, b).collect() for _, a, b in ranges])
    return out


def main() -> None:
    cpus, d = os.environ.get("BENCH_CPUS", "8"), os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    folder = tempfile.mkdtemp(prefix="tidemark-bench-")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", f"file://{folder}/shared")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds: dict[str, float] = {}
    for name in QUERIES:
        run = lambda q=CATALOG[name][0]: q(spark, d).write.format("noop").mode("overwrite").save()
        run()
        seconds[name] = timed(run)
    for name, ops in (("10mb", 833_333), ("100mb", 8_333_333)):
        seconds |= workload(spark, folder, name, ops)
    spark.stop()
    shutil.rmtree(folder, ignore_errors=True)
    print(json.dumps({"metric": "total seconds of headline queries", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(d.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
