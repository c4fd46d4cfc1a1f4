"""Benchmark: headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``.

Prints one JSON line: {"metric", "value", "unit", "queries", "sf", ...}.
Each query is timed end to end (plan building, including any scalar
pre-pass, plus full execution into Spark's ``noop`` sink) as the median of
``$BENCH_RUNS`` runs, after one warm-up pass over all of them.
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import SparkSession  # noqa: E402

from climatrix.plans.catalog import REGISTRY  # noqa: E402
from climatrix.session import shared_dir  # noqa: E402

# The reference's timing page runs A14, F5 and A18; the rest are the other
HEADLINE = [
    "yearly_mean",
    "filter_threshold",
    "describe",
    "kpi_summary",
    "resample_mean",
    "correlation_matrix",
    "grid_mean",
    "kpi_dashboard",
]
# The costliest of the rest, run once at the bench's size and once at a tenth of it: growth, not part of the value.
COSTLY = [
    "describe_all",
    "box_stats",
    "box_stats_by_station",
    "sample_n",
    "histogram",
    "violin_density_by_month",
    "prepare_feed_default",
    "pivot_observations",
    "frame_rows",
    "curate_station_day",
]
SMALLER = {"sf0.1": "sf0.01", "sf0.01": "sf0.001"}
COUNTED = {"filter_threshold"}  # the timing page counts this result


def session(cpus: str) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("climatrix-bench")
        .config("spark.sql.shuffle.partitions", str(max(8, int(cpus) if cpus.isdigit() else 8)))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        # No per-call Python call-site capture while building plans (results unchanged).
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    shared_dir(spark)
    return spark


def run_once(spark: SparkSession, name: str, sf_dir: str) -> float:
    t0 = time.perf_counter()
    df = REGISTRY[name](spark, sf_dir)
    if name in COUNTED:
        df.count()
    else:
        df.write.format("noop").mode("overwrite").save()
    return time.perf_counter() - t0


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "5"))
    names = sys.argv[1:] or HEADLINE
    spark = session(cpus)
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    for name in names:  # warm-up: JIT, Python workers, file listings
        run_once(spark, name, sf_dir)
    times = {}
    for name in names:
        times[name] = round(statistics.median(run_once(spark, name, sf_dir) for _ in range(runs)), 4)
    folder, _, size = sf_dir.rpartition("/")
    growth = {}
    if not sys.argv[1:] and os.environ.get("BENCH_GROWTH", "1") != "0":
        for d in [x for x in (SMALLER.get(size), size) if x and os.path.isdir(f"{folder}/{x}")]:
            growth[d] = {name: round(run_once(spark, name, f"{folder}/{d}"), 3) for name in COSTLY}
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(
        json.dumps(
            {
                "metric": "sum of median seconds over headline queries",
                "value": round(sum(times.values()), 4),
                "unit": "sec",
                "queries": times,
                "sf": float(m.group(1)) if m else sf_dir,
                "rows": rows,
                "cpus": cpus,
                "runs": runs,
                "growth": growth,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
