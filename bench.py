"""Time the headline queries; prints one JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py [name ...]
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

from driver_queries import QUERIES

HEADLINE = [
    "hourly_resample_spine",
    "impute_panel",
    "dedupe_first",
    "class_share_split",
    "yearly_summary",
    "grouped_monthly",
    "profile_ci",
    "boxplot_stats",
    "delta_draws",
    "kde_draw",
    "sampled_projection",
    "merit_order_clear",
    "merit_order_hours",
    "iteration_kpis",
    "period_profile",
    "scenario_stats",
    "histogram50",
]


HERE = os.path.dirname(os.path.abspath(__file__))


def main() -> None:
    # Python workers find the package where this file lies
    os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [HERE, os.environ.get("PYTHONPATH", "")]))
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("gridpanel-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["axis_range"](spark, sf_dir).collect()  # start the JVM's workers
    seconds = {}
    for name in sys.argv[1:] or HEADLINE:
        started = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - started, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "headline queries, total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).replace("sf", ""),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
