"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time
from statistics import median

from pyspark.sql import SparkSession

from checks.catalogue import QUERIES

HEADLINE = [
    "vod_performance_page",
    "vod_performance_export",
    "vod_unique_weekly",
    "live_unique_monthly",
    "merged_events_all",
    "rollup_daily",
    "rollup_weekly",
    "rollup_monthly",
    "unique_devices_by_grain",
    "brands_by_group",
    "access_by_domain",
    "system_comparison",
    "entitled_brands",
    "user_documents",
    "group_documents",
    "user_records",
    "membership_sync",
    "product_backfill",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeats = int(os.environ.get("BENCH_REPEATS", "5"))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "16g"))
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    # Starts the executors and loads the classes every query needs.
    _run(spark, folder, "vod_performance_table")
    # Rounds over all queries, so a slow spell of the machine does not fall on one of them.
    runs = [{name: _run(spark, folder, name) for name in HEADLINE} for _ in range(repeats)]
    seconds = {name: round(median(run[name] for run in runs), 3) for name in HEADLINE}
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "sum of the median run of each headline query",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
                "cpus": int(cpus),
            }
        )
    )


def _run(spark: SparkSession, folder: str, name: str) -> float:
    """Seconds to compute every row and column of a query."""
    start = time.perf_counter()
    QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


if __name__ == "__main__":
    main()
