"""Headline timings: one JSON line on stdout.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose data and cores. Every query is
timed from the source tables: staged tables are rebuilt for it, nothing is reused from an earlier query.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import DataFrame, SparkSession

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")

HEADLINE = [
    "dedupe_keep_first", "clean_telemetry", "cleaning_report", "complete_cases", "live_features", "scored_test_frame",
    "evaluate_baselines", "regression_metrics", "detect_sensor_fault", "recommend_next_hour", "clamped_balance",
    "controlled_balance", "impact_comparison", "error_summary", "ridge", "longest_flat_run", "long_series_clean",
    "long_series_features", "long_series_balance", "stream_hourly_rollup", "stream_live_decisions",
]


def session() -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("tidewell-bench")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def consume(df: DataFrame) -> None:
    """Compute every column of every row."""
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    from tidewell.catalog import flagship
    from tidewell.catalog.lake import Lake
    from tidewell.catalog.queries import BY_NAME

    spark = session()
    spark.read.parquet(f"{SF_DIR}/events.parquet").count()  # JVM and file system warm-up
    timings: dict[str, float] = {}

    def timed(name, run) -> None:
        start = time.perf_counter()
        consume(run())
        timings[name] = round(time.perf_counter() - start, 3)

    timed("actions_per_tank", lambda: flagship.actions_per_tank(spark, SF_DIR))
    for name in HEADLINE:
        timed(name, lambda: BY_NAME[name](Lake(spark, SF_DIR)))
    print(
        json.dumps(
            {
                "metric": "telemetry_headline_total", "value": round(sum(timings.values()), 3), "unit": "sec",
                "queries": timings, "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
