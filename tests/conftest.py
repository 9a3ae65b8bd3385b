"""Shared Spark session and literal telemetry frames."""

from __future__ import annotations

import math
import sys
from datetime import datetime, timedelta
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402

CAPACITY = 5000.0
SCHEMA = (
    "tank_id bigint, timestamp timestamp_ntz, rainfall_mm double, inflow_litres double, usage_litres double, "
    "tank_level_litres double, tank_capacity_litres double, temperature_c double, ingest_seq bigint"
)


@pytest.fixture(scope="session")
def spark() -> SparkSession:
    session = (
        SparkSession.builder.master("local[4]")
        .appName("tidewell-tests")
        .config("spark.sql.shuffle.partitions", "2")
        .config("spark.driver.memory", "6g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


def hour(i: float, start: datetime = datetime(2024, 3, 1)) -> datetime:
    return start + timedelta(hours=i)


def frame(spark: SparkSession, rows: list[dict], tank: int = 0) -> DataFrame:
    """Raw telemetry from dicts; absent measures are missing, absent times are hourly."""
    data = [
        (
            r.get("tank", tank), r.get("t", hour(i)), r.get("rain"), r.get("inflow"), r.get("usage"), r.get("level"),
            r.get("cap", CAPACITY), r.get("temp"), r.get("seq", i),
        )
        for i, r in enumerate(rows)
    ]
    floats = [tuple(float(v) if isinstance(v, int) and j not in (0, 8) else v for j, v in enumerate(d)) for d in data]
    return spark.createDataFrame(floats, SCHEMA)


def healthy_rows(n: int = 48) -> list[dict]:
    """Two days of sound hourly readings."""
    return [
        {
            "rain": 2.5 if i % 7 == 0 else 0.0, "inflow": 320.0 if i % 7 == 0 else 0.0,
            "usage": 40.0 + 10.0 * math.cos(i / 4.0), "level": 2600.0 + 120.0 * math.sin(i / 5.0),
            "temp": 18.0 + 3.0 * math.sin(i / 8.0),
        }
        for i in range(n)
    ]


@pytest.fixture(scope="session")
def healthy(spark) -> DataFrame:
    return frame(spark, healthy_rows()).cache()


def by_time(df: DataFrame, *columns: str) -> list:
    """Column values in (tank, time) order; tuples for several columns."""
    rows = df.orderBy("tank_id", "timestamp").select(*columns).collect()
    return [r[0] for r in rows] if len(columns) == 1 else [tuple(r) for r in rows]
