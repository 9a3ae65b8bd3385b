"""Telemetry derived from the ``events`` table: one row per user and hour."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidewell.contract import (
    CAPACITY, DEFAULT_CAPACITY, INFLOW, LEVEL, RAIN, SEQ, TANK, TEMPERATURE, TIME, USAGE,
)
from tidewell.functions.scalars import micros, truncate_hour
from tidewell.sources.times import SOURCE


def read_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def _signal(event_type: str, scale: float, offset: float) -> Column:
    exact = F.sum(F.when(F.col("event_type") == event_type, F.col("value").cast("decimal(18,2)")))
    return exact.cast("double") * F.lit(scale) + F.lit(offset)


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly readings per user: each event type plays one meter, with faults of every kind."""
    level = F.expr("max_by(value, ts) filter (where event_type = 'signup')")
    return (
        read_events(spark, sf_dir)
        .groupBy(F.col("user_id").alias(TANK), truncate_hour(F.col("ts")).alias(TIME))
        .agg(
            _signal("view", 0.1, -0.1).alias(RAIN),
            _signal("click", 4.0, -4.0).alias(INFLOW),
            _signal("purchase", 2.0, -2.0).alias(USAGE),
            (level * 25.0 - 100.0).alias(LEVEL),
            F.lit(DEFAULT_CAPACITY).alias(CAPACITY),
            (_signal("error", 1.0, 0.0) / F.count_if(F.col("event_type") == "error")).alias(TEMPERATURE),
        )
    )


def event_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw readings keyed (user, hour), several per hour: the input with duplicate timestamps."""
    kind = F.col("event_type")
    value = F.col("value")
    return read_events(spark, sf_dir).select(
        F.col("user_id").alias(TANK),
        truncate_hour(F.col("ts")).alias(TIME),
        F.col("event_id").alias(SEQ),
        F.when(kind == "view", value / 10 - 0.1).alias(RAIN),
        F.when(kind == "click", value * 4 - 4).alias(INFLOW),
        F.when(kind == "purchase", value * 2 - 2).alias(USAGE),
        F.when(kind == "signup", value * 25 - 100).alias(LEVEL),
        F.lit(DEFAULT_CAPACITY).alias(CAPACITY),
        F.when(kind == "error", value).alias(TEMPERATURE),
    )


def one_long_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as one reading of a single tank: the one-series-holds-everything case."""
    kind = F.col("event_type")
    value = F.col("value")
    return read_events(spark, sf_dir).select(
        F.lit(0).cast("bigint").alias(TANK),
        F.col("ts").alias(TIME),
        F.col("event_id").alias(SEQ),
        F.when(kind == "view", value / 10 - 0.1).alias(RAIN),
        F.when(kind == "click", value * 4 - 4).alias(INFLOW),
        F.when(kind == "purchase", value * 2 - 2).alias(USAGE),
        F.when(kind == "signup", value * 25 - 100).alias(LEVEL),
        F.lit(DEFAULT_CAPACITY).alias(CAPACITY),
        F.when(kind == "error", value).alias(TEMPERATURE),
    )


def text_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings as a CSV reader delivers them: all text, with words among the numbers and broken times."""
    value = F.col("value").cast("string")
    kind = F.col("event_type")
    words = F.col("props")
    return read_events(spark, sf_dir).select(
        F.col("user_id").alias(TANK),
        F.when(kind == "error", words).otherwise(F.col("ts").cast("string")).alias(TIME),
        F.col("event_id").alias(SEQ),
        F.when(kind == "view", value).alias(RAIN),
        F.when(kind == "click", words).otherwise(value).alias(INFLOW),
        F.when(kind == "purchase", words).otherwise(value).alias(USAGE),
        value.alias(LEVEL),
    )


def mixed_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, source_file, timestamp as text): whole seconds in a layout per file, with a word now and then."""
    ts = F.col("ts")
    ahead = ts + F.expr("interval 150 minutes")
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    clock = lambda t: F.concat_ws(":", two(F.hour(t)), two(F.minute(t)), two(F.floor(F.extract(F.lit("SECOND"), t))))
    dated = lambda t, mark, *parts: F.concat_ws(mark, *(p(t).cast("string") for p in parts))
    twelve = F.concat(
        ((F.hour(ts) + 11) % 12 + 1).cast("string"), F.lit(":"), F.substring(clock(ts), 4, 5), F.when(F.hour(ts) < 12, " AM").otherwise(" PM")
    )
    names = F.array(*map(F.lit, "Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split()))
    files = {
        "iso": F.concat_ws(" ", dated(ts, "-", F.year, F.month, F.day), clock(ts)),
        "zoned": F.concat(dated(ahead, "-", F.year, F.month, F.day), F.lit("T"), clock(ahead), F.lit("+02:30")),
        "month": F.concat_ws(" ", dated(ts, "/", F.month, F.day, F.year), twelve),
        "day": F.concat_ws(" ", dated(ts, ".", F.day, F.month, F.year), clock(ts)),
        "name": F.concat(F.element_at(names, F.month(ts)), F.lit(" "), F.day(ts), F.lit(", "), F.year(ts), F.lit(" "), clock(ts)),
        "epoch": F.floor(micros(ts) / F.lit(1_000_000)).cast("string"),
    }
    file = F.element_at(F.array(*map(F.lit, files)), (F.col("event_id") % len(files)).cast("int") + 1)
    text = F.coalesce(*(F.when(F.col("name") == n, t) for n, t in files.items()))
    return read_events(spark, sf_dir).withColumn("name", file).select(
        "event_id", F.col("name").alias(SOURCE), F.when(F.col("event_id") % 41 == 7, F.lit("n/k")).otherwise(text).alias(TIME)
    )
