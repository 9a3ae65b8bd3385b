"""Cleaning: capacity, physical limits, outlier flags, gap filling and the report on all of it.

All functions take the staged frame of :func:`tidewell.sources.readings.stage_readings`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidewell.contract import (
    CAPACITY, CLEANING, COERCED, DEFAULT_CAPACITY, FLAGS, HOT, INFLOW, INTERNAL_COLUMNS, LAYOUT, LEVEL,
    NUMERIC_COLUMNS, RAIN, SEGMENT_KEYS, TANK, TEMPERATURE, TIME, TS_US, USAGE, CleaningRules,
)
from tidewell.functions.quantiles import exact_quantiles
from tidewell.functions.scalars import at_least, clip, finite, flag
from tidewell.operators.interpolate import time_interpolate
from tidewell.plans.segments import along_tank, attach, has_long_tanks, in_segment, summarise, with_tank_values
from tidewell.sources.times import with_times


# --- physical limits ----------------------------------------------------------------------------
def clip_nonnegative(df: DataFrame) -> DataFrame:
    """Rain, inflow and usage below zero become zero; missing stays missing."""
    return df.withColumns({c: at_least(F.col(c), 0.0) for c in (RAIN, INFLOW, USAGE)})


# --- statistics per tank ------------------------------------------------------------------------
_PROBES = {
    "capacity": {"median": 0.5},
    "inflow": {"q1": 0.25, "q3": 0.75, "p99": 0.99},
    "usage": {"median": 0.5},
}


def _probe_columns() -> dict[str, Column]:
    inflow = at_least(F.col(INFLOW), 0.0)
    return {
        "capacity": F.col(CAPACITY),
        "inflow": F.when(inflow > 0, inflow),
        "usage": at_least(F.col(USAGE), 0.0),
    }


def _quantiles(staged: DataFrame) -> DataFrame:
    """Capacity median, inflow quantiles over positives and usage median per tank.

    Tanks of one segment (at most Layout.segment_rows readings) go through ``percentile``, whose state is
    then bounded; longer tanks through the rank search, which never gathers a tank.
    """
    probes = _probe_columns()
    short = (
        staged.filter(~F.col(HOT))
        .groupBy(TANK)
        .agg(
            *[
                F.percentile(probes[m], F.lit(p)).alias(f"{m}_{q}")
                for m, qs in _PROBES.items()
                for q, p in qs.items()
            ]
        )
    )
    if not has_long_tanks(staged):
        return short
    # One row per (tank, metric, value), so that a single rank search serves all metrics.
    each = F.inline(
        F.array(*[F.struct(F.lit(m).alias("metric"), v.alias("value")) for m, v in probes.items()])
    )
    values = staged.filter(F.col(HOT)).select(TANK, each).filter("value is not null")
    wanted = {q: p for qs in _PROBES.values() for q, p in qs.items()}
    found = exact_quantiles(values, [TANK, "metric"], wanted)
    long_tanks = found.groupBy(TANK).agg(
        *[
            F.max(F.when(F.col("metric") == m, F.col(q))).alias(f"{m}_{q}")
            for m, qs in _PROBES.items()
            for q in qs
        ]
    )
    return short.unionByName(long_tanks)


def tank_statistics(
    staged: DataFrame, capacity: float | None = None, rules: CleaningRules = CLEANING
) -> DataFrame:
    """One row per tank: resolved capacity, inflow fence, usage mean / deviation / median."""
    probes = _probe_columns()
    inflow_all = at_least(F.col(INFLOW), 0.0)
    moments = staged.groupBy(TANK).agg(
        F.count(probes["inflow"]).alias("inflow_positives"),
        F.min(probes["inflow"]).alias("inflow_min_positive"),
        F.max(inflow_all).alias("inflow_max"),
        F.count(probes["usage"]).alias("usage_n"),
        F.avg(probes["usage"]).alias("usage_mean"),
        F.stddev_pop(probes["usage"]).alias("usage_std"),
    )
    joined = moments.join(_quantiles(staged), TANK, "left")
    given = F.lit(float(capacity)) if capacity is not None else F.col("capacity_median")
    return joined.select(
        TANK,
        resolve_capacity(given).alias("capacity_value"),
        zero_inflated_upper_fence(rules).alias("inflow_fence"),
        "usage_n",
        "usage_mean",
        "usage_std",
        "usage_median",
    )


def resolve_capacity(candidate: Column) -> Column:
    """The candidate when it is a positive finite number, else the default tank size."""
    value = finite(candidate)
    return F.when(value > 0, value).otherwise(F.lit(DEFAULT_CAPACITY))


def iqr_bounds(staged: DataFrame, column: str, multiplier: float = CLEANING.iqr_multiplier) -> DataFrame:
    """Lower and upper IQR fence of a column per tank; (0, 0) for a tank without values."""
    value = F.col(column)
    quartiles = (
        staged.filter(~F.col(HOT))
        .groupBy(TANK)
        .agg(F.percentile(value, F.lit(0.25)).alias("q1"), F.percentile(value, F.lit(0.75)).alias("q3"))
    )
    if has_long_tanks(staged):
        long_rows = staged.filter(F.col(HOT) & value.isNotNull()).select(TANK, value.alias("value"))
        quartiles = quartiles.unionByName(exact_quantiles(long_rows, [TANK], {"q1": 0.25, "q3": 0.75}))
    spread = F.col("q3") - F.col("q1")
    return staged.groupBy(TANK).agg(F.count(value).alias("n")).join(quartiles, TANK, "left").select(
        TANK,
        F.coalesce(F.col("q1") - multiplier * spread, F.lit(0.0)).alias("lower_fence"),
        F.coalesce(F.col("q3") + multiplier * spread, F.lit(0.0)).alias("upper_fence"),
    )


def zero_inflated_upper_fence(rules: CleaningRules = CLEANING) -> Column:
    """Inflow fence built on positive readings only, since most hours move no water.

    Too few positives: the largest value, which flags nothing. A fence that is not above the smallest
    positive (a flat meter): their 99th percentile.
    """
    q1, q3 = F.col("inflow_q1"), F.col("inflow_q3")
    fence = finite(q3 + rules.iqr_multiplier * (q3 - q1))
    return (
        F.when(
            F.col("inflow_positives") < rules.min_positive_readings,
            F.coalesce(F.col("inflow_max"), F.lit(0.0)),
        )
        .when(fence.isNull() | (fence <= F.col("inflow_min_positive")), F.col("inflow_p99"))
        .otherwise(fence)
    )


# --- flags --------------------------------------------------------------------------------------
def zscore_mask(value: Column, rules: CleaningRules = CLEANING) -> Column:
    """|z| above the threshold, against the tank's population deviation."""
    usable = (F.col("usage_n") >= 3) & (F.col("usage_std") > 0)
    z = finite(F.when(usable, (value - F.col("usage_mean")) / F.col("usage_std")))
    return flag(F.abs(z) > rules.zscore_threshold)


def level_out_of_range() -> Column:
    """Level below zero or above the tank."""
    return flag((F.col(LEVEL) < 0) | (F.col(LEVEL) > F.col(CAPACITY)))


def flag_outliers(
    staged: DataFrame, capacity: float | None = None, rules: CleaningRules = CLEANING
) -> DataFrame:
    """Clipped meters plus every outlier flag; flagged values are still in place.

    Adds ``level_out_of_range``, ``level_jump`` and the three ``*_was_outlier`` flags, ``inflow_fence``
    and the raw-sign counters the report needs.
    """
    stats = tank_statistics(staged, capacity, rules)
    last_level = F.lag("last_level").over(along_tank())
    ends = summarise(staged, F.max_by(LEVEL, TS_US).alias("last_level"))
    context = with_tank_values(
        ends.select(*SEGMENT_KEYS, last_level.alias("carried_level")), stats
    )
    rows = attach(staged, context).withColumns(
        {
            CAPACITY: F.col("capacity_value"),
            "rain_negative": flag(F.col(RAIN) < 0),
            "inflow_negative": flag(F.col(INFLOW) < 0),
            "usage_negative": flag(F.col(USAGE) < 0),
        }
    )
    rows = clip_nonnegative(rows).withColumn("level_out_of_range", level_out_of_range())
    in_range = F.when(~F.col("level_out_of_range"), F.col(LEVEL))
    carried = F.col("carried_level")
    carried_ok = F.when((carried >= 0) & (carried <= F.col(CAPACITY)), carried)
    # The previous *row*, not the previous hour: gaps are not filled before the jump test.
    first_row = F.row_number().over(in_segment()) == 1
    previous = F.when(first_row, carried_ok).otherwise(F.lag(in_range).over(in_segment()))
    if rules.max_level_jump_litres is None:
        limit = F.lit(rules.jump_fraction) * F.col(CAPACITY)
    else:
        limit = F.lit(float(rules.max_level_jump_litres))
    usage_spike = zscore_mask(F.col(USAGE), rules) & flag(F.col(USAGE) > F.col("usage_median"))
    return (
        rows.withColumn("level_jump", flag(F.abs(in_range - previous) > limit))
        .withColumns(
            {
                "level_was_outlier": F.col("level_out_of_range") | F.col("level_jump"),
                "inflow_was_outlier": flag(F.col(INFLOW) > F.col("inflow_fence")),
                "usage_was_outlier": usage_spike,
            }
        )
        .drop("carried_level", "capacity_value", "usage_n", "usage_mean", "usage_std", "usage_median")
    )


def null_out_outliers(flagged: DataFrame) -> DataFrame:
    """Flagged level, inflow and usage readings become unknown."""
    return flagged.withColumns(
        {
            LEVEL: F.when(~F.col("level_was_outlier"), F.col(LEVEL)),
            INFLOW: F.when(~F.col("inflow_was_outlier"), F.col(INFLOW)),
            USAGE: F.when(~F.col("usage_was_outlier"), F.col(USAGE)),
        }
    )


# --- gaps ---------------------------------------------------------------------------------------
def fill_blank_meters(rows: DataFrame) -> DataFrame:
    """A blank rain or inflow cell means no water moved; an inflow *spike* stays unknown."""
    return rows.withColumns(
        {
            RAIN: F.coalesce(RAIN, F.lit(0.0)),
            INFLOW: F.when(~F.col("inflow_was_outlier"), F.coalesce(INFLOW, F.lit(0.0))),
        }
    )


def fill_gaps(rows: DataFrame) -> DataFrame:
    """Blank meters, then time interpolation, then zero for what no reading can tell.

    Interpolation fills a column completely once one value is valid, so the last resort (the median of
    what is left) only ever meets empty columns, whose median counts as zero.
    """
    columns = [INFLOW, LEVEL, TEMPERATURE, USAGE]
    filled = time_interpolate(fill_blank_meters(rows), columns)
    return filled.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in columns})


def clip_level_safety(rows: DataFrame) -> DataFrame:
    return rows.withColumn(LEVEL, clip(F.col(LEVEL), 0.0, F.col(CAPACITY)))


def drop_internal_columns(df: DataFrame) -> DataFrame:
    return df.drop(*INTERNAL_COLUMNS)


_WORKING = [
    "rain_negative", "inflow_negative", "usage_negative", "level_out_of_range", "level_jump",
    "inflow_fence", COERCED,
]


def clean_segments(flagged: DataFrame) -> DataFrame:
    """Cleaned rows that keep the segment layout, ready to be staged."""
    cleaned = clip_level_safety(fill_gaps(null_out_outliers(flagged)))
    return drop_internal_columns(cleaned).drop(*_WORKING)


def clean_telemetry(
    staged: DataFrame, capacity: float | None = None, rules: CleaningRules = CLEANING
) -> DataFrame:
    """Sorted-by-construction, gap-free readings with three outlier flags."""
    return clean_segments(flag_outliers(staged, capacity, rules)).drop(*LAYOUT)


# --- report -------------------------------------------------------------------------------------
def ingest_counts(raw: DataFrame, prefer: str | None = None) -> DataFrame:
    """Rows received and rows with an unreadable time, per tank."""
    return with_times(raw, prefer=prefer).groupBy(TANK).agg(
        F.count("*").alias("rows_raw"),
        F.count_if(F.col(TIME).isNull()).alias("bad_timestamps_dropped"),
    )


def cleaning_report(raw: DataFrame, staged: DataFrame, flagged: DataFrame) -> DataFrame:
    """One row per tank with every counter of the cleaning job.

    Missing values are counted after de-duplication and before clipping; a repaired level counts as filled
    on top of the missing ones.
    """
    missing = {c: f"missing_before_{c}" for c in NUMERIC_COLUMNS}
    before = staged.groupBy(TANK).agg(
        F.count("*").alias("rows_clean"),
        F.sum(COERCED).alias("non_numeric_coerced"),
        # Capacity is one resolved constant by then, so it is never missing.
        *[
            (F.count_if(F.col(c).isNull()) if c != CAPACITY else F.count_if(F.lit(False))).alias(name)
            for c, name in missing.items()
        ],
    )
    level = F.col(LEVEL)
    counters = flagged.groupBy(TANK).agg(
        F.max(CAPACITY).alias("capacity"),
        F.count_if(flag(level < 0)).alias("level_negative_repaired"),
        F.count_if(flag(level > F.col(CAPACITY))).alias("level_over_capacity_repaired"),
        F.count_if("level_jump").alias("level_impossible_jump_repaired"),
        F.count_if("level_was_outlier").alias("level_values_repaired_total"),
        F.count_if("rain_negative").alias("rainfall_negative_clipped"),
        F.count_if("inflow_negative").alias("inflow_negative_clipped"),
        F.count_if("usage_negative").alias("usage_negative_clipped"),
        F.count_if("inflow_was_outlier").alias("inflow_iqr_spikes_repaired"),
        F.max("inflow_fence").alias("inflow_iqr_fence_litres"),
        F.count_if("usage_was_outlier").alias("usage_zscore_spikes_repaired"),
        F.count_if(F.col(FLAGS[0]) | F.col(FLAGS[1]) | F.col(FLAGS[2])).alias("rows_flagged"),
    )
    filled = {
        c: F.col(name) + (F.col("level_values_repaired_total") if c == LEVEL else F.lit(0))
        for c, name in missing.items()
    }
    total = sum(filled.values(), F.lit(0))
    return (
        ingest_counts(raw)
        .join(before, TANK)
        .join(counters, TANK)
        .withColumn(
            "duplicate_rows_removed",
            F.col("rows_raw") - F.col("bad_timestamps_dropped") - F.col("rows_clean"),
        )
        .withColumns({f"missing_filled_{c}": v for c, v in filled.items()})
        .withColumn("total_values_repaired", total.cast("bigint"))
    )


def missing_after(clean: DataFrame) -> DataFrame:
    """Values still missing after cleaning, per tank."""
    return clean.groupBy(TANK).agg(
        *[F.count_if(F.col(c).isNull()).alias(f"missing_after_{c}") for c in NUMERIC_COLUMNS]
    )
