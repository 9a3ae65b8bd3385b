"""Operating rules, reading validation and sensor-fault detection as column jobs over all tanks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidewell.contract import (
    CAPACITY, CONSERVE, CONTROL, HARVEST, INFLOW, LEVEL, LIMITS, PREVENT, TANK, TIME, TS_US, USE,
    ControlRules, InputLimits,
)
from tidewell.functions.scalars import finite, fixed, flag, micros
from tidewell.operators.features import latest_rows


# --- the decision rule --------------------------------------------------------------------------
def _rule(fill: Column, rain3: Column, rain24: Column, rules: ControlRules, outcome: dict) -> Column:
    """First matching rule wins. A missing fill matches none of them, missing rain counts as dry."""
    rain3, rain24 = F.coalesce(rain3, F.lit(0.0)), F.coalesce(rain24, F.lit(0.0))
    short, long_ = rain3 >= rules.heavy_rain_3h_mm, rain24 >= rules.heavy_rain_24h_mm
    wet = short | long_
    return (
        F.when(fill > rules.overflow_pct, outcome["spill"])
        .when((fill >= rules.early_overflow_pct) & wet, outcome["early"])
        .when(fill < rules.low_pct, outcome["low"])
        .when((fill >= rules.use_band_pct) & wet, outcome["use"])
        .otherwise(outcome["harvest"])
    )


def decide_action(
    fill: Column, rain3: Column | None = None, rain24: Column | None = None, rules: ControlRules = CONTROL
) -> Column:
    """One of PREVENT_OVERFLOW, CONSERVE, USE, HARVEST for a predicted fill percentage."""
    dry = F.lit(0.0)
    outcome = {
        "spill": F.lit(PREVENT), "early": F.lit(PREVENT), "low": F.lit(CONSERVE),
        "use": F.lit(USE), "harvest": F.lit(HARVEST),
    }
    return _rule(fill, dry if rain3 is None else rain3, dry if rain24 is None else rain24, rules, outcome)


def decision_reason(fill: Column, rain3: Column, rain24: Column, rules: ControlRules = CONTROL) -> Column:
    """Sentence that explains the action of the same inputs."""
    rain3, rain24 = F.coalesce(rain3, F.lit(0.0)), F.coalesce(rain24, F.lit(0.0))
    pct = F.coalesce(fixed(fill), F.lit("nan"))
    high, low = f"{rules.overflow_pct:.0f}", f"{rules.low_pct:.0f}"
    trigger = F.when(
        rain3 >= rules.heavy_rain_3h_mm, F.concat(fixed(rain3, 1), F.lit(" mm in the last 3 h"))
    ).otherwise(F.concat(fixed(rain24, 1), F.lit(" mm in the last 24 h")))
    # The wording is part of the result.
    outcome = {
        "spill": F.concat(
            F.lit("Predicted level "), pct,
            F.lit(
                f"% of capacity - above the {high}% spill line. "
                "Open the overflow/divert valve and draw down now."
            ),
        ),
        "early": F.concat(
            F.lit("Only "), pct, F.lit("% full but "), trigger,
            F.lit(" of rain is already in the tank's path - pre-emptive draw-down avoids a spill."),
        ),
        "low": F.concat(
            F.lit("Predicted level "), pct,
            F.lit(
                f"% of capacity - below the {low}% reserve line. "
                "Restrict non-essential use (irrigation, car washing)."
            ),
        ),
        "use": F.concat(
            pct, F.lit("% full with "), fixed(F.greatest(rain3, rain24), 1),
            F.lit(
                " mm of incoming rain - "
                "draw water now (irrigation/household) to keep headroom for the storm."
            ),
        ),
        "harvest": F.concat(
            F.lit("Predicted level "), pct,
            F.lit(f"% of capacity - inside the comfortable {low}-{high}% band. Keep collecting."),
        ),
    }
    return _rule(fill, rain3, rain24, rules, outcome)


# --- validation of readings ---------------------------------------------------------------------
def validate_level(level: Column, capacity: Column) -> Column:
    """struct(ok, message) for a level against the physical limits."""
    level = finite(level)
    # The wording is part of the result.
    message = (
        F.when(level.isNull(), F.lit("Tank level must be a real number (got NaN/missing)."))
        .when(level < 0, F.concat(F.lit("Tank level cannot be negative (got "), fixed(level, 1), F.lit(" L).")))
        .when(
            level > capacity,
            F.concat(
                F.lit("Tank level "), fixed(level, 1), F.lit(" L exceeds tank capacity "),
                fixed(capacity, 1), F.lit(" L."),
            ),
        )
        .otherwise(F.lit("Tank level is within physical limits."))
    )
    ok = flag((level >= 0) & (level <= capacity))
    return F.struct(ok.alias("ok"), message.alias("message"))


def validate_readings(
    level: Column, rain: Column, inflow: Column, usage: Column, capacity: Column,
    limits: InputLimits = LIMITS,
) -> Column:
    """Array of problems of one reading; empty when it is fine.

    Values that are not numbers are reported alone, since nothing else is meaningful then.
    """
    named = [("Tank level", level), ("Rainfall", rain), ("Inflow", inflow), ("Usage", usage)]
    # The wording is part of the result.
    unreal = [
        F.when(finite(v).isNull(), F.lit(f"{label} must be a real number (got NaN/missing)."))
        for label, v in named
    ]
    checked = validate_level(level, capacity)
    rain_problem = F.when(
        rain < 0, F.concat(F.lit("Rainfall cannot be negative (got "), fixed(rain, 2), F.lit(" mm)."))
    ).when(
        rain > limits.max_rainfall_mm,
        F.concat(
            F.lit("Rainfall "), fixed(rain, 1),
            F.lit(f" mm is implausible for one hour (max {limits.max_rainfall_mm:.0f} mm)."),
        ),
    )
    flows = [
        F.when(v < 0, F.concat(F.lit(f"{label} cannot be negative (got "), fixed(v, 1), F.lit(" L).")))
        .when(
            v > top,
            F.concat(
                F.lit(f"{label} "), fixed(v), F.lit(f" L/h is implausible (max {top:,.0f} L/h).")
            ),
        )
        for label, v, top in (
            ("Inflow", inflow, limits.max_inflow_litres), ("Usage", usage, limits.max_usage_litres),
        )
    ]
    level_problem = F.when(~checked["ok"], checked["message"])
    return F.when(
        F.array_size(F.array_compact(F.array(*unreal))) > 0, F.array_compact(F.array(*unreal))
    ).otherwise(F.array_compact(F.array(level_problem, rain_problem, *flows)))


# --- sensor faults ------------------------------------------------------------------------------
def flat_run_in_window(readings: Column) -> Column:
    """Longest run of equal consecutive values in an array of at most a few readings; 0 when empty."""
    state = F.struct(
        F.lit(None).cast("double").alias("last"), F.lit(0).alias("run"), F.lit(0).alias("best")
    )

    def step(acc: Column, v: Column) -> Column:
        run = F.when(acc["last"] == v, acc["run"] + 1).otherwise(F.lit(1))
        return F.struct(v.alias("last"), run.alias("run"), F.greatest(acc["best"], run).alias("best"))

    return F.aggregate(readings, state, step, lambda acc: acc["best"])


def fault_window(
    history: DataFrame, flatline_hours: int = CONTROL.flatline_hours, level_column: str = LEVEL
) -> DataFrame:
    """Counters over each tank's last max(flatline_hours + 2, 8) readings."""
    if TS_US not in history.columns:
        history = history.withColumn(TS_US, micros(F.col(TIME)))
    rows = latest_rows(history, max(flatline_hours + 2, 8))
    level = finite(F.col(level_column))
    inflow = finite(F.col(INFLOW)) if INFLOW in history.columns else F.lit(None).cast("double")
    # At most max(flatline_hours + 2, 8) rows per tank reach these aggregates.
    series = F.sort_array(F.collect_list(F.struct(TS_US, level.alias("v"))))
    valid = F.filter(F.transform(F.col("series"), lambda r: r["v"]), lambda v: v.isNotNull())
    return (
        rows.groupBy(TANK)
        .agg(
            F.count("*").alias("checked_rows"),
            F.count_if(level.isNull()).alias("missing_levels"),
            F.count_if(level < 0).alias("negative_levels"),
            F.count_if(level > F.col(CAPACITY)).alias("over_levels"),
            F.count_if(inflow < 0).alias("negative_inflows"),
            F.min(level).alias("min_level"),
            F.max(level).alias("max_level"),
            F.max(CAPACITY).alias(CAPACITY),
            series.alias("series"),
        )
        .withColumn("valid", valid)
        .withColumn("flatline_run", flat_run_in_window(F.col("valid")).cast("bigint"))
        .withColumn("frozen_level", F.try_element_at("valid", F.lit(-1)))
        .drop("series", "valid")
    )


def detect_sensor_fault(
    history: DataFrame,
    tanks: DataFrame | None = None,
    flatline_hours: int = CONTROL.flatline_hours,
    level_column: str = LEVEL,
) -> DataFrame:
    """Per tank: ``fault``, ``reasons``, ``flatline_run``, ``checked_rows``, ``message``.

    ``tanks`` lists the tanks that must answer; one without history is itself a fault. A tank pinned full or
    empty for long enough counts as frozen too.
    """
    result = ["fault", "reasons", "flatline_run", "checked_rows"]
    # The wording is part of the result.
    if level_column not in history.columns:
        text = F.lit(f"Column '{level_column}' is missing - cannot trust the reading.")
        found = history.groupBy(TANK).agg(
            F.lit(True).alias("fault"), F.array(text).alias("reasons"),
            F.lit(0).cast("bigint").alias("flatline_run"), F.count("*").alias("checked_rows"),
        )
    else:
        w = fault_window(history, flatline_hours, level_column)
        text = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
        n = lambda c: F.col(c).cast("string")
        reasons = F.array(
            F.when(
                F.col("missing_levels") > 0,
                text(n("missing_levels"), " of the last ", n("checked_rows"),
                     " level readings are missing (NaN)"),
            ),
            F.when(
                F.col("negative_levels") > 0,
                text(n("negative_levels"), " negative level reading(s) (e.g. ",
                     fixed(F.col("min_level")), " L)"),
            ),
            F.when(
                F.col("over_levels") > 0,
                text(n("over_levels"), " reading(s) above capacity (max ", fixed(F.col("max_level")),
                     " L > ", fixed(F.col(CAPACITY)), " L)"),
            ),
            F.when(
                F.col("flatline_run") >= flatline_hours,
                text("sensor appears frozen: ", n("flatline_run"), " identical readings in a row (",
                     fixed(F.col("frozen_level")), " L)"),
            ),
            F.when(
                F.col("negative_inflows") > 0, text(n("negative_inflows"), " negative inflow reading(s)")
            ),
        )
        found = (
            w.withColumn("reasons", F.array_compact(reasons))
            .withColumn("fault", F.size("reasons") > 0)
            .select(TANK, *result)
        )
    if tanks is not None:
        absent = F.col("fault").isNull()
        found = tanks.select(TANK).distinct().join(found, TANK, "left").select(
            TANK,
            F.coalesce("fault", F.lit(True)).alias("fault"),
            F.when(absent, F.array(F.lit("No recent history available to check.")))
            .otherwise(F.col("reasons"))
            .alias("reasons"),
            F.coalesce("flatline_run", F.lit(0)).alias("flatline_run"),
            F.coalesce("checked_rows", F.lit(0)).alias("checked_rows"),
        )
    return found.withColumn("message", fault_message(F.col("reasons")))


def fault_message(reasons: Column) -> Column:
    """All reasons in one line, or the all-clear."""
    return F.when(F.size(reasons) > 0, F.concat_ws("; ", reasons)).otherwise(
        F.lit("Sensors look healthy.")
    )


def fallback_banner_text(used_fallback: Column, reason: Column) -> Column:
    """Notice shown next to a recommendation. Fixed wording."""
    return F.when(
        used_fallback,
        F.concat(
            F.lit("**Sensor fault suspected — using fallback baseline.** Reason: "), reason,
            F.lit(
                ". The ML model has been bypassed and the physics baseline (current level + inflow − "
                "average usage, clipped to the tank) is serving the recommendation."
            ),
        ),
    ).otherwise(F.lit("Sensors healthy — the trained ML model produced this prediction."))
