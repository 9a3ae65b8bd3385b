"""Report tables over the raw, clean and scored frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidewell.contract import (
    CAPACITY, CONTROL, FLAGS, INFLOW, LEVEL, NUMERIC_COLUMNS, RAIN, TANK, TIME, USAGE, ControlRules,
)
from tidewell.functions.quantiles import exact_quantiles
from tidewell.functions.scalars import clip, display, micros, to_number
from tidewell.operators.features import latest_rows
from tidewell.operators.rules import decide_action, decision_reason
from tidewell.sources.times import with_times


def _long(df: DataFrame, keys: list[str], entries: dict[str, dict[str, Column]], label: str) -> DataFrame:
    """One row per key and entry: ``entries`` maps a label to its named values."""
    rows = F.array(
        *[
            F.struct(F.lit(name).alias(label), *[v.alias(k) for k, v in values.items()])
            for name, values in entries.items()
        ]
    )
    return df.select(*keys, F.inline(rows))


# --- raw data -----------------------------------------------------------------------------------
def null_profile(raw: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Missing values and their share of rows (one decimal) per column, in one pass."""
    columns = columns or raw.columns
    counts = raw.agg(
        F.count("*").alias("rows"), *[F.count_if(F.col(c).isNull()).alias(c) for c in columns]
    )
    entries = {
        c: {"missing": F.col(c), "pct": F.round(F.col(c) / F.col("rows") * 100.0, 1)} for c in columns
    }
    return _long(counts, [], entries, "column_name")


def missing_cells(df: DataFrame, columns: list[str]) -> DataFrame:
    """Size of the frame and its missing cells in all columns together; NaN counts as missing. One pass, one row."""
    lacking = [(F.col(c).isNull() | F.isnan(c)).cast("int") for c in columns]
    return df.select(sum(lacking, F.lit(0)).alias("lacking")).agg(
        F.count("*").alias("rows"), F.lit(len(columns)).cast("bigint").alias("columns"),
        F.coalesce(F.sum("lacking"), F.lit(0)).alias("missing_cells"), F.count_if(F.col("lacking") > 0).alias("rows_with_missing"),
    )


def duplicate_count(raw: DataFrame) -> DataFrame:
    """Rows whose (tank, time) was already seen. Distinct keys are counted by a shuffle, not per group."""
    per_key = raw.groupBy(TANK, TIME).agg(F.count("*").alias("n"))
    return per_key.agg(F.sum(F.col("n") - 1).alias("duplicate_rows"))


def head_preview(df: DataFrame, n: int = 12, order: list[str] | None = None) -> DataFrame:
    """First ``n`` rows in order (kept as a top-n per task, never a full sort)."""
    return df.orderBy(*(order or [TANK, TIME])).limit(n)


def raw_level_series(raw: DataFrame) -> DataFrame:
    """Recorded levels with a readable time, globally sorted by range partitioning."""
    dtype = dict(raw.dtypes)[LEVEL]
    return (
        with_times(raw).select(TANK, TIME, to_number(F.col(LEVEL), dtype).alias(LEVEL))
        .dropna(subset=[LEVEL, TIME])
        .orderBy(TANK, TIME)
    )


def raw_vs_clean_join(raw: DataFrame, clean: DataFrame) -> DataFrame:
    """Recorded next to cleaned level; a duplicated raw time fans out."""
    recorded = with_times(raw).select(TANK, TIME, F.col(LEVEL).alias("raw")).dropna()
    return recorded.join(clean.select(TANK, TIME, F.col(LEVEL).alias("cleaned")), [TANK, TIME])


def dataset_totals(raw: DataFrame, balance: DataFrame) -> DataFrame:
    """Totals over the whole dataset: period, rain, inflow, demand, overflow, missing and duplicate rows."""
    measured = [c for c in NUMERIC_COLUMNS if c != CAPACITY]
    missing = sum((F.count_if(F.col(c).isNull()) for c in measured), F.lit(0))
    base = raw.agg(
        F.count("*").alias("rows"), F.min(TIME).alias("date_min"), F.max(TIME).alias("date_max"),
        F.sum(RAIN).alias("total_rainfall"), F.sum(INFLOW).alias("total_inflow"),
        F.sum(USAGE).alias("total_demand"), missing.alias("missing_values"),
    )
    spilt = balance.agg(F.sum("overflow_litres").alias("v"))
    return base.withColumns(
        {
            "overflow_litres": spilt.scalar(),
            "duplicate_rows": duplicate_count(raw).scalar(),
        }
    )


# --- cleaning -----------------------------------------------------------------------------------
def missing_fixed_table(report: DataFrame) -> DataFrame:
    """Missing before, filled and still missing, per tank and column."""
    entries = {
        c: {
            "missing_before": F.col(f"missing_before_{c}"),
            "filled": F.col(f"missing_filled_{c}"),
            "still_missing": F.col(f"missing_after_{c}"),
        }
        for c in NUMERIC_COLUMNS
    }
    return _long(report, [TANK], entries, "column_name")


#: The published names of the counters, in the order of the report.
OUTLIER_COUNTERS = [
    "level_negative_repaired", "level_over_capacity_repaired", "level_impossible_jump_repaired",
    "level_values_repaired_total", "rainfall_negative_clipped", "inflow_negative_clipped",
    "usage_negative_clipped", "inflow_iqr_spikes_repaired", "inflow_iqr_fence_litres",
    "usage_zscore_spikes_repaired", "rows_flagged",
]


def outlier_table(report: DataFrame) -> DataFrame:
    """Outlier counters by issue, per tank; the fence is shown with one decimal."""
    value = lambda c: F.bround(F.round(c, 6), 1) if c == "inflow_iqr_fence_litres" else F.col(c).cast("double")
    return _long(report, [TANK], {c: {"count": value(c)} for c in OUTLIER_COUNTERS}, "issue")


def flagged_rows(clean: DataFrame) -> DataFrame:
    """Rows with any outlier flag."""
    return clean.filter(F.col(FLAGS[0]) | F.col(FLAGS[1]) | F.col(FLAGS[2]))


# --- models -------------------------------------------------------------------------------------
def metrics_table(metrics: DataFrame) -> DataFrame:
    """Models by rising MAE."""
    return metrics.orderBy("mae", "model")


def top_features(importance: DataFrame, model: str, n: int = 15) -> DataFrame:
    """The ``n`` most important features of a model."""
    return (
        importance.filter(F.col("model") == model)
        .orderBy(F.col("importance").desc(), "feature")
        .limit(n)
        .select("feature", "importance")
    )


def overflow_table(overflow: DataFrame) -> DataFrame:
    """Warning quality per model under its display names."""
    return overflow.select(
        "model", "precision", "recall", "f1",
        F.col("false_negatives").alias("missed_overflows"),
        F.col("false_positives").alias("false_alarms"),
        F.col("actual_positive").alias("true_overflow_hours"),
    )


# --- errors -------------------------------------------------------------------------------------
def seeded_sample(df: DataFrame, n: int = 1500, seed: int = 0) -> DataFrame:
    """At most ``n`` rows without replacement, the same ones for the same seed: lowest key hashes win."""
    draw = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(TANK).cast("string"), micros(F.col(TIME)).cast("string")))
    return df.orderBy(draw, TANK, TIME).limit(n)


def residual_histogram(df: DataFrame, bins: int = 24) -> DataFrame:
    """Equal-width histogram of ``error`` from its smallest to its largest value, last bin closed.

    Empty bins are kept. A constant error is spread over a unit interval around it.
    """
    span = df.agg(F.min("error").alias("lo"), F.max("error").alias("hi"))
    flat = F.col("lo") == F.col("hi")
    span = span.select(
        F.when(flat, F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"),
        F.when(flat, F.col("hi") + 0.5).otherwise(F.col("hi")).alias("hi"),
    )
    lo, hi = span.select("lo").scalar(), span.select("hi").scalar()
    # One row of bounds reaches the readings as a scalar subquery.
    placed = df.select("error").withColumns({"lo": lo, "hi": hi})
    slot = F.least(F.expr(f"width_bucket(error, lo, hi, {bins})"), F.lit(bins).cast("bigint"))
    counts = placed.groupBy(slot.alias("bin")).agg(F.count("*").alias("errors"))
    width = (F.col("hi") - F.col("lo")) / F.lit(bins)
    edge = lambda i: F.col("lo") + width * i
    slots = F.sequence(F.lit(1).cast("bigint"), F.lit(bins).cast("bigint"))
    grid = span.select("lo", "hi", F.explode(slots).alias("bin"))
    return grid.join(counts, "bin", "left").select(
        "bin", edge(F.col("bin") - 1).alias("low_edge"), edge(F.col("bin")).alias("high_edge"),
        F.coalesce("errors", F.lit(0)).alias("errors"),
    )


def error_summary(df: DataFrame) -> DataFrame:
    """MAE, RMSE, R2, mean error and the 95th percentile of the absolute error over all rows."""
    error, actual = F.col("error"), F.col("actual_level")
    spread = F.var_pop(actual) * F.count("*")
    sse = F.sum(error * error)
    base = df.agg(
        F.avg(F.abs(error)).alias("mae"),
        F.sqrt(sse / F.count("*")).alias("rmse"),
        F.when(spread > 0, 1.0 - sse / spread).otherwise(F.when(sse == 0, 1.0).otherwise(0.0)).alias("r2"),
        F.avg(error).alias("mean_error"),
    )
    # The quantile runs over one group that holds every row, hence the rank search.
    values = df.select(F.lit(0).alias("g"), F.abs(error).alias("value"))
    p95 = exact_quantiles(values, ["g"], {"p95": 0.95}).select("p95")
    return base.withColumn("p95_abs_error", p95.scalar())


def worst_misses(df: DataFrame, n: int = 8) -> DataFrame:
    """Largest absolute errors."""
    return (
        df.orderBy(F.abs("error").desc(), TANK, TIME)
        .limit(n)
        .select(
            TANK, TIME, *[display(F.col(c), 1).alias(c) for c in ("current_level", "actual_level", "pred", "error")]
        )
    )


# --- decisions ----------------------------------------------------------------------------------
def decided(df: DataFrame, rules: ControlRules = CONTROL) -> DataFrame:
    """Scored rows with the action and reason of the predicted fill."""
    args = (F.col("pred_fill_pct"), F.col("rain_roll_3"), F.col("rain_roll_24"))
    return df.withColumns(
        {"action": decide_action(*args, rules), "reason": decision_reason(*args, rules)}
    )


def action_counts(df: DataFrame) -> DataFrame:
    """Hours per action."""
    return df.groupBy("action").agg(F.count("*").alias("hours"))


def fill_timeline(df: DataFrame, rules: ControlRules = CONTROL) -> DataFrame:
    """Predicted fill and daily rain with the decision lines."""
    return df.select(
        TANK, TIME, "pred_fill_pct", "rain_roll_24",
        F.lit(rules.overflow_pct).alias("overflow_line"), F.lit(rules.low_pct).alias("reserve_line"),
    )


def recent_decisions(df: DataFrame, n: int = 10, rules: ControlRules = CONTROL) -> DataFrame:
    """Each tank's last ``n`` decisions."""
    shown = ["pred_fill_pct", "rain_roll_3", "rain_roll_24"]
    return decided(latest_rows(df, n), rules).select(
        TANK, TIME, *[display(F.col(c), 2).alias(c) for c in shown], "action", "reason"
    )


def latest_decision(df: DataFrame, rules: ControlRules = CONTROL) -> DataFrame:
    """Each tank's most recent decision."""
    return decided(latest_rows(df, 1), rules).select(TANK, TIME, "pred_fill_pct", "action", "reason")


IMPACT_METRICS = {
    # Display names.
    "Overflow (L)": "overflow_litres",
    "Overflow hours": "overflow_hours",
    "Overflow events": "overflow_events",
    "Shortage hours (below 15% reserve)": "shortage_hours",
    "Shortage events": "shortage_events",
    "Unmet demand (L)": "unmet_demand_litres",
    "Demand postponed by CONSERVE (L)": "demand_restricted_litres",
    "Lowest level (L)": "min_level",
    "Mean level (L)": "mean_level",
}


def impact_table(summary: DataFrame) -> DataFrame:
    """Nine measures side by side for both scenarios, per tank, one decimal."""
    of = lambda s, c: F.max(F.when(F.col("scenario") == s, F.col(c).cast("double")))
    wide = summary.groupBy(TANK).agg(
        *[of(s, c).alias(f"{s}_{c}") for s in ("no_controller", "with_controller") for c in IMPACT_METRICS.values()]
    )
    entries = {
        label: {s: display(F.col(f"{s}_{c}"), 1) for s in ("no_controller", "with_controller")}
        for label, c in IMPACT_METRICS.items()
    }
    return _long(wide, [TANK], entries, "metric")


def live_comparison(recommended: DataFrame, current: DataFrame, history: DataFrame, rules: ControlRules = CONTROL) -> DataFrame:
    """The recommendation next to both baselines and the two lines, per tank."""
    usual = latest_rows(history, 24).groupBy(TANK).agg(F.avg(USAGE).alias("usual_usage"))
    rows = (
        recommended.filter(F.col("predicted_level").isNotNull())
        .select(TANK, "predicted_level")
        .join(current, TANK)
        .join(usual, TANK)
    )
    cap = F.col(CAPACITY)
    physics = clip(F.col(LEVEL) + F.col(INFLOW) - F.col("usual_usage"), 0.0, cap)
    # The published labels of the lines.
    entries = {
        "prediction": {"value": F.col("predicted_level")},
        "persistence baseline (current level)": {"value": F.col(LEVEL)},
        "physics baseline": {"value": physics},
        "overflow line (90%)": {"value": cap * F.lit(rules.overflow_pct / 100.0)},
        "reserve line (30%)": {"value": cap * F.lit(rules.low_pct / 100.0)},
    }
    return _long(rows, [TANK], entries, "line")
