"""One runnable query per operator over the tables of a data folder."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidewell.catalog.lake import Lake, lake
from tidewell.contract import (
    CAPACITY, COERCED, FEATURES, FLAGS, HOT, INFLOW, LEVEL, NUMERIC_COLUMNS, RAIN,
    SEGMENT, SEQ, TANK, TARGET, TEMPERATURE, TIME, TS_US, USAGE,
)
from tidewell.functions.quantiles import exact_quantiles
from tidewell.functions.scalars import micros
from tidewell.operators import (
    balance, baselines, clean, features, interpolate, metrics, moments, recommend, regressors, reports, rules, split,
)
from tidewell.plans import flow
from tidewell.plans.lake import stage_table, staging_root
from tidewell.sources import events, readings, times
from tidewell.streaming import jobs
from tidewell.streaming.replay import replay

Query = Callable[[SparkSession, str], DataFrame]
#: Query bodies over an opened lake, by name.
BY_NAME: dict[str, Callable[[Lake], DataFrame]] = {}

#: Keeps exact decimal ties off the rounding border, where engines disagree. Same value in the SQL.
NUDGE = 3.14159e-8
KEY = [TANK, TIME]


def query(fn: Callable[[Lake], DataFrame]) -> Callable[[Lake], DataFrame]:
    """Register ``fn`` under its name."""
    BY_NAME[fn.__name__] = fn
    return fn


def queries() -> dict[str, Query]:
    """All queries as callables of a session and a data folder."""
    return {name: lambda spark, sf_dir, fn=fn: fn(lake(spark, sf_dir)) for name, fn in BY_NAME.items()}


def settle(c: str | Column) -> Column:
    """Double rounded to six decimals for comparison."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c.cast("double") + F.lit(NUDGE), 6)


def show(df: DataFrame, keys: list[str], doubles: list[str] = (), whole: list[str] = (), plain: list[str] = ()):
    """Result columns in comparable types: settled doubles, BIGINT counters, everything else untouched."""
    return df.select(
        *keys,
        *[settle(c).alias(c) for c in doubles],
        *[F.col(c).cast("bigint").alias(c) for c in whole],
        *plain,
    )


MEASURES = [RAIN, INFLOW, USAGE, LEVEL, TEMPERATURE]


# --- sources, sinks, schema checks --------------------------------------------------------------
@query
def read_telemetry_csv(lk: Lake) -> DataFrame:
    path = f"{staging_root(lk.spark)}/csv_{uuid.uuid4().hex}"
    text = events.text_readings(lk.spark, lk.sf_dir)
    padded = text.toDF(*[f" {c} " for c in text.columns])
    readings.write_table(padded, path, "csv")
    df = readings.load_readings(lk.spark, path)
    return df.select(F.col(TANK).cast("bigint").alias(TANK), TIME, RAIN, INFLOW, USAGE, LEVEL)


@query
def passthrough_frame(lk: Lake) -> DataFrame:
    return show(readings.load_readings(lk.spark, lk.raw), KEY, MEASURES + [CAPACITY])


@query
def normalise_headers(lk: Lake) -> DataFrame:
    padded = lk.raw.toDF(*[f"  {c} " for c in lk.raw.columns])
    return show(readings.normalise_headers(padded), KEY, MEASURES)


@query
def check_required_columns(lk: Lake) -> DataFrame:
    lacking = lk.raw.drop(USAGE, LEVEL)
    names = F.array(*[F.lit(c) for c in readings.missing_columns(lacking)])
    return lacking.agg(F.count("*").alias("rows")).select("rows", F.explode(names).alias("missing_column"))


@query
def default_optional_columns(lk: Lake) -> DataFrame:
    bare = lk.raw.drop(CAPACITY, TEMPERATURE)
    return show(readings.default_optional_columns(bare), KEY, [RAIN, CAPACITY, TEMPERATURE])


@query
def write_table(lk: Lake) -> DataFrame:
    path = f"{staging_root(lk.spark)}/table_{uuid.uuid4().hex}.parquet"
    dated = lk.raw.withColumn("day", F.to_date(TIME))
    readings.write_table(dated, path, partition_by=["day"])
    return show(readings.load_readings(lk.spark, path), KEY, MEASURES)


@query
def dataset_signature(lk: Lake) -> DataFrame:
    return flow.dataset_signature(lk.features)


@query
def save_and_load_model(lk: Lake) -> DataFrame:
    """Levels of both models before saving and after loading, row by row."""
    path = flow.save_bundle(lk.trained, f"{staging_root(lk.spark)}/bundle_{uuid.uuid4().hex}")
    loaded = flow.load_bundle(lk.spark, path)
    rows = lk.features
    for name in regressors.MODELS:
        rows = regressors.predict_level(lk.trained.models[name], rows, f"{name}_before")
        rows = regressors.predict_level(loaded.models[name], rows, f"{name}_after")
    return rows.select(*KEY, *[(F.col(f"{m}_before") == F.col(f"{m}_after")).alias(f"same_{m}") for m in regressors.MODELS])


@query
def reuse_or_retrain(lk: Lake) -> DataFrame:
    """The same readings twice, then those of every other tank: which run reuses the stored models, and its hours of impact."""
    path = flow.save_bundle(lk.trained, f"{staging_root(lk.spark)}/bundle_{uuid.uuid4().hex}")
    fewer = lk.raw.filter(F.col(TANK) % 2 == 0)
    runs = [
        flow.load_or_train(lk.spark, source, path, run_cv=False).impact_rows(name)
        for name, source in (("same", lk.raw), ("fewer", fewer), ("fewer again", fewer))
    ]
    return reduce(DataFrame.unionByName, runs)


# --- cleaning -----------------------------------------------------------------------------------
@query
def parse_timestamps(lk: Lake) -> DataFrame:
    return readings.parse_timestamps(events.text_readings(lk.spark, lk.sf_dir)).select(TANK, TIME, "ingest_seq")


@query
def parse_timestamps_mixed(lk: Lake) -> DataFrame:
    """Event times as six files would write them, one in a zone of its own; each file is read in its layout."""
    return times.with_times(events.mixed_times(lk.spark, lk.sf_dir), prefer="month_first").select("event_id", times.SOURCE, TIME)


@query
def time_layouts(lk: Lake) -> DataFrame:
    """The vote on those files: how many cells each layout chosen has read."""
    voted = times.vote(events.mixed_times(lk.spark, lk.sf_dir))
    settled = times.settle(voted, prefer="month_first")
    return voted.select(times.SOURCE, "cells", "reads").join(settled, times.SOURCE)


@query
def sort_by_time(lk: Lake) -> DataFrame:
    return show(lk.raw.orderBy(TANK, TIME), KEY, [LEVEL])


@query
def dedupe_keep_first(lk: Lake) -> DataFrame:
    first = readings.dedupe_keep_first(events.event_readings(lk.spark, lk.sf_dir))
    return show(first, KEY, MEASURES, ["ingest_seq"])


@query
def first_over_files(lk: Lake) -> DataFrame:
    """First reading of each tank and hour where the events lie in seven CSV files: by file, then by line."""
    path = f"{staging_root(lk.spark)}/csv_{uuid.uuid4().hex}"
    rows = events.event_readings(lk.spark, lk.sf_dir).withColumnRenamed(SEQ, "event_id")
    rows = rows.withColumn("part", F.col("event_id") % 7)
    rows.repartition("part").sortWithinPartitions("part", "event_id").write.option("header", True).partitionBy("part").csv(path)
    df = readings.read_telemetry_csv(lk.spark, path, recursive=True)
    first = readings.dedupe_keep_first(readings.coerce_numeric(readings.parse_timestamps(df)))
    return show(first.withColumn(TANK, F.col(TANK).cast("bigint")), KEY, MEASURES, ["event_id"])


@query
def coerce_numeric(lk: Lake) -> DataFrame:
    typed = readings.coerce_numeric(events.text_readings(lk.spark, lk.sf_dir))
    return show(typed, ["ingest_seq"], [RAIN, INFLOW, USAGE, LEVEL], [COERCED])


@query
def resolve_capacity(lk: Lake) -> DataFrame:
    varied = lk.staged.withColumn(CAPACITY, F.col(LEVEL))
    return show(clean.tank_statistics(varied), [TANK], ["capacity_value"])


@query
def clip_nonnegative(lk: Lake) -> DataFrame:
    return show(clean.clip_nonnegative(lk.staged), KEY, [RAIN, INFLOW, USAGE])


@query
def flag_level_out_of_range(lk: Lake) -> DataFrame:
    return show(lk.flagged, KEY, [LEVEL], plain=["level_out_of_range"])


@query
def flag_level_jump(lk: Lake) -> DataFrame:
    return lk.flagged.select(*KEY, "level_jump", "level_was_outlier")


@query
def null_out_level_outliers(lk: Lake) -> DataFrame:
    return show(clean.null_out_outliers(lk.flagged), KEY, [LEVEL, INFLOW, USAGE])


@query
def iqr_bounds(lk: Lake) -> DataFrame:
    return show(clean.iqr_bounds(lk.staged, USAGE), [TANK], ["lower_fence", "upper_fence"])


@query
def zero_inflated_upper_fence(lk: Lake) -> DataFrame:
    return show(clean.tank_statistics(lk.staged), [TANK], ["inflow_fence"])


@query
def flag_inflow_spike(lk: Lake) -> DataFrame:
    return show(lk.flagged, KEY, [INFLOW], plain=["inflow_was_outlier"])


@query
def zscore_mask(lk: Lake) -> DataFrame:
    stats = clean.tank_statistics(lk.staged)
    context = lk.staged.select(TANK, SEGMENT).distinct().join(stats, TANK)
    masked = lk.staged.join(context, [TANK, SEGMENT]).withColumn("is_extreme", clean.zscore_mask(F.col(USAGE)))
    return masked.select(*KEY, "is_extreme")


@query
def flag_usage_spike(lk: Lake) -> DataFrame:
    return show(lk.flagged, KEY, [USAGE], plain=["usage_was_outlier"])


@query
def fill_rain_zero(lk: Lake) -> DataFrame:
    return show(clean.fill_blank_meters(lk.flagged), KEY, [RAIN])


@query
def fill_inflow_zero_or_interpolate(lk: Lake) -> DataFrame:
    filled = interpolate.time_interpolate(clean.fill_blank_meters(clean.null_out_outliers(lk.flagged)), [INFLOW])
    return show(filled, KEY, [INFLOW])


@query
def time_interpolate(lk: Lake) -> DataFrame:
    return show(interpolate.time_interpolate(lk.staged, [LEVEL, TEMPERATURE, USAGE]), KEY, [LEVEL, TEMPERATURE, USAGE])


@query
def median_fallback(lk: Lake) -> DataFrame:
    empty = lk.flagged.withColumn(TEMPERATURE, F.lit(None).cast("double"))
    return show(clean.fill_gaps(clean.null_out_outliers(empty)), KEY, [TEMPERATURE])


@query
def clip_level_safety(lk: Lake) -> DataFrame:
    return show(clean.clip_level_safety(lk.staged), KEY, [LEVEL])


@query
def drop_internal_columns(lk: Lake) -> DataFrame:
    marked = lk.raw.withColumns({"_is_sensor_outlier": F.lit(False), "overflow_litres": F.lit(0.0)})
    return show(clean.drop_internal_columns(marked), KEY, [c for c in lk.raw.columns if c not in KEY])


_REPORT_COUNTS = [
    "rows_raw", "bad_timestamps_dropped", "duplicate_rows_removed", "non_numeric_coerced", "rows_clean",
    "level_negative_repaired", "level_over_capacity_repaired", "level_impossible_jump_repaired",
    "level_values_repaired_total", "rainfall_negative_clipped", "inflow_negative_clipped",
    "usage_negative_clipped", "inflow_iqr_spikes_repaired", "usage_zscore_spikes_repaired", "rows_flagged",
    "total_values_repaired",
    *[f"missing_{s}_{c}" for s in ("before", "filled", "after") for c in NUMERIC_COLUMNS],
]


@query
def cleaning_report(lk: Lake) -> DataFrame:
    return show(lk.report, [TANK], ["capacity", "inflow_iqr_fence_litres"], _REPORT_COUNTS)


@query
def cleaning_report_dirty(lk: Lake) -> DataFrame:
    """Text input with words, broken times and duplicates: the ingest counters."""
    raw = readings.default_optional_columns(events.text_readings(lk.spark, lk.sf_dir))
    staged = readings.stage_readings(raw)
    counts = clean.ingest_counts(raw).join(
        staged.groupBy(TANK).agg(
            F.count("*").alias("rows_clean"), F.sum(COERCED).alias("non_numeric_coerced")
        ),
        TANK,
    )
    return show(counts, [TANK], [], ["rows_raw", "bad_timestamps_dropped", "rows_clean", "non_numeric_coerced"])


@query
def clean_telemetry(lk: Lake) -> DataFrame:
    return show(clean.clean_telemetry(lk.staged), KEY, NUMERIC_COLUMNS, plain=FLAGS)


# --- features -----------------------------------------------------------------------------------
@query
def calendar_features(lk: Lake) -> DataFrame:
    return show(features.calendar_features(lk.clean), KEY, [], ["hour", "day_of_week", "is_weekend"])


@query
def fill_pct(lk: Lake) -> DataFrame:
    filled = lk.staged.withColumn("fill_pct", features.fill_pct(F.col(LEVEL), F.col(CAPACITY)))
    return show(filled, KEY, ["fill_pct"])


@query
def net_flow_headroom(lk: Lake) -> DataFrame:
    return show(features.balance_features(lk.clean), KEY, ["net_flow_litres", "headroom_litres"])


@query
def lag_features(lk: Lake) -> DataFrame:
    lagged = features.lag_features(lk.clean)
    return show(lagged, KEY, [f"{p}_lag_{k}" for p in features.LAG_SOURCES for k in features.LAGS])


@query
def delta_lag_1(lk: Lake) -> DataFrame:
    return show(features.lag_features(lk.clean), KEY, ["delta_lag_1"])


@query
def rolling_rain_sum(lk: Lake) -> DataFrame:
    """On uncleaned rows, so that missing readings inside the frame are covered."""
    rolled = features.add_features(lk.staged)
    return show(rolled, KEY, ["rain_roll_3", "rain_roll_6", "rain_roll_24"])


@query
def rolling_usage_mean(lk: Lake) -> DataFrame:
    rolled = features.add_features(lk.staged)
    return show(rolled, KEY, ["usage_roll_mean_6", "usage_roll_mean_24"])


@query
def lead_target(lk: Lake) -> DataFrame:
    return show(lk.featured, KEY, [TARGET])


@query
def capacity_default(lk: Lake) -> DataFrame:
    """The first reading's capacity decides for the tank; here capacity varies by row."""
    varied = lk.clean.withColumn(CAPACITY, F.col(LEVEL) + 1000.0)
    return show(features.add_features(varied), KEY, ["fill_pct", "headroom_litres"])


_NUMERIC_FEATURES = [f for f in FEATURES if f not in ("hour", "day_of_week", "is_weekend")]


@query
def complete_cases(lk: Lake) -> DataFrame:
    return show(lk.features, KEY, _NUMERIC_FEATURES + [TARGET], ["hour", "day_of_week", "is_weekend"])


@query
def live_features(lk: Lake) -> DataFrame:
    live = features.live_features(lk.clean, lk.current)
    return show(live, KEY, _NUMERIC_FEATURES, ["hour", "day_of_week", "is_weekend"])


@query
def prepared_summary(lk: Lake) -> DataFrame:
    summary = flow.prepared_summary(lk.report, lk.clean, lk.features)
    counts = ["rows_raw", "rows_clean", "rows_model_ready", "rows_dropped_for_lags_or_target", "final_feature_count"]
    return show(summary, [TANK], [], counts, ["date_min", "date_max", "final_feature_list", "target"])


@query
def preprocess(lk: Lake) -> DataFrame:
    prepared = flow.preprocess(lk.spark, lk.raw)
    return show(prepared.features, KEY, [LEVEL, "usage_roll_mean_24", TARGET], ["hour"])


# --- split, baselines, metrics ------------------------------------------------------------------
@query
def chronological_split(lk: Lake) -> DataFrame:
    return show(lk.split, KEY, [], ["row_index"], ["split"])


@query
def split_summary(lk: Lake) -> DataFrame:
    periods = ["train_start", "train_end", "test_start", "test_end"]
    return show(split.split_summary(lk.split), [TANK], [], ["train_rows", "test_rows"], periods)


@query
def walk_forward_folds(lk: Lake) -> DataFrame:
    train = lk.split.filter(F.col("split") == "train").drop("split", "row_index", "tank_rows")
    return show(split.walk_forward_folds(train), KEY, [], ["fold"], ["role"])


@query
def persistence_baseline(lk: Lake) -> DataFrame:
    return show(lk.features.withColumn("predicted", baselines.persistence_baseline()), KEY, ["predicted"])


@query
def physics_baseline(lk: Lake) -> DataFrame:
    predicted = baselines.physics_baseline(
        F.col(LEVEL), F.col(INFLOW), F.col("usage_roll_mean_24"), F.col(CAPACITY)
    )
    return show(lk.features.withColumn("predicted", predicted), KEY, ["predicted"])


@query
def baseline_predictions(lk: Lake) -> DataFrame:
    """Without the rolling column, plain usage stands in."""
    both = baselines.baseline_predictions(lk.clean)
    return show(both, KEY, ["pred_persistence", "pred_physics"])


_METRICS = ["mae", "rmse", "r2"]


@query
def regression_metrics(lk: Lake) -> DataFrame:
    scored = baselines.long_predictions(lk.scored, baselines.BASELINES, "actual_level")
    return show(metrics.regression_metrics(scored, ["model"]), ["model"], _METRICS, ["n"])


@query
def evaluate_baselines(lk: Lake) -> DataFrame:
    test = lk.split.filter(F.col("split") == "test")
    return show(baselines.evaluate_baselines(test, [TANK]), [TANK, "model"], _METRICS, ["n"], ["is_best"])


@query
def delta_target(lk: Lake) -> DataFrame:
    return show(lk.features.withColumn("delta", regressors.delta_target()), KEY, ["delta"])


@query
def recombine_prediction(lk: Lake) -> DataFrame:
    """With the last change as the predicted one, in both modes."""
    raw = F.col("delta_lag_1") * 5.0
    rows = lk.features.withColumns(
        {
            "from_delta": regressors.recombine_prediction(raw),
            "from_level": regressors.recombine_prediction(raw, regressors.DIRECT),
            "delta_of_level": regressors.predicted_delta(raw, regressors.DIRECT),
        }
    )
    return show(rows, KEY, ["from_delta", "from_level", "delta_of_level"])


_WARNING_COUNTS = [
    "true_positives", "false_positives", "false_negatives", "true_negatives", "actual_positive", "predicted_positive",
]


@query
def overflow_warning_metrics(lk: Lake) -> DataFrame:
    scored = baselines.long_predictions(lk.scored, baselines.BASELINES, "actual_level")
    quality = metrics.overflow_warning_metrics(scored, ["model"], fraction=0.6)
    return show(quality, ["model"], ["threshold_litres", "precision", "recall", "f1"], _WARNING_COUNTS)


@query
def baseline_leaderboard(lk: Lake) -> DataFrame:
    scored = baselines.long_predictions(lk.scored, baselines.BASELINES, "actual_level")
    scores = metrics.regression_metrics(scored, [TANK, "model"])
    board = metrics.with_improvement(scores, baselines.best_baseline(scores, [TANK]), [TANK])
    return show(board, [TANK, "model"], ["mae", "improvement_pct"], [], ["best_model"])


@query
def scored_test_frame(lk: Lake) -> DataFrame:
    values = [
        "current_level", RAIN, INFLOW, USAGE, "usage_roll_mean_24", "rain_roll_3", "rain_roll_24", "fill_pct",
        "actual_level", "pred_persistence", "pred_physics", "pred", "pred_fill_pct", "error",
    ]
    return show(lk.scored, KEY, values)


# --- regressors ---------------------------------------------------------------------------------
@query
def random_forest(lk: Lake) -> DataFrame:
    model = lk.trained.models[regressors.FOREST]
    return regressors.predict_level(model, lk.features).select(*KEY, "model_level")


@query
def ridge(lk: Lake) -> DataFrame:
    return regressors.predict_level(regressors.ridge(lk.features), lk.features).select(*KEY, "model_level")


def _folds(lk: Lake) -> tuple[DataFrame, list[tuple[int, int]], str]:
    train = split.pooled_split(lk.features).filter(F.col("split") == "train")
    return train, split.pooled_fold_bounds(train), TS_US


@query
def walk_forward_cv(lk: Lake) -> DataFrame:
    errors = moments.ridge_fold_errors(*_folds(lk))
    return metrics.regression_metrics(errors, ["fold"]).select("fold", F.round("mae", 3).alias("mae"), "n")


@query
def cv_summary(lk: Lake) -> DataFrame:
    """Mean and deviation over the folds of the model that won on the test window."""
    return regressors.cv_summary(lk.folds)


@query
def fold_normal_equations(lk: Lake) -> DataFrame:
    return show(moments.normal_equations(*_folds(lk)), [], ["residual"], ["fold", "train_rows", "valid_rows"])


@query
def direct_vs_delta(lk: Lake) -> DataFrame:
    return lk.trained.tables["target_mode"]


@query
def model_leaderboard(lk: Lake) -> DataFrame:
    return lk.trained.tables["leaderboard"]


@query
def feature_importance(lk: Lake) -> DataFrame:
    return lk.trained.tables["importance"]


@query
def train_and_evaluate(lk: Lake) -> DataFrame:
    return lk.trained.tables["test_frame"].drop(SEGMENT, TS_US, HOT)


# --- rules, validation, faults ------------------------------------------------------------------
def _decision_inputs() -> list[Column]:
    return [F.col(c) for c in ("pred_fill_pct", "rain_roll_3", "rain_roll_24")]


@query
def decide_action(lk: Lake) -> DataFrame:
    return lk.scored.select(*KEY, rules.decide_action(*_decision_inputs()).alias("action"))


@query
def decision_reason(lk: Lake) -> DataFrame:
    return lk.scored.select(*KEY, rules.decision_reason(*_decision_inputs()).alias("reason"))


@query
def validate_level(lk: Lake) -> DataFrame:
    checked = rules.validate_level(F.col(LEVEL), F.col(CAPACITY))
    return lk.staged.select(*KEY, F.inline(F.array(checked)))


@query
def validate_readings(lk: Lake) -> DataFrame:
    """Blank meters read as zero here, so that the range checks are reached."""
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    problems = rules.validate_readings(
        F.col(LEVEL), zero(RAIN), zero(INFLOW), zero(USAGE), F.col(CAPACITY)
    )
    return lk.staged.select(*KEY, F.concat_ws(" ", problems).alias("problems"))


@query
def latest_n_window(lk: Lake) -> DataFrame:
    return show(features.latest_rows(lk.staged, 8), KEY, [LEVEL])


_FAULT_COUNTS = ["checked_rows", "missing_levels", "negative_levels", "over_levels", "negative_inflows"]


@query
def fault_counters(lk: Lake) -> DataFrame:
    return show(rules.fault_window(lk.staged), [TANK], ["min_level", "max_level"], _FAULT_COUNTS)


@query
def longest_flat_run(lk: Lake) -> DataFrame:
    kinds = events.read_events(lk.spark, lk.sf_dir).select(
        F.col("user_id").alias(TANK), F.col("ts").alias(TIME), micros(F.col("ts")).alias(TS_US), "event_type"
    )
    laid_out = readings.segment_frame(kinds)
    return show(balance.longest_runs(laid_out, "event_type"), [TANK], [], ["longest_run"])


@query
def detect_sensor_fault(lk: Lake) -> DataFrame:
    tanks = lk.raw.select(TANK)
    found = rules.detect_sensor_fault(lk.staged, tanks)
    return show(found, [TANK], [], ["flatline_run", "checked_rows"], ["fault", "message"])


@query
def physics_prediction(lk: Lake) -> DataFrame:
    predicted = baselines.physics_prediction(
        F.col(LEVEL), F.col(INFLOW), F.col("usage_roll_mean_24"), F.col(CAPACITY)
    )
    return show(lk.features.withColumn("predicted", predicted), KEY, ["predicted"])


def _persistence(df: DataFrame) -> DataFrame:
    return df.withColumn("model_level", baselines.persistence_baseline())


def _recommended(lk: Lake) -> DataFrame:
    check = rules.detect_sensor_fault(lk.staged, lk.current)
    return recommend.recommend_next_hour(_persistence, lk.clean, lk.current, check)


@query
def recommend_next_hour(lk: Lake) -> DataFrame:
    rows = _recommended(lk).withColumns(
        {"errors": F.concat_ws(" ", "errors"), "used_fallback": F.coalesce("used_fallback", F.lit(False))}
    )
    return show(
        rows, [TANK], ["predicted_level", "predicted_fill_pct", "current_fill_pct"], [],
        ["errors", "action", "reason", "used_fallback", "fallback_reason"],
    )


@query
def fallback_banner_text(lk: Lake) -> DataFrame:
    return _recommended(lk).select(TANK, "banner")


@query
def recommend_with_model(lk: Lake) -> DataFrame:
    model = regressors.ridge(lk.features)
    rows = recommend.recommend_next_hour(
        lambda df: regressors.predict_level(model, df), lk.clean, lk.current
    )
    return rows.drop("errors")


# --- balance and impact -------------------------------------------------------------------------
@query
def catchment_inflow(lk: Lake) -> DataFrame:
    return show(lk.clean.withColumn("inflow", balance.catchment_inflow(F.col(RAIN))), KEY, ["inflow"])


@query
def clamped_balance(lk: Lake) -> DataFrame:
    return show(balance.clamped_balance(lk.clean), KEY, ["level", "overflow_litres"])


@query
def clamped_balance_from_fraction(lk: Lake) -> DataFrame:
    started = balance.clamped_balance(lk.clean, balance.INITIAL_LEVEL_FRACTION)
    return show(started, KEY, ["level", "overflow_litres"])


_PASS = ["level", "overflow_litres", "extra_used_litres", "unmet_litres", "restricted_litres"]


@query
def controlled_balance(lk: Lake) -> DataFrame:
    return show(lk.trajectory, [*KEY, "scenario", "action"], _PASS)


@query
def shortage_flag(lk: Lake) -> DataFrame:
    return lk.trajectory.select(*KEY, "scenario", "is_shortage", "is_overflow")


@query
def count_events(lk: Lake) -> DataFrame:
    flags = {"overflow_events": "is_overflow", "shortage_events": "is_shortage"}
    counted = balance.count_events(lk.trajectory, flags, [TANK, "scenario"])
    return show(counted, [TANK, "scenario"], [], list(flags))


_SUMMARY = [
    "overflow_litres", "unmet_demand_litres", "productive_extra_used_litres", "demand_restricted_litres",
    "final_level", "mean_level", "min_level",
]
_SUMMARY_COUNTS = ["overflow_hours", "shortage_hours", "overflow_events", "shortage_events", "hours"]


@query
def balance_summary(lk: Lake) -> DataFrame:
    return show(lk.summary, [TANK, "scenario"], _SUMMARY, _SUMMARY_COUNTS)


@query
def impact_comparison(lk: Lake) -> DataFrame:
    return show(
        balance.impact_comparison(lk.summary), [TANK],
        [
            "litres_saved_from_overflow", "overflow_reduction_pct", "water_used_productively_litres",
            "litres_conserved_by_restricting_demand", "unmet_demand_avoided_litres", "test_days",
        ],
        ["overflow_events_avoided", "shortage_events_avoided", "test_hours"],
    )


@query
def trajectory_compare(lk: Lake) -> DataFrame:
    levels = ["level_no_controller", "level_with_controller"]
    return show(balance.trajectory_compare(lk.trajectory), KEY, levels)


@query
def simulated_actions(lk: Lake) -> DataFrame:
    return balance.simulated_actions(lk.trajectory)


@query
def cumulative_overflow(lk: Lake) -> DataFrame:
    return show(balance.cumulative_overflow(lk.trajectory), [*KEY, "scenario"], ["cumulative_overflow_litres"])


# --- reports ------------------------------------------------------------------------------------
@query
def null_profile(lk: Lake) -> DataFrame:
    return show(reports.null_profile(lk.raw, NUMERIC_COLUMNS), ["column_name"], ["pct"], ["missing"])


@query
def missing_cells(lk: Lake) -> DataFrame:
    return reports.missing_cells(lk.raw, NUMERIC_COLUMNS)


@query
def duplicate_count(lk: Lake) -> DataFrame:
    return show(reports.duplicate_count(events.event_readings(lk.spark, lk.sf_dir)), [], [], ["duplicate_rows"])


@query
def head_preview(lk: Lake) -> DataFrame:
    return show(reports.head_preview(lk.raw, 12), KEY, MEASURES)


@query
def raw_level_series(lk: Lake) -> DataFrame:
    return show(reports.raw_level_series(lk.raw), KEY, [LEVEL])


@query
def raw_vs_clean_join(lk: Lake) -> DataFrame:
    raw = events.event_readings(lk.spark, lk.sf_dir)
    return show(reports.raw_vs_clean_join(raw, lk.clean), KEY, ["raw", "cleaned"])


@query
def missing_fixed_table(lk: Lake) -> DataFrame:
    table = reports.missing_fixed_table(lk.report)
    return show(table, [TANK, "column_name"], [], ["missing_before", "filled", "still_missing"])


@query
def outlier_table(lk: Lake) -> DataFrame:
    return show(reports.outlier_table(lk.report), [TANK, "issue"], ["count"])


@query
def flagged_rows(lk: Lake) -> DataFrame:
    return reports.flagged_rows(lk.clean).select(*KEY, *FLAGS)


@query
def baseline_table(lk: Lake) -> DataFrame:
    scored = baselines.long_predictions(lk.scored, baselines.BASELINES, "actual_level")
    table = reports.metrics_table(metrics.regression_metrics(scored, ["model"]))
    return show(table, ["model"], _METRICS, ["n"])


@query
def model_table(lk: Lake) -> DataFrame:
    return reports.metrics_table(lk.trained.tables["leaderboard"])


@query
def top_features(lk: Lake) -> DataFrame:
    return reports.top_features(lk.trained.tables["importance"], lk.trained.model_name)


@query
def seeded_sample(lk: Lake) -> DataFrame:
    return show(reports.seeded_sample(lk.scored), KEY, ["actual_level", "pred"])


@query
def residual_histogram(lk: Lake) -> DataFrame:
    return show(reports.residual_histogram(lk.scored), [], ["low_edge", "high_edge"], ["bin", "errors"])


@query
def error_summary(lk: Lake) -> DataFrame:
    return show(reports.error_summary(lk.scored), [], ["mae", "rmse", "r2", "mean_error", "p95_abs_error"])


@query
def worst_misses(lk: Lake) -> DataFrame:
    return show(reports.worst_misses(lk.scored), KEY, ["current_level", "actual_level", "pred", "error"])


@query
def overflow_table(lk: Lake) -> DataFrame:
    scored = baselines.long_predictions(lk.scored, baselines.BASELINES, "actual_level")
    table = reports.overflow_table(metrics.overflow_warning_metrics(scored, ["model"]))
    return show(
        table, ["model"], ["precision", "recall", "f1"], ["missed_overflows", "false_alarms", "true_overflow_hours"]
    )


@query
def action_counts(lk: Lake) -> DataFrame:
    return show(reports.action_counts(reports.decided(lk.scored)), ["action"], [], ["hours"])


@query
def fill_timeline(lk: Lake) -> DataFrame:
    values = ["pred_fill_pct", "rain_roll_24", "overflow_line", "reserve_line"]
    return show(reports.fill_timeline(lk.scored), KEY, values)


@query
def recent_decisions(lk: Lake) -> DataFrame:
    values = ["pred_fill_pct", "rain_roll_3", "rain_roll_24"]
    return show(reports.recent_decisions(lk.scored), KEY, values, [], ["action"])


@query
def latest_decision(lk: Lake) -> DataFrame:
    return show(reports.latest_decision(lk.scored), KEY, ["pred_fill_pct"], [], ["action", "reason"])


@query
def impact_table(lk: Lake) -> DataFrame:
    return show(reports.impact_table(lk.summary), [TANK, "metric"], ["no_controller", "with_controller"])


@query
def live_comparison(lk: Lake) -> DataFrame:
    table = reports.live_comparison(_recommended(lk), lk.current, lk.clean)
    return show(table, [TANK, "line"], ["value"])


@query
def dataset_totals(lk: Lake) -> DataFrame:
    totals = reports.dataset_totals(lk.raw, balance.clamped_balance(lk.clean))
    return show(
        totals, [], ["total_rainfall", "total_inflow", "total_demand", "overflow_litres"],
        ["rows", "missing_values", "duplicate_rows"], ["date_min", "date_max"],
    )


# --- one series holding every row ---------------------------------------------------------------
@query
def long_series_clean(lk: Lake) -> DataFrame:
    return show(lk.long_clean, [TIME], NUMERIC_COLUMNS, plain=FLAGS)


@query
def long_series_features(lk: Lake) -> DataFrame:
    rows = features.complete_cases(features.add_features(lk.long_clean))
    return show(rows, [TIME], _NUMERIC_FEATURES + [TARGET], ["hour", "day_of_week", "is_weekend"])


@query
def long_series_split(lk: Lake) -> DataFrame:
    return show(split.chronological_split(lk.long_clean), [TIME], [], ["row_index"], ["split"])


@query
def long_series_balance(lk: Lake) -> DataFrame:
    return show(balance.clamped_balance(lk.long_clean), [TIME], ["level", "overflow_litres"])


@query
def long_series_runs(lk: Lake) -> DataFrame:
    wet = lk.long_clean.withColumn("is_wet", F.col(RAIN) > 0)
    counted = balance.count_events(wet, {"wet_spells": "is_wet"}, [TANK])
    longest = balance.longest_runs(wet, "is_wet")
    return show(counted.join(longest, TANK), [TANK], [], ["wet_spells", "longest_run"])


@query
def exact_quantiles_whole_table(lk: Lake) -> DataFrame:
    values = events.read_events(lk.spark, lk.sf_dir).select("event_type", (F.col("value") - 50.0).alias("value"))
    found = exact_quantiles(values, ["event_type"], {"p01": 0.01, "p25": 0.25, "p50": 0.5, "p95": 0.95, "p99": 0.99})
    return show(found, ["event_type"], ["p01", "p25", "p50", "p95", "p99"])


# --- streams ------------------------------------------------------------------------------------
#: Readings reach the replays up to so much later than their order in time; the jobs wait longer than that.
_SHUFFLED_US = 36 * 3600 * 1_000_000


@query
def stream_ingest_clean(lk: Lake) -> DataFrame:
    stats = stage_table(clean.tank_statistics(lk.staged))  # once, not in every micro-batch
    out = replay(lk.raw, TIME, lambda s: jobs.ingest_clean(s, stats))
    flags = ["level_out_of_range", "inflow_was_outlier", "usage_was_outlier"]
    return show(out, KEY, [RAIN, INFLOW, USAGE, LEVEL], plain=flags)


@query
def stream_dedupe(lk: Lake) -> DataFrame:
    source = events.event_readings(lk.spark, lk.sf_dir)
    return replay(source, TIME, lambda s: jobs.dedupe(s, "2 hours")).select(*KEY)


@query
def stream_hourly_rollup(lk: Lake) -> DataFrame:
    source = events.read_events(lk.spark, lk.sf_dir)
    out = replay(source, "ts", lambda s: jobs.hourly_rollup(s, "2 hours"), closing_row=True)
    return show(out, KEY, [RAIN, INFLOW, USAGE, LEVEL, TEMPERATURE], ["events"])


@query
def stream_live_decisions(lk: Lake) -> DataFrame:
    out = replay(
        lk.clean, TIME, lambda s: jobs.live_decisions(s, _persistence, delay="2 days"), closing_row=True, shuffled_us=_SHUFFLED_US
    )
    taken = out.filter(F.col(jobs.OUTCOME) == jobs.TAKEN)
    return show(taken, KEY, ["predicted_level", "predicted_fill_pct"], [], ["used_fallback", "action"])


@query
def stream_balance(lk: Lake) -> DataFrame:
    out = replay(
        lk.clean, TIME, lambda s: jobs.running_balance(s, delay="2 days"), closing_row=True, shuffled_us=_SHUFFLED_US
    )
    return show(out.filter(F.col(jobs.OUTCOME) == jobs.TAKEN), KEY, ["level", "overflow_litres"])


@query
def stream_missed_readings(lk: Lake) -> DataFrame:
    """Every third reading is delivered once more when the stream has passed it: late, or the tank's last one again."""
    again = (F.dayofmonth(TIME) + F.hour(TIME)) % 3 == 0
    first, then = (F.lit(f"{year}-01-01").cast("timestamp_ntz").alias("sent") for year in (2000, 2001))
    sent = lk.clean.select("*", first).unionByName(lk.clean.filter(again).select("*", then))
    out = replay(sent, "sent", lambda s: jobs.running_balance(s, delay="0 seconds"), chunks=2)
    return show(jobs.missed_readings(out), [TANK], [], ["late", "repeated"])
