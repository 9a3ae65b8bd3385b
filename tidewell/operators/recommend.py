"""Next-hour recommendation for a batch of tanks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from tidewell.contract import CAPACITY, CONTROL, INFLOW, LEVEL, RAIN, TANK, USAGE, ControlRules
from tidewell.functions.scalars import clip
from tidewell.operators.baselines import physics_prediction
from tidewell.operators.features import live_features
from tidewell.operators.rules import (
    decide_action, decision_reason, detect_sensor_fault, fallback_banner_text, validate_readings,
)

#: Adds a column ``model_level`` (predicted next level) to a frame of feature rows.
Predictor = Callable[[DataFrame], DataFrame]


def recommend_next_hour(
    predictor: Predictor,
    history: DataFrame,
    current: DataFrame,
    sensor_check: DataFrame | None = None,
    rules: ControlRules = CONTROL,
) -> DataFrame:
    """Prediction, action and reason per tank; the physics balance serves tanks whose sensor is suspect.

    A rejected reading keeps its row: ``errors`` says why and the result columns stay NULL, so one bad tank
    does not stop a batch.
    """
    check = sensor_check
    if check is None:
        check = detect_sensor_fault(history, current)
    absent = {
        c: F.lit(v).cast("double")
        for c, v in ((RAIN, 0.0), (INFLOW, 0.0), (USAGE, 0.0), (LEVEL, None))
        if c not in current.columns
    }
    asked = current.withColumns(absent)
    errors = validate_readings(
        F.col(LEVEL), F.col(RAIN), F.col(INFLOW), F.col(USAGE), F.col(CAPACITY)
    )
    asked = asked.withColumn("errors", errors)
    good = asked.filter(F.size("errors") == 0)
    live = predictor(live_features(history, good, rules.history_rows)).select(
        TANK, CAPACITY, LEVEL, INFLOW, "rain_roll_3", "rain_roll_24", "usage_roll_mean_24", "model_level"
    )
    fallback = physics_prediction(
        F.col(LEVEL), F.col(INFLOW), F.col("usage_roll_mean_24"), F.col(CAPACITY)
    )
    modelled = clip(F.col("model_level"), 0.0, F.col(CAPACITY))
    fill = F.col("predicted_level") / F.col(CAPACITY) * 100.0
    answered = (
        live.join(check.select(TANK, "fault", "message"), TANK)
        .withColumn("predicted_level", F.when(F.col("fault"), fallback).otherwise(modelled))
        .withColumn("predicted_fill_pct", fill)
        .select(
            TANK,
            "predicted_level",
            "predicted_fill_pct",
            (F.col(LEVEL) / F.col(CAPACITY) * 100.0).alias("current_fill_pct"),
            decide_action(
                F.col("predicted_fill_pct"), F.col("rain_roll_3"), F.col("rain_roll_24"), rules
            ).alias("action"),
            decision_reason(
                F.col("predicted_fill_pct"), F.col("rain_roll_3"), F.col("rain_roll_24"), rules
            ).alias("reason"),
            F.col("fault").alias("used_fallback"),
            F.when(F.col("fault"), F.col("message")).alias("fallback_reason"),
        )
        .withColumn("banner", fallback_banner_text(F.col("used_fallback"), F.col("fallback_reason")))
    )
    return asked.select(TANK, "errors").join(answered, TANK, "left")
