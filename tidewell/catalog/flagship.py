"""The minimum useful flow: readings to actions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidewell.contract import CAPACITY, INFLOW, LEVEL, TANK
from tidewell.operators.baselines import physics_prediction
from tidewell.operators.clean import clean_segments, flag_outliers
from tidewell.operators.features import add_features
from tidewell.operators.rules import decide_action
from tidewell.plans.lake import stage_series
from tidewell.sources.events import telemetry
from tidewell.sources.readings import stage_readings


def actions_per_tank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clean every reading, predict the next hour by water balance, decide, count hours per tank and action."""
    clean = stage_series(clean_segments(flag_outliers(stage_readings(telemetry(spark, sf_dir)))))
    rows = add_features(clean)
    predicted = physics_prediction(F.col(LEVEL), F.col(INFLOW), F.col("usage_roll_mean_24"), F.col(CAPACITY))
    fill = predicted / F.col(CAPACITY) * 100.0
    action = decide_action(fill, F.col("rain_roll_3"), F.col("rain_roll_24"))
    return rows.groupBy(TANK, action.alias("action")).agg(F.count("*").alias("hours"))
