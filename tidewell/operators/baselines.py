"""Persistence and physics baselines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidewell.contract import CAPACITY, INFLOW, LEVEL, TARGET, USAGE
from tidewell.functions.scalars import clip
from tidewell.operators.metrics import ACTUAL, PREDICTED, regression_metrics

#: Baselines in tie-breaking order. Fixed values.
BASELINES = ["persistence", "physics"]
CAPACITY_SAFETY = 1e-9


def persistence_baseline(level: Column | None = None) -> Column:
    """The next level equals the current one."""
    return F.col(LEVEL) if level is None else level


def physics_baseline(level: Column, inflow: Column, average_usage: Column, capacity: Column) -> Column:
    """Water balance, kept a hair below the brim."""
    return clip(level + inflow - average_usage, 0.0, capacity - F.lit(CAPACITY_SAFETY))


def physics_prediction(level: Column, inflow: Column, average_usage: Column, capacity: Column) -> Column:
    """Water balance of the fallback path, which may reach the brim."""
    return clip(level + inflow - average_usage, 0.0, capacity)


def baseline_predictions(df: DataFrame, usage_column: str = "usage_roll_mean_24") -> DataFrame:
    """Add ``pred_persistence`` and ``pred_physics``; plain usage stands in for a missing rolling mean."""
    usage = F.col(usage_column if usage_column in df.columns else USAGE)
    return df.withColumns(
        {
            "pred_persistence": persistence_baseline(),
            "pred_physics": physics_baseline(F.col(LEVEL), F.col(INFLOW), usage, F.col(CAPACITY)),
        }
    )


def long_predictions(df: DataFrame, models: list[str], actual: str = TARGET) -> DataFrame:
    """One row per (reading, model) with ``actual`` and ``predicted``, from ``pred_<model>`` columns."""
    each = F.array(
        *[F.struct(F.lit(m).alias("model"), F.col(f"pred_{m}").alias(PREDICTED)) for m in models]
    )
    spare = [c for c in df.columns if not c.startswith("pred_") and c != actual]
    return df.select(*spare, F.col(actual).alias(ACTUAL), F.inline(each))


def evaluate_baselines(df: DataFrame, by: list[str], target: str = TARGET) -> DataFrame:
    """Metrics of both baselines per group, with ``is_best`` on the lower MAE (persistence wins ties)."""
    keys = [c for c in by]
    scored = long_predictions(baseline_predictions(df), BASELINES, target)
    metrics = regression_metrics(scored, keys + ["model"])
    best = best_baseline(metrics, keys)
    if keys:
        joined = metrics.join(best, keys)
    else:
        joined = metrics.withColumn("best_model", best.select("best_model").scalar())
    return joined.withColumn("is_best", F.col("model") == F.col("best_model")).drop(
        "best_model", "baseline_mae"
    )


def best_baseline(metrics: DataFrame, by: list[str]) -> DataFrame:
    """Name and MAE of the best baseline per group."""
    order = F.array_position(F.array(*[F.lit(b) for b in BASELINES]), F.col("model"))
    return metrics.groupBy(*by).agg(
        F.min_by("model", F.struct("mae", order)).alias("best_model"), F.min("mae").alias("baseline_mae")
    )
