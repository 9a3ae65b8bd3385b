"""Error metrics and overflow-warning quality. Every function is one aggregate with map-side combining."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidewell.contract import CAPACITY, CONTROL

ACTUAL = "actual"
PREDICTED = "predicted"


def regression_metrics(df: DataFrame, by: list[str]) -> DataFrame:
    """MAE, RMSE, R2 and row count of ``predicted`` against ``actual`` per group.

    The total sum of squares is n * var_pop, which Spark merges from centred partial moments, so it needs
    neither a second pass nor the cancelling sum-of-squares formula. A constant target scores 1 when hit
    exactly and 0 otherwise; R2 of fewer than two rows is undefined.
    """
    error = F.col(PREDICTED) - F.col(ACTUAL)
    n, sse = F.col("n"), F.col("sse")
    spread = F.col("spread")
    r2 = (
        F.when(n < 2, F.lit(None).cast("double"))
        .when(spread > 0, 1.0 - sse / (spread * n))
        .when(sse == 0, F.lit(1.0))
        .otherwise(F.lit(0.0))
    )
    sums = df.groupBy(*by).agg(
        F.avg(F.abs(error)).alias("mae"),
        F.sum(error * error).alias("sse"),
        F.var_pop(ACTUAL).alias("spread"),
        F.count("*").alias("n"),
    )
    return sums.select(*by, "mae", F.sqrt(sse / n).alias("rmse"), r2.alias("r2"), "n")


def overflow_warning_metrics(
    df: DataFrame, by: list[str], fraction: float = CONTROL.warning_fraction
) -> DataFrame:
    """Precision, recall and F1 of the event "level at or above the warning line", with its counts."""
    line = F.col(CAPACITY) * F.lit(float(fraction))
    is_high = F.col(ACTUAL) >= line
    warned = F.col(PREDICTED) >= line
    counts = df.groupBy(*by).agg(
        F.max(line).alias("threshold_litres"),
        F.count_if(is_high & warned).alias("true_positives"),
        F.count_if(~is_high & warned).alias("false_positives"),
        F.count_if(is_high & ~warned).alias("false_negatives"),
        F.count_if(~is_high & ~warned).alias("true_negatives"),
    )
    tp, fp, fn = F.col("true_positives"), F.col("false_positives"), F.col("false_negatives")
    return counts.withColumns(
        {
            "precision": _ratio(tp, tp + fp),
            "recall": _ratio(tp, tp + fn),
            "f1": _ratio(2 * tp, 2 * tp + fp + fn),
            "actual_positive": tp + fn,
            "predicted_positive": tp + fp,
        }
    )


def _ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def with_improvement(metrics: DataFrame, best_baseline: DataFrame, by: list[str]) -> DataFrame:
    """Add ``improvement_pct`` over the best baseline's ``baseline_mae``; 0 when that is already 0."""
    base = F.col("baseline_mae")
    gain = F.when(base > 0, (base - F.col("mae")) / base * 100.0).otherwise(F.lit(0.0))
    joined = metrics.join(best_baseline, by) if by else metrics.withColumn(
        "baseline_mae", best_baseline.select("baseline_mae").scalar()
    )
    return joined.withColumn("improvement_pct", gain)
