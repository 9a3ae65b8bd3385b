"""Ridge on every walk-forward fold from one pass: moments of time blocks add up to those of any fold's past.

The rows of each block leave a task as one small matrix, the sums of products of the constant one, the features and the
label. Matrices are added up in Spark, prefix sums of blocks give the training side of each fold, and each model is
one small system on the driver, whatever the number of rows. A second pass scores every fold's block with its own model.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tidewell.contract import FEATURES, TARGET
from tidewell.operators.regressors import delta_target, recombine_prediction

_WIDTH = len(FEATURES) + 2


@dataclass(frozen=True)
class FoldModel:
    """A linear model of the hourly change; ``scaled`` are its weights on features of unit deviation."""

    fold: int
    rows: int
    intercept: float
    weights: np.ndarray
    scaled: np.ndarray
    means: np.ndarray
    deviations: np.ndarray


def fold_of(time: Column, bounds: list[tuple[int, int]]) -> Column:
    """The fold whose block holds a moment, 0 before the first; NULL after the last."""
    fold = F.when(time < bounds[0][0], 0)
    for k, (_, end) in enumerate(bounds, start=1):
        fold = fold.when(time < end, k)
    return fold


def block_moments(train: DataFrame, block: Column) -> np.ndarray:
    """(blocks, width, width): sums of products of (1, features, label) per block; NULL blocks are left out."""
    rows = train.select(block.alias("block"), *[F.col(c).cast("double").alias(c) for c in FEATURES], delta_target().alias("label"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            z = np.ones((batch.num_rows, _WIDTH))
            for k, name in enumerate([*FEATURES, "label"], start=1):
                z[:, k] = batch.column(name).to_numpy(zero_copy_only=False)
            at = batch.column("block").to_numpy()
            for b in np.unique(at).tolist():
                some = z[at == b]
                total[b] = total.get(b, 0.0) + some.T @ some
        yield pa.RecordBatch.from_pydict({
            "block": pa.array(list(total), pa.int32()),
            "moments": pa.array([m.ravel() for m in total.values()], pa.list_(pa.float64())),
        })

    parts = rows.filter("block is not null").mapInArrow(run, "block int, moments array<double>")
    summed = parts.select("block", F.posexplode("moments").alias("k", "v")).groupBy("block", "k").agg(F.sum("v").alias("v"))
    found = summed.collect()  # as many numbers as there are blocks times the squared number of features
    out = np.zeros((max((r["block"] for r in found), default=0) + 1, _WIDTH * _WIDTH))
    for r in found:
        out[r["block"], r["k"]] = r["v"]
    return out.reshape(-1, _WIDTH, _WIDTH)


def solve(fold: int, moments: np.ndarray, alpha: float) -> FoldModel:
    """Ridge on features of unit population deviation; a feature that never changes has no weight."""
    n = moments[0, 0]
    mean = moments[0] / n
    spread = moments / n - np.outer(mean, mean)
    deviation = np.sqrt(np.maximum(np.diag(spread)[1:-1], 0.0))
    varies = deviation > 1e-9 * np.maximum(1.0, np.abs(mean[1:-1]))
    scale = np.where(varies, deviation, 1.0)
    gram = spread[1:-1, 1:-1] / np.outer(scale, scale) * np.outer(varies, varies)
    scaled = np.linalg.solve(gram + alpha / n * np.eye(len(scale)), spread[1:-1, -1] / scale * varies)
    weights = scaled / scale
    return FoldModel(fold, int(n), float(mean[-1] - weights @ mean[1:-1]), weights, scaled, mean[1:-1], scale)


def ridge_folds(train: DataFrame, bounds: list[tuple[int, int]], time_column: str, alpha: float = 1.0) -> list[FoldModel]:
    """One model per fold, each fitted on all blocks before its own."""
    past = np.cumsum(block_moments(train, fold_of(F.col(time_column), bounds)), axis=0)
    return [solve(k, past[min(k - 1, len(past) - 1)], alpha) for k in range(1, len(bounds) + 1)]


def raw_by_fold(models: list[FoldModel], fold: Column) -> Column:
    """The change that a fold's model predicts."""
    pick = lambda values: F.element_at(F.array(*(F.lit(float(v)) for v in values)), fold)
    total = pick([m.intercept for m in models])
    for k, name in enumerate(FEATURES):
        total = total + F.col(name).cast("double") * pick([m.weights[k] for m in models])
    return total


def ridge_fold_errors(train: DataFrame, bounds: list[tuple[int, int]], time_column: str, alpha: float = 1.0) -> DataFrame:
    """Validation errors of each fold, a row per (fold, reading), from one scan for the models and one for the scores."""
    models = ridge_folds(train, bounds, time_column, alpha)
    rows = train.withColumn("fold", fold_of(F.col(time_column), bounds)).filter("fold > 0")
    return rows.select(
        F.col("fold").cast("bigint").alias("fold"), F.col(TARGET).alias("actual"),
        recombine_prediction(raw_by_fold(models, F.col("fold"))).alias("predicted"),
    )


def normal_equations(train: DataFrame, bounds: list[tuple[int, int]], time_column: str, alpha: float = 1.0) -> DataFrame:
    """(fold, train_rows, valid_rows, residual): how far each model is from solving its penalised normal equations.

    Computed from the rows themselves, each in the past of the folds after its block: the largest
    ``|sum(x (y - prediction)) - alpha w| / n`` over the scaled features.
    """
    models = ridge_folds(train, bounds, time_column, alpha)
    folds = len(models)
    rows = train.withColumn("block", fold_of(F.col(time_column), bounds)).filter("block is not null")
    spread = rows.withColumn("fold", F.explode(F.sequence(F.greatest(F.col("block"), F.lit(1)), F.lit(folds))))
    past = F.col("block") < F.col("fold")
    pick = lambda values: F.element_at(F.array(*(F.lit(float(v)) for v in values)), F.col("fold"))
    rest = delta_target() - raw_by_fold(models, F.col("fold"))
    spread = spread.withColumn("rest", rest)
    sums = [
        F.sum(F.when(past, (F.col(name).cast("double") - pick([m.means[k] for m in models])) / pick([m.deviations[k] for m in models]) * F.col("rest"))).alias(f"s{k}")
        for k, name in enumerate(FEATURES)
    ]
    found = spread.groupBy("fold").agg(
        F.count_if(past).alias("train_rows"), F.count_if(F.col("block") == F.col("fold")).alias("valid_rows"), *sums
    )
    gaps = [F.abs(F.col(f"s{k}") - alpha * pick([m.scaled[k] for m in models])) for k in range(len(FEATURES))]
    return found.select(
        F.col("fold").cast("bigint").alias("fold"), "train_rows", "valid_rows",
        (F.greatest(*gaps) / F.col("train_rows")).alias("residual"),
    )
