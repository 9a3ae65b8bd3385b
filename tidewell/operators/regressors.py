"""Next-hour level regressors on Spark ML, trained on the hourly change and pooled over all tanks."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import SQLTransformer, StandardScaler, VectorAssembler
from pyspark.ml.regression import (
    LinearRegression, LinearRegressionModel, RandomForestRegressionModel, RandomForestRegressor,
)
from pyspark.sql import Column, DataFrame, functions as F

from tidewell.contract import CAPACITY, FEATURES, LEVEL, TARGET
from tidewell.functions.scalars import clip
from tidewell.operators.forest import Stand, plant

FOREST, RIDGE = "RandomForest", "Ridge"
#: Candidates in tie-breaking order. Fixed values.
MODELS = [FOREST, RIDGE]
SEED = 42
DELTA, DIRECT = "delta", "direct"
#: Rows from which a forest of bounded depth is grown in tasks of its own, and the stages that keep its trees.
MANY_ROWS = 20_000
STANDS = 1


@dataclass(frozen=True)
class ForestSize:
    """Forest shape, the same for any number of rows.

    ``max_depth`` bounds a tree to 2^12 leaves; None lets trees grow for as long as leaves keep ``min_leaf`` rows.
    """

    trees: int = 200
    min_leaf: int = 20
    max_depth: int | None = 12
    max_bins: int = 32


#: The forest of the candidates: its trees are as deep as their rows allow.
WHOLE = ForestSize(max_depth=None)


def delta_target() -> Column:
    """The hourly change the models are fitted on."""
    return F.col(TARGET) - F.col(LEVEL)


def recombine_prediction(raw: Column, mode: str = DELTA) -> Column:
    """Predicted level within the tank: the change on top of the current level, or the level itself."""
    level = F.col(LEVEL) + raw if mode == DELTA else raw
    return clip(level, 0.0, F.col(CAPACITY))


def predicted_delta(raw: Column, mode: str = DELTA) -> Column:
    """Predicted hourly change for either kind of model."""
    return raw if mode == DELTA else raw - F.col(LEVEL)


def training_rows(df: DataFrame, mode: str = DELTA) -> DataFrame:
    """Features as doubles plus ``label``."""
    label = delta_target() if mode == DELTA else F.col(TARGET)
    return df.select(*[F.col(c).cast("double").alias(c) for c in FEATURES], label.alias("label"))


def random_forest(
    train: DataFrame, seed: int = SEED, size: ForestSize = WHOLE, mode: str = DELTA, rows: int | None = None
) -> PipelineModel:
    """Forest over all features per split.

    Spark ML's forest adds up statistics of every open node over all tasks and ends at 30 levels. From ``MANY_ROWS`` on, and
    where no depth is given, the lower branches are grown where their rows are (:mod:`tidewell.operators.forest`), and the
    trees are kept in ``STANDS`` stages; the forest answers with the mean of all trees.
    """
    data = training_rows(train, mode)
    rows = data.count() if rows is None else rows
    assembler = VectorAssembler(inputCols=FEATURES, outputCol="features")
    if rows < MANY_ROWS and size.max_depth is not None:
        return Pipeline(stages=[assembler, _forest(seed, size, size.trees, "raw")]).fit(data)
    grown = plant(data, FEATURES, size.trees, seed, size.min_leaf, size.max_depth, size.max_bins)
    stands = min(STANDS, size.trees)
    parts = [Stand(grown.filter(F.col("tree") % stands == k), f"{_STAND}{k}") for k in range(stands)]
    fitted = [s for s in parts if s.getNumTrees]  # a tree that draws none of a few rows is not there
    total = " + ".join(f"{s.getNumTrees} * {s.getPredictionCol()}" for s in fitted)
    mean = SQLTransformer(statement=f"SELECT *, ({total}) / {sum(s.getNumTrees for s in fitted)} AS raw FROM __THIS__")
    return PipelineModel([assembler, *fitted, mean])


def _forest(seed: int, size: ForestSize, trees: int, output: str) -> RandomForestRegressor:
    return RandomForestRegressor(
        featuresCol="features", labelCol="label", predictionCol=output, numTrees=trees, seed=seed,
        maxDepth=size.max_depth, maxBins=size.max_bins, minInstancesPerNode=size.min_leaf,
        featureSubsetStrategy="all", maxMemoryInMB=512, cacheNodeIds=True,
    )


def ridge(
    train: DataFrame, alpha: float = 1.0, mode: str = DELTA, rows: int | None = None
) -> PipelineModel:
    """Ridge on standardised features in closed form (one pass for the Gram matrix).

    Spark divides the label by its deviation inside the solver and scales features by the sample deviation;
    both are undone in ``regParam``, so the penalty is ``alpha`` on features of unit population deviation.
    """
    data = training_rows(train, mode)
    n, deviation = data.agg(F.count("*"), F.stddev_pop("label")).first()
    n = rows or n
    penalty = alpha * (deviation or 0.0) / n * (n - 1) / n
    stages = [
        VectorAssembler(inputCols=FEATURES, outputCol="plain"),
        StandardScaler(inputCol="plain", outputCol="features", withMean=True, withStd=True),
        LinearRegression(
            featuresCol="features", labelCol="label", predictionCol="raw", solver="normal",
            regParam=penalty, elasticNetParam=0.0, standardization=False,
        ),
    ]
    return Pipeline(stages=stages).fit(data)


def make_models(seed: int = SEED, size: ForestSize = WHOLE) -> dict[str, Callable]:
    """Fitting functions of the candidates, by name."""
    return {
        FOREST: lambda train, mode=DELTA, rows=None: random_forest(train, seed, size, mode, rows),
        RIDGE: lambda train, mode=DELTA, rows=None: ridge(train, mode=mode, rows=rows),
    }


#: Begins the column names of a forest's stands.
_STAND = "raw_of_stand_"
_ML_COLUMNS = ["features", "plain", "raw"]


def predict_level(model: PipelineModel, df: DataFrame, output: str = "model_level", mode: str = DELTA) -> DataFrame:
    """Add the predicted next level."""
    return with_raw(model, df).withColumn(output, recombine_prediction(F.col("raw"), mode)).drop(*_ML_COLUMNS)


def with_raw(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Add the model's raw output."""
    scored = model.transform(df)
    return scored.drop(*[c for c in scored.columns if c.startswith(_STAND)])


def feature_importance(models: dict[str, PipelineModel], spark) -> DataFrame:
    """Forest importances, or absolute coefficients on standardised features: a row per (model, feature)."""
    rows = []
    for name, model in models.items():
        last = model.stages[-1]
        stands = [s for s in model.stages if isinstance(s, Stand)]
        if stands:
            trees = sum(s.getNumTrees for s in stands)
            values = sum(s.importances(len(FEATURES)) * s.getNumTrees for s in stands) / trees
        elif isinstance(last, RandomForestRegressionModel):
            values = last.featureImportances.toArray()
        elif isinstance(last, LinearRegressionModel):
            values = abs(last.coefficients.toArray())
        else:
            values = [0.0] * len(FEATURES)
        rows += [(name, f, float(v)) for f, v in zip(FEATURES, values)]
    return spark.createDataFrame(rows, "model string, feature string, importance double")


def fold_errors(
    train: DataFrame, fit: Callable, bounds: list[tuple[int, int]], time_column: str
) -> DataFrame:
    """Validation errors of each walk-forward fold, a row per (fold, reading)."""
    scored = []
    for fold, (begin, end) in enumerate(bounds, start=1):
        past = train.filter(F.col(time_column) < begin)
        ahead = train.filter((F.col(time_column) >= begin) & (F.col(time_column) < end))
        model = fit(past)
        scored.append(
            predict_level(model, ahead, "predicted").select(
                F.lit(fold).cast("bigint").alias("fold"), F.col(TARGET).alias("actual"), "predicted"
            )
        )
    return reduce(DataFrame.unionByName, scored)


def cv_summary(folds: DataFrame) -> DataFrame:
    """Mean and population deviation of the fold errors."""
    return folds.agg(
        F.avg("mae").alias("mean_mae"), F.stddev_pop("mae").alias("std_mae"), F.count("*").alias("splits")
    )
