"""Staged tables of one data folder, built once per session and shared by the catalogued queries."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidewell.contract import CAPACITY, LEVEL, TANK, TIME, Layout
from tidewell.operators import balance, baselines, clean, features, regressors, split
from tidewell.operators.features import latest_rows
from tidewell.plans import flow
from tidewell.plans.lake import stage_series
from tidewell.sources import events, readings

#: Segment size of the single-series queries; small so that a few thousand rows already span many segments.
LONG_SERIES = Layout(segment_rows=1000)


class Lake:
    """Bronze, silver and gold tables of the telemetry in ``sf_dir``."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    @property
    def raw(self) -> DataFrame:
        return events.telemetry(self.spark, self.sf_dir)

    @cached_property
    def staged(self) -> DataFrame:
        return readings.stage_readings(self.raw)

    @cached_property
    def flagged(self) -> DataFrame:
        return stage_series(clean.flag_outliers(self.staged))

    @cached_property
    def clean(self) -> DataFrame:
        return stage_series(clean.clean_segments(self.flagged))

    @property
    def featured(self) -> DataFrame:
        return features.add_features(self.clean)

    @cached_property
    def features(self) -> DataFrame:
        return stage_series(features.complete_cases(self.featured))

    @property
    def report(self) -> DataFrame:
        report = clean.cleaning_report(self.raw, self.staged, self.flagged)
        return report.join(clean.missing_after(self.clean), TANK)

    @property
    def split(self) -> DataFrame:
        return split.chronological_split(self.features)

    @cached_property
    def scored(self) -> DataFrame:
        """Test rows of every tank scored by both baselines; the physics balance is the chosen one."""
        test = self.split.filter(F.col("split") == "test").drop("split", "row_index", "tank_rows")
        return stage_series(
            flow.scored_test_frame(baselines.baseline_predictions(test), baselines.BASELINES, "physics")
        )

    @cached_property
    def trajectory(self) -> DataFrame:
        return stage_series(balance.simulate(self.scored))

    @property
    def summary(self) -> DataFrame:
        return balance.balance_summary(self.trajectory)

    @property
    def current(self) -> DataFrame:
        """Each tank's newest reading: the recorded level where there is one, repaired meters otherwise."""
        newest = latest_rows(self.clean, 1)
        recorded = self.staged.select(TANK, TIME, F.col(LEVEL).alias("recorded"))
        return newest.join(recorded, [TANK, TIME]).select(
            TANK, CAPACITY, "rainfall_mm", "inflow_litres", "usage_litres", "temperature_c",
            F.coalesce("recorded", F.col(LEVEL)).alias(LEVEL),
        )

    @cached_property
    def trained(self) -> flow.Trained:
        return flow.train_and_evaluate(self.features, run_cv=False)

    @cached_property
    def folds(self) -> DataFrame:
        """Fold errors of the model that won on the test window; no row when there are too few readings for folds."""
        train = split.pooled_split(self.features).filter(F.col("split") == "train").drop("split")
        best = self.trained.model_name
        found = flow.cross_validate(train, best, regressors.make_models()[best])
        if found is None:
            return self.spark.createDataFrame([], "model string, fold bigint, mae double, n bigint")
        return found

    # one tank holding every event
    @property
    def long_raw(self) -> DataFrame:
        return events.one_long_series(self.spark, self.sf_dir)

    @cached_property
    def long_staged(self) -> DataFrame:
        return readings.stage_readings(self.long_raw, LONG_SERIES)

    @cached_property
    def long_clean(self) -> DataFrame:
        return stage_series(clean.clean_segments(clean.flag_outliers(self.long_staged)))


_open: dict[tuple[str, str], Lake] = {}


def lake(spark: SparkSession, sf_dir: str) -> Lake:
    """The shared lake of this session and folder."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _open:
        _open[key] = Lake(spark, sf_dir)
    return _open[key]
