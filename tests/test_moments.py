"""Folds from additive moments against models fitted one by one."""

from __future__ import annotations

import numpy as np
import pytest
from conftest import frame, healthy_rows, hour

from tidewell.contract import FEATURES, LEVEL, TARGET, TS_US
from tidewell.operators import features, moments, regressors, split
from tidewell.plans.lake import stage_table
from tidewell.sources.readings import stage_readings


@pytest.fixture(scope="module")
def train(spark):
    rng = np.random.default_rng(5)
    rows = [r | {"tank": t, "usage": r["usage"] + float(rng.normal()), "level": r["level"] + float(rng.normal() * 20)}
            for t in (1, 2) for r in healthy_rows(150)]
    from conftest import hour
    for i, r in enumerate(rows):
        r["t"] = hour(i % 150)
    staged = stage_readings(frame(spark, rows))
    return stage_table(features.complete_cases(features.add_features(staged)))


def test_moments_are_those_of_the_rows(train):
    bounds = split.pooled_fold_bounds(train)
    found = moments.block_moments(train, moments.fold_of(train[TS_US], bounds))
    data = train.select(TS_US, *FEATURES, TARGET).toPandas()
    label = data[TARGET] - data[LEVEL]
    z = np.column_stack([np.ones(len(data)), data[FEATURES].astype(float), label])
    edges = [-np.inf, *(b for b, _ in bounds), bounds[-1][1]]
    for block, (low, high) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
        some = z[(data[TS_US] >= low) & (data[TS_US] < high)]
        assert np.allclose(found[block], some.T @ some, rtol=1e-9)


def test_every_fold_equals_a_model_fitted_on_its_past(train):
    bounds = split.pooled_fold_bounds(train)
    key = lambda df: sorted((r.fold, r.actual, round(r.predicted, 5)) for r in df.collect())
    alone = regressors.fold_errors(train, lambda past: regressors.ridge(past), bounds, TS_US)
    assert key(moments.ridge_fold_errors(train, bounds, TS_US)) == key(alone)


def test_solutions_leave_no_residual_and_constant_features_no_weight(train):
    bounds = split.pooled_fold_bounds(train)
    rows = moments.normal_equations(train, bounds, TS_US).collect()
    assert sorted(r.fold for r in rows) == [1, 2, 3, 4, 5] and all(abs(r.residual) < 1e-8 for r in rows)
    models = moments.ridge_folds(train, bounds, TS_US)
    assert [m.rows for m in models] == [r.train_rows for r in sorted(rows, key=lambda r: r.fold)]
    wrong = moments.ridge_folds(train, bounds, TS_US, alpha=50.0)
    assert max(abs(a.weights - b.weights).max() for a, b in zip(models, wrong, strict=True)) > 1e-6
