from __future__ import annotations

import math
import random

import numpy as np
import pytest
from conftest import CAPACITY, frame, hour

from pyspark.sql import functions as F
from tidewell.contract import CAPACITY as CAP, FEATURES, LEVEL, TARGET, TANK
from tidewell.operators import baselines, metrics, recommend, regressors, reports
from tidewell.plans import flow

SMALL = regressors.ForestSize(trees=8, min_leaf=5, max_depth=8)


def seasons(n=260, tanks=2):
    rng = random.Random(5)
    rows = []
    for tank in range(tanks):
        level = 2500.0
        for i in range(n):
            rain = max(0.0, rng.gauss(-2, 3))
            inflow, usage = rain * 100.0, 60.0 + 30.0 * math.sin(i / 4.0) + rng.uniform(0, 10)
            level = min(CAPACITY, max(0.0, level + inflow - usage))
            t = hour(i)
            rows.append({"tank": tank, "t": t, "rain": rain, "inflow": inflow, "usage": usage, "level": level, "temp": 15.0 + 5 * math.sin(i / 24)})
    return rows


@pytest.fixture(scope="module")
def raw(spark):
    return frame(spark, seasons()).cache()


@pytest.fixture(scope="module")
def prepared(spark, raw):
    return flow.preprocess(spark, raw)


@pytest.fixture(scope="module")
def trained(prepared):
    return flow.train_and_evaluate(prepared.features, size=SMALL)


def pairs(spark, rows):
    return spark.createDataFrame([("m", CAPACITY, float(a), float(p)) for a, p in rows], "model string, tank_capacity_litres double, actual double, predicted double")


def test_metric_conventions(spark):
    score = lambda rows: metrics.regression_metrics(pairs(spark, rows), ["model"]).first()
    s = score([(1, 2), (3, 3), (5, 4)])
    assert (s["mae"], s["rmse"], s["r2"], s["n"]) == (pytest.approx(2 / 3), pytest.approx(math.sqrt(2 / 3)), pytest.approx(0.75), 3)
    assert score([(2, 2), (2, 2)])["r2"] == 1.0 and score([(2, 2), (2, 3)])["r2"] == 0.0
    assert score([(2, 5)])["r2"] is None


def test_r2_does_not_cancel_far_from_zero(spark):
    rows = [(1e9 + i, 1e9 + i + (-1) ** i * 0.5) for i in range(50)]
    a, p = (np.array(c) for c in zip(*rows))
    want = 1 - ((a - p) ** 2).sum() / ((a - a.mean()) ** 2).sum()
    assert metrics.regression_metrics(pairs(spark, rows), ["model"]).first()["r2"] == pytest.approx(want, rel=1e-9)


def test_warning_counts_and_zero_division(spark):
    w = metrics.overflow_warning_metrics(pairs(spark, [(4500, 4500), (4600, 10), (10, 4700), (10, 10)]), ["model"]).first()
    assert [w[c] for c in ("true_positives", "false_negatives", "false_positives", "true_negatives")] == [1, 1, 1, 1]
    assert w["precision"] == w["recall"] == w["f1"] == 0.5 and w["threshold_litres"] == 4500.0
    none = metrics.overflow_warning_metrics(pairs(spark, [(1, 1)]), ["model"]).first()
    assert none["precision"] == none["recall"] == none["f1"] == 0.0


def test_baseline_tie_goes_to_persistence(spark):
    df = spark.createDataFrame(
        [(0, 100.0, 0.0, 0.0, CAPACITY, 100.0)],
        f"{TANK} bigint, {LEVEL} double, inflow_litres double, usage_roll_mean_24 double, {CAP} double, {TARGET} double",
    )
    best = baselines.evaluate_baselines(df, []).filter("is_best").collect()
    assert [r["model"] for r in best] == ["persistence"]


def test_ridge_equals_the_normal_equations(prepared):
    pdf = prepared.features.select(*FEATURES, TARGET).toPandas().astype(float)
    x, y = pdf[FEATURES].to_numpy(), (pdf[TARGET] - pdf[LEVEL]).to_numpy()
    deviation = x.std(axis=0)
    z = (x - x.mean(axis=0)) / np.where(deviation > 0, deviation, 1.0)
    w = np.linalg.solve(z.T @ z + np.eye(z.shape[1]), z.T @ (y - y.mean()))
    want = z @ w + y.mean()
    model = regressors.ridge(prepared.features)
    got = np.array([r["raw"] for r in regressors.with_raw(model, prepared.features.select(*FEATURES)).select("raw").collect()])
    assert np.sort(got) == pytest.approx(np.sort(want), abs=1e-6)


def test_recombination_modes(spark):
    df = spark.createDataFrame([(100.0, CAPACITY, -300.0), (100.0, CAPACITY, 50.0), (4990.0, CAPACITY, 50.0)], f"{LEVEL} double, {CAP} double, raw double")
    raw = F.col("raw")
    got = df.select(regressors.recombine_prediction(raw), regressors.recombine_prediction(raw, "direct"), regressors.predicted_delta(raw), regressors.predicted_delta(raw, "direct")).collect()
    assert [tuple(r) for r in got] == [(0.0, 0.0, -300.0, -400.0), (150.0, 50.0, 50.0, -50.0), (5000.0, 50.0, 50.0, -4940.0)]


def test_forest_has_one_shape_at_every_size():
    size = regressors.ForestSize()
    assert (size.min_leaf, size.max_depth) == (20, 12)


def test_training_tables(trained):
    board = {r["model"]: r for r in trained.tables["leaderboard"].collect()}
    assert set(board) == {"persistence", "physics", "RandomForest", "Ridge"}
    winners = [m for m, r in board.items() if r["is_winner"]]
    assert winners == [trained.model_name]
    assert board[trained.model_name]["mae"] == min(board[m]["mae"] for m in regressors.MODELS)
    assert min(r["improvement_pct"] for r in board.values() if r["model"] in ("persistence", "physics")) <= 0.0
    modes = {r["mode"]: r["mae"] for r in trained.tables["target_mode"].collect()}
    assert modes["delta"] < modes["direct"]
    folds = trained.tables["cv"].collect()
    assert len(folds) == 5 and all(r["n"] > 0 for r in folds)
    assert regressors.cv_summary(trained.tables["cv"]).first()["mean_mae"] == pytest.approx(np.mean([r["mae"] for r in folds]))
    rows = {r["split"]: r for r in trained.tables["split"].collect()}
    assert rows["train"]["period_end"] < rows["test"]["period_start"]
    assert reports.top_features(trained.tables["importance"], "RandomForest").count() == 15


def test_predictions_stay_in_the_tank(trained):
    low, high = trained.tables["test_frame"].agg(F.min("pred"), F.max("pred")).first()
    assert 0.0 <= low and high <= CAPACITY


def test_bundle_is_reused_for_the_same_data_only(spark, raw, trained, tmp_path):
    path = str(tmp_path / "bundle")
    with pytest.raises(FileNotFoundError):
        flow.load_bundle(spark, path)
    flow.save_bundle(trained, path)
    again = flow.load_or_train(spark, raw, path, size=SMALL, run_cv=False)
    assert again.trained.loaded_from_disk and again.trained.model_name == trained.model_name
    shorter = raw.filter("ingest_seq < 240")
    other = flow.load_or_train(spark, shorter, path, size=SMALL, run_cv=False)
    assert not other.trained.loaded_from_disk
    third = flow.load_or_train(spark, shorter, path, size=SMALL, run_cv=False)
    assert third.trained.loaded_from_disk
    # both branches report the impact, and the same one
    told = [sorted(tuple(r) for r in o.impact.collect()) for o in (other, third)]
    assert told[0] and told[0] == told[1]
    # a version that lost a file is passed over: its data is trained anew, the older version still serves its own
    newest = max((tmp_path / "bundle" / "versions").iterdir(), key=lambda p: p.stat().st_mtime)
    next((newest / "tables" / "test_frame").glob("part-*")).unlink()
    assert flow.load_or_train(spark, raw, path, size=SMALL, run_cv=False).trained.loaded_from_disk
    assert not flow.load_or_train(spark, shorter, path, size=SMALL, run_cv=False).trained.loaded_from_disk


CURRENT = f"{TANK} bigint, {CAP} double, rainfall_mm double, inflow_litres double, usage_litres double, {LEVEL} double, temperature_c double"


def test_recommendation_uses_model_or_fallback_or_rejects(spark, prepared, trained):
    now = spark.createDataFrame([(0, CAPACITY, 0.0, 0.0, 45.0, 2600.0, 18.0), (1, CAPACITY, 0.0, 0.0, 45.0, 2600.0, 18.0), (2, CAPACITY, 0.0, 0.0, 45.0, -50.0, 18.0)], CURRENT)
    # A moving level, so that only the injected fault is one.
    history = prepared.clean.withColumn(LEVEL, F.lit(2000.0) + F.hour("timestamp") * 3.0)
    last = history.filter(F.col(TANK) == 1).agg(F.max("timestamp")).first()[0]
    faulty = history.withColumn(LEVEL, F.when((F.col(TANK) == 1) & (F.col("timestamp") == last), -100.0).otherwise(F.col(LEVEL)))
    model = trained.models[trained.model_name]
    got = {r[TANK]: r for r in recommend.recommend_next_hour(lambda df: regressors.predict_level(model, df), faulty, now).collect()}
    assert got[0]["used_fallback"] is False and got[0]["fallback_reason"] is None and 0 <= got[0]["predicted_level"] <= CAPACITY
    assert got[0]["banner"].startswith("Sensors healthy")
    usage = [r[0] for r in history.filter(F.col(TANK) == 1).orderBy(F.desc("timestamp")).limit(23).select("usage_litres").collect()]
    assert got[1]["used_fallback"] and got[1]["predicted_level"] == pytest.approx(2600.0 - (sum(usage) + 45.0) / 24)
    assert "negative" in got[1]["fallback_reason"] and "Sensor fault suspected" in got[1]["banner"]
    assert got[2]["predicted_level"] is None and got[2]["errors"] == ["Tank level cannot be negative (got -50.0 L)."]


def test_residual_histogram_keeps_every_row(spark):
    df = spark.createDataFrame([(float(v),) for v in [0.0, 24.0, 24.0, 12.0, 0.999, 1.0]], "error double")
    bins = reports.residual_histogram(df).orderBy("bin").collect()
    assert len(bins) == 24 and sum(r["errors"] for r in bins) == 6
    assert (bins[0]["errors"], bins[1]["errors"], bins[12]["errors"], bins[23]["errors"]) == (2, 1, 1, 2)
    flat = reports.residual_histogram(spark.createDataFrame([(5.0,)] * 3, "error double")).collect()
    assert sum(r["errors"] for r in flat) == 3


def test_sample_is_fixed_size_and_repeatable(prepared):
    first = reports.seeded_sample(prepared.features, 40, 7).select(TANK, "timestamp")
    again = reports.seeded_sample(prepared.features.repartition(3), 40, 7).select(TANK, "timestamp")
    other = reports.seeded_sample(prepared.features, 40, 8).select(TANK, "timestamp")
    assert first.distinct().count() == 40 and first.exceptAll(again).isEmpty() and not first.exceptAll(other).isEmpty()


def test_stands_are_one_forest(spark, prepared, monkeypatch, tmp_path):
    monkeypatch.setattr(regressors, "MANY_ROWS", 1)
    size = regressors.ForestSize(trees=11, min_leaf=5, max_depth=5)
    model = regressors.random_forest(prepared.features, size=size)
    forests = [s for s in model.stages if hasattr(s, "getNumTrees")]
    assert len(forests) == regressors.STANDS and sum(f.getNumTrees for f in forests) == 11
    level = lambda m: regressors.predict_level(m, prepared.features).select(TANK, "timestamp", "model_level")
    model.save(str(tmp_path / "m"))
    assert level(model).exceptAll(level(regressors.PipelineModel.load(str(tmp_path / "m")))).isEmpty()
    assert "raw" in regressors.with_raw(model, prepared.features).columns
    rows = regressors.predict_level(model, prepared.features)
    assert set(rows.columns) == {*prepared.features.columns, "model_level"}
    scored = model.transform(prepared.features.limit(20)).collect()
    for r in scored:
        trees = sum(f.getNumTrees * r[f.getPredictionCol()] for f in forests)
        assert r["raw"] == pytest.approx(trees / 11)
    assert sum(r[0] for r in regressors.feature_importance({"RandomForest": model}, spark).select("importance").collect()) == pytest.approx(1.0)


def test_cv_summary_query_has_its_folds(prepared, trained):
    from tidewell.catalog import queries
    from tidewell.catalog.lake import Lake

    lk = Lake(prepared.features.sparkSession, "/nowhere")
    lk.__dict__["features"] = prepared.features
    lk.__dict__["trained"] = flow.Trained(trained.models, regressors.RIDGE, {})
    got = queries.cv_summary(lk).first()
    assert got["splits"] == 5 and got["mean_mae"] > 0
    few = Lake(prepared.features.sparkSession, "/nowhere")
    few.__dict__["features"], few.__dict__["trained"] = prepared.features.limit(30).cache(), lk.trained
    assert queries.cv_summary(few).first()["splits"] == 0


def test_candidates_grow_as_deep_as_their_rows_allow(spark):
    # every split takes off the highest level that is left, so a tree is a chain
    rows = [(k * 100.0, 3.0**k) for k in range(36) for _ in range(60)]
    columns = [F.lit(0.0).alias(c) for c in FEATURES if c != LEVEL]
    train = spark.createDataFrame(rows, f"{LEVEL} double, gain double").select(LEVEL, *columns, (F.col(LEVEL) + F.col("gain")).alias(TARGET)).coalesce(1)
    model = regressors.make_models()[regressors.FOREST](train)
    stand = next(s for s in model.stages if hasattr(s, "getNumTrees"))
    assert stand.getNumTrees == 200
    deepest = 0
    for r in stand.trees.limit(5).collect():
        feature, left, n = (np.frombuffer(r[name], kind) for name, kind in (("feature", np.int16), ("left", np.int32), ("n", np.int64)))
        level = np.zeros(len(feature), int)
        for k in np.flatnonzero(feature >= 0):
            level[left[k] : left[k] + 2] = level[k] + 1
        deepest = max(deepest, level.max())
        assert n[feature < 0].min() >= 20
    assert deepest > 12
