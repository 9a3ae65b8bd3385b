from __future__ import annotations

import pytest
from conftest import CAPACITY, frame, healthy_rows

from pyspark.sql import functions as F
from tidewell.operators import rules
from tidewell.operators.baselines import physics_prediction


def decided(spark, points):
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(points)], "i int, fill double, r3 double, r24 double")
    args = (F.col("fill"), F.col("r3"), F.col("r24"))
    return df.select("i", rules.decide_action(*args).alias("a"), rules.decision_reason(*args).alias("why")).orderBy("i").collect()


POINTS = {
    (95.0, 0.0, 0.0): "PREVENT_OVERFLOW", (60.0, 0.0, 0.0): "HARVEST", (12.0, 0.0, 0.0): "CONSERVE",
    (80.0, 0.0, 0.0): "HARVEST", (80.0, 6.0, 30.0): "PREVENT_OVERFLOW", (65.0, 2.0, 20.0): "USE",
    (90.0, 0.0, 0.0): "HARVEST", (75.0, 4.0, 0.0): "PREVENT_OVERFLOW", (74.999, 4.0, 0.0): "USE",
    (55.0, 0.0, 12.0): "USE", (54.999, 9.0, 99.0): "HARVEST", (30.0, 9.0, 99.0): "HARVEST", (29.999, 9.0, 99.0): "CONSERVE",
    (80.0, None, None): "HARVEST", (None, 9.0, 99.0): "HARVEST", (75.0, 3.999, 11.999): "HARVEST",
}


def test_actions_at_points_and_boundaries(spark):
    assert [r["a"] for r in decided(spark, POINTS)] == list(POINTS.values())


def test_every_fill_yields_a_known_action(spark):
    acts = {r["a"] for r in decided(spark, [(float(f), r, 0.0) for f in range(100) for r in (0.0, 5.0)])}
    assert acts == {"PREVENT_OVERFLOW", "HARVEST", "USE", "CONSERVE"}


def test_reasons_round_half_to_even_and_name_the_trigger(spark):
    why = [r["why"] for r in decided(spark, [(92.5, 0.0, 0.0), (76.0, 4.25, 50.0), (76.0, 1.0, 50.0), (60.0, 5.0, 2.0), (None, 0.0, 0.0)])]
    assert why[0].startswith("Predicted level 92% of capacity - above the 90% spill line.")
    assert "4.2 mm in the last 3 h" in why[1] and "50.0 mm in the last 24 h" in why[2]
    assert why[3].startswith("60% full with 5.0 mm of incoming rain")
    assert why[4].startswith("Predicted level nan%")


READING = "level double, rain double, inflow double, usage double"


def problems(spark, *readings):
    df = spark.createDataFrame([tuple(map(lambda v: None if v is None else float(v), r)) for r in readings], READING)
    cols = [F.col(c) for c in ("level", "rain", "inflow", "usage")]
    return [r[0] for r in df.select(rules.validate_readings(*cols, F.lit(CAPACITY))).collect()]


def test_reading_validation(spark):
    got = problems(
        spark, (2500, 1, 100, 40), (5500, 1, 100, 40), (-10, 1, 100, 40), (float("nan"), -1, 100, 40), (2500, -2, -5, -3),
        (2500, 1, 90_000, 40), (2500, 101, 1, 10_001), (None, None, 1, float("inf")),
    )
    assert got[0] == []
    assert got[1] == ["Tank level 5500.0 L exceeds tank capacity 5000.0 L."]
    assert got[2] == ["Tank level cannot be negative (got -10.0 L)."]
    assert got[3] == ["Tank level must be a real number (got NaN/missing)."]
    assert len(got[4]) == 3 and got[4][0] == "Rainfall cannot be negative (got -2.00 mm)."
    assert got[5] == ["Inflow 90000 L/h is implausible (max 50,000 L/h)."]
    assert [p.split()[0] for p in got[6]] == ["Rainfall", "Usage"]
    assert [p.split(" must")[0] for p in got[7]] == ["Tank level", "Rainfall", "Usage"]


def test_level_validation(spark):
    df = spark.createDataFrame([(2500.0,), (-1.0,), (CAPACITY + 1,), (float("nan"),), (None,), (0.0,), (CAPACITY,)], "v double")
    got = df.select(rules.validate_level(F.col("v"), F.lit(CAPACITY)).alias("c")).select("c.ok").collect()
    assert [r[0] for r in got] == [True, False, False, False, False, True, True]


def check(spark, change=None, **kw):
    rows = healthy_rows()
    for i, level in (change or {}).items():
        rows[i]["level"] = level
    return rules.detect_sensor_fault(frame(spark, rows), **kw).first()


@pytest.mark.parametrize(
    "change, word",
    [
        ({-2: -320.0}, "1 negative level reading(s) (e.g. -320 L)"), ({-1: 5750.0}, "1 reading(s) above capacity (max 5750 L > 5000 L)"),
        ({-3: None}, "1 of the last 8 level readings are missing (NaN)"),
        ({-3: float("nan")}, "1 of the last 8 level readings are missing (NaN)"),
        ({i: 1234.0 for i in range(-8, 0)}, "sensor appears frozen: 8 identical readings in a row (1234 L)"),
        ({i: 5000.0 for i in range(-6, 0)}, "sensor appears frozen: 6 identical readings in a row (5000 L)"),
    ],
)
def test_each_fault_is_named(spark, change, word):
    found = check(spark, change)
    assert found["fault"] and found["message"] == word


def test_healthy_history_is_no_fault(spark):
    found = check(spark)
    assert not found["fault"] and found["reasons"] == [] and found["checked_rows"] == 8
    assert found["message"] == "Sensors look healthy."


def test_faults_older_than_the_window_are_forgotten(spark):
    assert not check(spark, {-9: -320.0})["fault"]


def test_missing_values_do_not_break_a_flat_run(spark):
    change = {-8: 7.0, -7: 7.0, -6: None, -5: 7.0, -4: 7.0, -3: 7.0, -2: 7.0}
    assert check(spark, change)["flatline_run"] == 6
    assert check(spark, {i: 7.0 for i in range(-5, 0)})["fault"] is False


def test_negative_inflow_is_a_fault(spark):
    rows = healthy_rows()
    rows[-1]["inflow"] = -1.0
    assert rules.detect_sensor_fault(frame(spark, rows)).first()["message"] == "1 negative inflow reading(s)"


def test_tank_without_history_is_a_fault(spark):
    tanks = spark.createDataFrame([(0,), (5,)], "tank_id bigint")
    found = {r["tank_id"]: r for r in rules.detect_sensor_fault(frame(spark, healthy_rows()), tanks).collect()}
    assert not found[0]["fault"]
    assert found[5]["fault"] and found[5]["message"] == "No recent history available to check." and found[5]["checked_rows"] == 0


def test_missing_level_column_is_a_fault(spark, healthy):
    found = rules.detect_sensor_fault(healthy.drop("tank_level_litres")).first()
    assert found["fault"] and "Column 'tank_level_litres' is missing" in found["message"] and found["checked_rows"] == 48


def test_physics_prediction_stays_in_the_tank(spark):
    df = spark.createDataFrame([(4900.0, 800.0, 10.0), (10.0, 0.0, 900.0)], "l double, i double, u double")
    got = df.select(physics_prediction(F.col("l"), F.col("i"), F.col("u"), F.lit(CAPACITY))).collect()
    assert [r[0] for r in got] == [CAPACITY, 0.0]
