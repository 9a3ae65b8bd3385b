from __future__ import annotations

import random

import pytest
from conftest import CAPACITY, by_time, frame, hour

from pyspark.sql import functions as F
from tidewell.contract import Layout
from tidewell.operators import balance, reports
from tidewell.plans.lake import stage_series
from tidewell.sources import readings
from tidewell.sources.readings import segment_frame

TEST_ROW = (
    "tank_id bigint, timestamp timestamp_ntz, tank_capacity_litres double, current_level double, inflow_litres double, "
    "usage_litres double, rain_roll_3 double, rain_roll_24 double, pred double"
)


def scored_rows(spark_session, rows, layout=Layout()):
    data = [(0, hour(i), CAPACITY, *map(float, r)) for i, r in enumerate(rows)]
    return stage_series(segment_frame(spark_session.createDataFrame(data, TEST_ROW), layout))




def impact(trajectory):
    summary = balance.balance_summary(trajectory)
    return balance.impact_comparison(summary).first(), {r["scenario"]: r for r in summary.collect()}


def test_storm_water_is_saved(spark):
    rows = scored_rows(spark, [(4800, 400, 50, 18, 60, 5000)] * 24)
    change, by = impact(balance.simulate(rows))
    assert by["no_controller"]["overflow_litres"] == pytest.approx(4800 + 24 * 350 - 5000)
    assert change["litres_saved_from_overflow"] > 0 and change["overflow_events_avoided"] >= 1
    assert change["overflow_reduction_pct"] == pytest.approx(100.0)
    assert change["test_hours"] == 24 and change["test_days"] == 1.0


def test_dry_spell_is_stretched(spark):
    change, by = impact(balance.simulate(scored_rows(spark, [(1000, 0, 60, 0, 0, 400)] * 20)))
    free, steered = by["no_controller"], by["with_controller"]
    assert steered["shortage_hours"] < free["shortage_hours"]
    assert change["unmet_demand_avoided_litres"] == pytest.approx(200.0)
    assert change["litres_conserved_by_restricting_demand"] == pytest.approx(20 * 24.0)
    assert steered["final_level"] > free["final_level"]


def by_the_hour(rows, controlled):
    """The definition, one hour after the other."""
    level, out = rows[0][0], []
    for _, inflow, demand, r3, r24, pred in rows:
        fill, wet = pred / CAPACITY * 100.0, r3 >= 4 or r24 >= 12
        action = "HARVEST"
        if controlled:
            if fill > 90 or (fill >= 75 and wet):
                action = "PREVENT_OVERFLOW"
            elif fill < 30:
                action = "CONSERVE"
            elif fill >= 55 and wet:
                action = "USE"
        need = demand * 0.6 if action == "CONSERVE" else demand
        have = level + inflow
        used = min(need, have)
        rest = have - used
        extra = min(700.0, max(0.0, rest - CAPACITY)) if action == "PREVENT_OVERFLOW" else 0.0
        spilt = max(0.0, rest - extra - CAPACITY)
        level = rest - extra - spilt
        out.append((action, level, spilt, extra, need - used, demand - need))
    return out


@pytest.mark.parametrize("segment_rows", [500_000, 13, 1])
def test_scan_equals_the_hourly_definition(spark, segment_rows):
    rng = random.Random(11)
    rows = [
        (
            rng.uniform(0, 5000), rng.choice((0, 0, rng.uniform(0, 3000))), rng.uniform(0, 900), rng.uniform(0, 8),
            rng.uniform(0, 20), rng.uniform(0, 5000),
        )
        for _ in range(150)
    ]
    moved = balance.simulate(scored_rows(spark, rows, Layout(segment_rows=segment_rows)))
    columns = ["action", "level", "overflow_litres", "extra_used_litres", "unmet_litres", "restricted_litres"]
    for scenario, controlled in (("no_controller", False), ("with_controller", True)):
        got = by_time(moved.filter(f"scenario = '{scenario}'"), *columns)
        want = by_the_hour(rows, controlled)
        assert [g[0] for g in got] == [w[0] for w in want]
        for g, w in zip(got, want, strict=True):
            assert g[1:] == pytest.approx(w[1:], abs=1e-8)


def runs_of(values):
    best = count = run = 0
    before = object()
    for v in values:
        run = run + 1 if v == before else 1
        before, best = v, max(best, run)
    spells = sum(1 for a, b in zip([False, *values[:-1]], values) if b and not a)
    return best, spells


@pytest.mark.parametrize("segment_rows", [500_000, 9, 1])
def test_runs_and_events_cross_segment_borders(spark, segment_rows):
    rng = random.Random(2)
    for p in (0.5, 0.93):
        value, values = False, []
        for _ in range(120):
            value = value if rng.random() < p else not value
            values.append(value)
        df = spark.createDataFrame([(0, hour(i), v) for i, v in enumerate(values)], "tank_id bigint, timestamp timestamp_ntz, f boolean")
        cut = segment_frame(df, Layout(segment_rows=segment_rows))
        longest, spells = runs_of(values)
        assert balance.longest_runs(cut, "f").first()["longest_run"] == longest
        assert balance.count_events(cut, {"n": "f"}, ["tank_id"]).first()["n"] == spells


def test_missing_values_are_skipped_by_runs(spark):
    df = spark.createDataFrame([(0, hour(i), v) for i, v in enumerate([1.0, None, 1.0, 1.0, 2.0])], "tank_id bigint, timestamp timestamp_ntz, v double")
    assert balance.longest_runs(segment_frame(df), "v").first()["longest_run"] == 3


def test_cumulative_overflow_ends_at_the_total(spark):
    rows = [(4800, 700, 50, 18, 60, 1000)] * 30
    moved = balance.simulate(scored_rows(spark, rows, Layout(segment_rows=7)))
    running = balance.cumulative_overflow(moved).filter("scenario = 'no_controller'")
    total = balance.balance_summary(moved).filter("scenario = 'no_controller'").first()["overflow_litres"]
    values = by_time(running, "cumulative_overflow_litres")
    assert values == sorted(values) and values[-1] == pytest.approx(total)


def test_scenarios_are_compared_without_moving_staged_rows(spark):
    rows = [
        {"t": hour(i), "tank": k, "level": 2500.0, "inflow": 40.0, "usage": 30.0, "rain": 0.0} for k in (0, 1) for i in range(30)
    ]
    base = readings.stage_readings(frame(spark, rows), Layout(segment_rows=10))
    scored = base.withColumns({"current_level": F.col("tank_level_litres"), "pred": F.col("tank_level_litres"), "rain_roll_3": F.lit(0.0), "rain_roll_24": F.lit(0.0)})
    trajectory = stage_series(balance.simulate(scored))
    compared = balance.trajectory_compare(trajectory)
    assert "Exchange" not in compared._jdf.queryExecution().executedPlan().toString()
    assert compared.count() == 60 and compared.columns == ["tank_id", "timestamp", "level_no_controller", "level_with_controller"]
    done = {(r["tank_id"], r["action"]): r["hours"] for r in balance.simulated_actions(trajectory).collect()}
    assert sum(done.values()) == 60 and balance.simulated_actions(trajectory.limit(0)).count() == 0


def test_missing_cells_count_nan_and_take_empty_frames(spark):
    df = spark.createDataFrame([(1.0, None), (float("nan"), None), (2.0, 3.0)], "a double, b double")
    assert tuple(reports.missing_cells(df, ["a", "b"]).first()) == (3, 2, 3, 2)
    assert tuple(reports.missing_cells(df.limit(0), ["a", "b"]).first()) == (0, 2, 0, 0)
