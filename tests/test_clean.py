from __future__ import annotations

import random

import pytest
from conftest import CAPACITY, by_time, frame, healthy_rows, hour

from tidewell.contract import FLAGS, NUMERIC_COLUMNS, CleaningRules, Layout
from tidewell.operators import clean
from tidewell.operators.interpolate import time_interpolate
from tidewell.sources.readings import stage_readings


def flagged(spark, rows, **kw):
    return clean.flag_outliers(stage_readings(frame(spark, rows)), **kw)


def nine_rows():
    rain = [0, 0, 1, 0, -0.5, 0, 0, 2, 5]
    inflow = [0, 100, 100, 0, 0, 0, 0, 0, 0]
    usage = [40, 45, 50, 42, 44, 41, 43, 40, 99]
    level = [2500, -300, 2600, 5300, 2700, 2750, 2800, 5200, 2900]
    temp = [12, 12, None, 13, 14, 14, 15, 15, 16]
    hours = [0, 1, 2, 3, 4, 5, 6, 7, 0]
    return [
        {"t": hour(h), "rain": r, "inflow": i, "usage": u, "level": l, "temp": c}
        for h, r, i, u, l, c in zip(hours, rain, inflow, usage, level, temp)
    ]


def test_nine_row_day_is_repaired_and_reported(spark):
    raw = frame(spark, nine_rows())
    staged = stage_readings(raw)
    marks = clean.flag_outliers(staged)
    cleaned = clean.clean_telemetry(staged)
    report = clean.cleaning_report(raw, staged, marks).first()
    assert report["rows_raw"] == 9 and report["rows_clean"] == 8 and report["duplicate_rows_removed"] == 1
    assert report["level_negative_repaired"] == 1 and report["level_over_capacity_repaired"] == 2
    assert report["rainfall_negative_clipped"] == 1 and report["bad_timestamps_dropped"] == 0
    assert report["missing_before_temperature_c"] == 1
    assert report["missing_filled_tank_level_litres"] == report["level_values_repaired_total"]
    levels = by_time(cleaned, "tank_level_litres")
    assert all(0 <= v <= CAPACITY for v in levels)
    assert max(abs(a - b) for a, b in zip(levels, levels[1:])) < CAPACITY / 2
    assert min(by_time(cleaned, "rainfall_mm")) >= 0 and None not in by_time(cleaned, "temperature_c")


def test_empty_temperature_column_survives(spark):
    levels = [1000, 1050, None, 1150, 1200]
    raw = frame(spark, [{"rain": 0, "inflow": 0, "usage": 10, "level": v} for v in levels])
    staged = stage_readings(raw)
    cleaned = clean.clean_telemetry(staged)
    assert by_time(cleaned, "temperature_c") == [0.0] * 5
    assert by_time(cleaned, "tank_level_litres") == [1000, 1050, 1100, 1150, 1200]
    assert clean.cleaning_report(raw, staged, clean.flag_outliers(staged)).first()["missing_before_tank_level_litres"] == 1
    assert clean.missing_after(cleaned).first()["missing_after_temperature_c"] == 0


def test_in_range_spike_flags_itself_and_its_successor(spark):
    marks = flagged(spark, [{"level": v} for v in (1000, 1010, 3000, 1020, 1030)])
    assert by_time(marks, "level_jump") == [False, False, True, True, False]
    assert by_time(clean.null_out_outliers(marks), "tank_level_litres") == [1000, 1010, None, None, 1030]


def test_jump_limit_is_strict_and_row_based(spark):
    rows = [{"t": hour(h), "level": v} for h, v in ((0, 1000), (1, 2500), (50, 4001))]
    assert by_time(flagged(spark, rows), "level_jump") == [False, False, True]
    loose = CleaningRules(max_level_jump_litres=2000.0)
    assert by_time(flagged(spark, rows, rules=loose), "level_jump") == [False] * 3


def test_missing_or_masked_neighbour_is_no_jump(spark):
    marks = flagged(spark, [{"level": v} for v in (1000, None, 4000, -5, 1000)])
    assert by_time(marks, "level_was_outlier") == [False, False, False, True, False]


def test_capacity_argument_median_and_default(spark):
    for caps, given, expected in (
        ([4000, 4000, 6000], None, 4000.0), ([0, 0, 0], None, CAPACITY), ([None] * 3, None, CAPACITY),
        ([-1, -1, -1], None, CAPACITY), ([4000] * 3, 800.0, 800.0),
    ):
        staged = stage_readings(frame(spark, [{"level": 1, "cap": c} for c in caps]))
        assert clean.tank_statistics(staged, given).first()["capacity_value"] == expected


def test_few_positive_inflows_flag_nothing(spark):
    marks = flagged(spark, [{"inflow": v} for v in [1.0] * 8 + [9000.0]])
    assert not any(by_time(marks, "inflow_was_outlier"))
    assert marks.first()["inflow_fence"] == 9000.0


def test_flat_positive_inflows_use_the_99th_percentile(spark):
    marks = flagged(spark, [{"inflow": v} for v in [50.0] * 200 + [900.0]])
    assert marks.first()["inflow_fence"] == pytest.approx(50.0)
    assert sum(by_time(marks, "inflow_was_outlier")) == 1


def test_inflow_fence_ignores_zero_hours(spark):
    marks = flagged(spark, [{"inflow": v} for v in [0.0] * 300 + [float(v) for v in range(100, 120)] + [5000.0]])
    assert sum(by_time(marks, "inflow_was_outlier")) == 1


def test_usage_zscore_needs_spread_and_flags_high_side_only(spark):
    flat = flagged(spark, [{"usage": 40.0}] * 50)
    assert not any(by_time(flat, "usage_was_outlier"))
    two = flagged(spark, [{"usage": 1.0}, {"usage": 9000.0}])
    assert not any(by_time(two, "usage_was_outlier"))
    low = flagged(spark, [{"usage": 1000.0}] * 60 + [{"usage": 0.0}])
    assert not any(by_time(low, "usage_was_outlier"))
    high = flagged(spark, [{"usage": 40.0 + i % 5} for i in range(60)] + [{"usage": 4000.0}])
    assert by_time(high, "usage_was_outlier") == [False] * 60 + [True]


def test_blank_inflow_is_zero_and_a_spike_is_interpolated(spark):
    values = [20.0 + i % 3 for i in range(20)] + [None, 9000.0, 25.0]
    cleaned = clean.clean_telemetry(stage_readings(frame(spark, [{"inflow": v} for v in values])))
    assert by_time(cleaned, "inflow_litres")[-3:] == [0.0, 12.5, 25.0]


def test_interpolation_uses_elapsed_time(spark):
    rows = [{"t": hour(h), "level": v} for h, v in zip((0, 1, 2, 5, 6, 9), (None, 1, None, None, 4, None))]
    filled = time_interpolate(stage_readings(frame(spark, rows)), ["tank_level_litres"])
    assert by_time(filled, "tank_level_litres") == pytest.approx([1, 1, 1.6, 3.4, 4, 4])


def test_row_order_does_not_matter(spark):
    rows = nine_rows()
    for i, r in enumerate(rows):
        r["seq"] = i
    first = by_time(clean.clean_telemetry(stage_readings(frame(spark, rows))), *NUMERIC_COLUMNS, *FLAGS)
    random.Random(4).shuffle(rows)
    assert by_time(clean.clean_telemetry(stage_readings(frame(spark, rows))), *NUMERIC_COLUMNS, *FLAGS) == first


def test_another_tank_changes_nothing(spark):
    own = by_time(clean.clean_telemetry(stage_readings(frame(spark, nine_rows()))), *NUMERIC_COLUMNS)
    other = [r | {"tank": 9, "cap": 100.0} for r in healthy_rows()]
    both = clean.clean_telemetry(stage_readings(frame(spark, nine_rows() + other)))
    assert by_time(both.filter("tank_id = 0"), *NUMERIC_COLUMNS) == own


@pytest.mark.parametrize("segment_rows", [1, 7, 20])
def test_segment_size_does_not_change_the_result(spark, segment_rows):
    rng = random.Random(7)
    pick = lambda f: None if rng.random() < 0.3 else f()
    rows = [
        {
            "t": hour(i * rng.choice((1, 1, 2)) + i), "level": pick(lambda: rng.uniform(-300, 5600)),
            "usage": pick(lambda: rng.choice((40.0, 50.0, 60.0, 900.0))), "inflow": pick(lambda: rng.expovariate(0.01)),
            "rain": pick(lambda: rng.uniform(-1, 4)), "temp": pick(lambda: rng.uniform(5, 30)), "seq": i,
        }
        for i in range(90)
    ]
    columns = [*NUMERIC_COLUMNS, *FLAGS]
    raw = frame(spark, rows)
    whole = by_time(clean.clean_telemetry(stage_readings(raw)), *columns)
    cut = stage_readings(raw, Layout(segment_rows=segment_rows))
    assert cut.select("segment").distinct().count() > 3
    parts = by_time(clean.clean_telemetry(cut), *columns)
    assert [r[:6] for r in parts] == [pytest.approx(r[:6]) for r in whole]
    assert [r[6:] for r in parts] == [r[6:] for r in whole]
