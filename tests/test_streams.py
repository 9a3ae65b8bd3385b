from __future__ import annotations

import pytest
from conftest import CAPACITY, by_time, frame, healthy_rows, hour

from pyspark.sql import functions as F
from tidewell.operators import baselines, clean, recommend
from tidewell.sources.events import read_events, telemetry
from tidewell.sources.readings import stage_readings
from tidewell.streaming import jobs
from tidewell.streaming.replay import replay


def persistence(df):
    return df.withColumn("model_level", baselines.persistence_baseline())


def test_state_and_sink_survive_restarts(spark):
    rows = [r | {"tank": t} for t in (1, 2) for r in healthy_rows()]
    for i, r in enumerate(rows):
        r["t"] = hour(i % 48)
    df = frame(spark, rows)
    one = by_time(replay(df, "timestamp", lambda s: jobs.live_decisions(s, persistence), chunks=1), "used_fallback", "predicted_level", "action")
    many = by_time(replay(df, "timestamp", lambda s: jobs.live_decisions(s, persistence), chunks=4), "used_fallback", "predicted_level", "action")
    assert one == many and len(one) == 96
    assert one[0][0] and not one[1][0]


def test_last_streamed_decision_equals_the_batch_one(spark):
    df = frame(spark, healthy_rows())
    streamed = replay(df, "timestamp", lambda s: jobs.live_decisions(s, persistence)).orderBy("timestamp").collect()[-1]
    newest = df.filter("ingest_seq = 47").drop("timestamp", "ingest_seq")
    batch = recommend.recommend_next_hour(persistence, df.filter("ingest_seq < 47"), newest).first()
    assert streamed["predicted_level"] == batch["predicted_level"] and streamed["action"] == batch["action"]
    assert streamed["used_fallback"] == batch["used_fallback"]


def arriving(spark, order, hours=31):
    """Readings delivered in ``order``, a number of hours each; ``arrived`` is what a replay goes by."""
    rows = healthy_rows(hours)
    df = frame(spark, [rows[i] | {"t": hour(i), "seq": n} for n, i in enumerate(order)])
    return df.withColumn("arrived", F.make_timestamp_ntz(F.lit(2024), F.lit(1), F.lit(1), F.lit(0), F.col("ingest_seq").cast("int"), F.lit(0)))


JOBS = [
    (lambda s, d=None: jobs.running_balance(s, d), ("timestamp", "level", "overflow_litres")),
    (lambda s, d=None: jobs.live_decisions(s, persistence, delay=d), ("timestamp", "predicted_level", "used_fallback", "action")),
]


def outcomes(out):
    return {o: sorted(r[0] for r in out.filter(F.col("outcome") == o).select("timestamp").collect()) for o in ("taken", "late", "repeated")}


@pytest.mark.parametrize("job, columns", JOBS)
def test_late_and_repeated_readings_are_told_apart(spark, job, columns):
    out = replay(arriving(spark, [0, 1, 4, 2, 4, 3, 5]), "arrived", job, chunks=7)
    assert outcomes(out) == {
        "taken": [hour(i) for i in (0, 1, 4, 5)], "late": [hour(2), hour(3)], "repeated": [hour(4)],
    }
    missed = jobs.missed_readings(out).collect()
    assert [(r.tank_id, r.late, r.repeated) for r in missed] == [(0, 2, 1)]
    assert out.filter("outcome <> 'taken'").select(*columns[1:]).distinct().collect() == [(None,) * len(columns[1:])]


@pytest.mark.parametrize("job, columns", JOBS)
def test_readings_inside_the_delay_are_kept_in_order(spark, job, columns, chunks=4):
    rows = [r | {"tank": t, "t": hour(i)} for t in (1, 2) for i, r in enumerate(healthy_rows(24))]
    df = frame(spark, rows)
    six_hours = 6 * 3600 * 1_000_000
    plain = replay(df, "timestamp", lambda s: job(s), chunks=1)
    out = replay(df, "timestamp", lambda s: job(s, "7 hours"), chunks=chunks, closing_row=True, shuffled_us=six_hours)
    for row, wanted in zip(by_time(out, *columns), by_time(plain, *columns), strict=True):
        for x, y in zip(row, wanted, strict=True):
            assert x == pytest.approx(y, abs=1e-9) if isinstance(y, float) else x == y
    assert out.count() == 48 and out.filter("outcome <> 'taken'").count() == 0


@pytest.mark.parametrize("job, columns", JOBS)
def test_readings_behind_the_delay_are_counted(spark, job, columns):
    out = replay(arriving(spark, [0, 1, 9, 10, 2, 11, 30]), "arrived", lambda s: job(s, "0 seconds"), chunks=7)
    found = outcomes(out)
    assert found["taken"][:5] == [hour(i) for i in (0, 1, 9, 10, 11)] and found["late"] == [hour(2)]


@pytest.mark.parametrize("job, columns", JOBS)
def test_silent_tanks_are_drained_and_lost_ones_counted(spark, job, columns):
    rows = healthy_rows(40)
    # tank 1 stops after three hours; a copy and a late reading of it come when the others are far ahead
    sent = [(1, i) for i in range(3)] + [(2, i) for i in range(40)] + [(1, 1), (1, 2)]
    df = frame(spark, [rows[i] | {"tank": t, "t": hour(i), "seq": n} for n, (t, i) in enumerate(sent)])
    df = df.withColumn("arrived", F.make_timestamp_ntz(F.lit(2024), F.lit(1), F.lit(1), F.lit(0), F.col("ingest_seq").cast("int"), F.lit(0)))
    out = replay(df, "arrived", lambda s: job(s, "2 hours"), chunks=4)
    assert outcomes(out.filter("tank_id = 1")) == {"taken": [hour(0), hour(1), hour(2)], "late": [hour(1)], "repeated": [hour(2)]}


def test_missing_values_are_skipped_by_the_features(spark):
    rows = healthy_rows(30)
    for i in (3, 4, 11):
        rows[i] = {k: None for k in rows[i]}
    rows[20] = rows[20] | {"level": 7000.0}
    rows[25] = rows[25] | {"inflow": -1.0}
    out = replay(frame(spark, rows), "timestamp", lambda s: jobs.live_rows(s), chunks=3).orderBy("timestamp").collect()
    suspect = [r.fault for r in out]
    assert [i for i, f in enumerate(suspect) if f] == [0, *range(4, 20), *range(21, 30)]
    for i, r in enumerate(out):
        rain = [x["rain"] for x in rows[max(0, i - 2) : i + 1] if x["rain"] is not None]
        use = [x["usage"] for x in rows[max(0, i - 5) : i + 1] if x["usage"] is not None]
        assert r.rain_roll_3 == pytest.approx(sum(rain)) and r.usage_roll_mean_6 == pytest.approx(sum(use) / len(use))
        assert r.level_lag_2 == (rows[i - 2]["level"] if i >= 2 else None)


@pytest.mark.parametrize("flat, suspect", [(5, []), (7, [8, 9])])
def test_frozen_levels_are_suspect(spark, flat, suspect):
    rows = healthy_rows(14)
    for i in range(2, 2 + flat):
        rows[i] = rows[i] | {"level": 2500.0}
    out = replay(frame(spark, rows), "timestamp", lambda s: jobs.live_rows(s), chunks=2).orderBy("timestamp").collect()
    found = [i for i, r in enumerate(out) if r.fault and i]
    assert found[: len(suspect)] == suspect and bool(found) == bool(suspect)


def test_hours_stay_open_without_a_newer_event(spark):
    events = spark.createDataFrame(
        [(i, hour(i / 2), 7, "view", 10.0, "") for i in range(8)],
        "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    )
    still_open = replay(events, "ts", lambda s: jobs.hourly_rollup(s, "10 minutes"), chunks=2)
    closed = replay(events, "ts", lambda s: jobs.hourly_rollup(s, "10 minutes"), chunks=2, closing_row=True)
    assert by_time(closed, "events") == [2, 2, 2, 2]
    assert still_open.count() < 4


def test_rolled_up_hours_equal_the_batch_view(spark, tmp_path):
    kinds = ("view", "click", "purchase", "signup", "error")
    rows = [(i, hour(i / 7), i % 3, kinds[(i * i + i // 5) % 5], 10.0 + i / 4, "") for i in range(150)]
    spark.createDataFrame(
        rows, "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
    ).write.parquet(f"{tmp_path}/events.parquet")
    source = read_events(spark, str(tmp_path))
    out = replay(source, "ts", lambda s: jobs.hourly_rollup(s, "10 minutes"), closing_row=True)
    view = telemetry(spark, str(tmp_path))
    assert by_time(out, *view.columns) == by_time(view, *view.columns)
    assert out.filter("tank_level_litres is not null and temperature_c is not null").count()


def test_copies_arriving_later_are_dropped(spark):
    df = frame(spark, [{"t": hour(i // 2), "level": float(i)} for i in range(10)])
    out = replay(df, "timestamp", lambda s: jobs.dedupe(s, "1 hour"), chunks=3)
    assert by_time(out, "timestamp") == [hour(i) for i in range(5)]


def test_row_cleaning_matches_the_batch_flags(spark):
    rows = [{"level": v, "inflow": f, "usage": 40.0} for v, f in ((100.0, 1.0), (-5.0, 2.0), (CAPACITY + 1, None), (None, -3.0))]
    df = frame(spark, rows)
    stats = clean.tank_statistics(stage_readings(df))
    out = replay(df, "timestamp", lambda s: jobs.ingest_clean(s, stats), chunks=2)
    assert by_time(out, "tank_level_litres", "inflow_litres", "level_out_of_range") == [
        (100.0, 1.0, False), (None, 2.0, True), (None, 0.0, True), (None, 0.0, False),
    ]


@pytest.mark.parametrize("job, columns", JOBS)
def test_tanks_on_one_shelf_are_kept_apart(spark, job, columns, monkeypatch):
    """Many tanks, one without a number, share one key of the state; each is as if it were alone."""
    sent = [(t, i) for i in range(24) for t in (1, 2, 3, None) if (i + (t or 0)) % 3]
    rows = [healthy_rows(24)[i] | {"tank": t, "t": hour(i), "level": 2000.0 + 37.0 * ((t or 9) + i)} for t, i in sent]
    df = frame(spark, rows)
    six_hours = 6 * 3600 * 1_000_000
    run = lambda d: replay(d, "timestamp", lambda s: job(s, "7 hours"), chunks=3, closing_row=True, shuffled_us=six_hours)
    alone = [run(df.filter(F.col("tank_id").eqNullSafe(t))) for t in (1, 2)]
    monkeypatch.setattr(jobs, "SHELVES", 1)
    out = run(df)
    for t, own in zip((1, 2), alone, strict=True):
        assert by_time(out.filter(F.col("tank_id") == t), *columns) == by_time(own, *columns)
    assert out.filter("tank_id is null and outcome = 'taken'").count() == sum(t is None for t, _ in sent)
