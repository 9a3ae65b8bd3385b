from __future__ import annotations

import random

import numpy as np
import pytest
from conftest import frame, hour

from pyspark.sql import functions as F
from tidewell.contract import Layout
from tidewell.functions.quantiles import exact_quantiles, order_statistics
from tidewell.plans.lake import stage_series
from tidewell.sources.readings import segment_frame, stage_readings


def test_short_tanks_stay_whole_and_long_ones_are_cut(spark):
    rows = [{"tank": 1, "t": hour(i), "level": 1} for i in range(500)] + [{"tank": 2, "t": hour(i)} for i in range(20)]
    staged = stage_readings(frame(spark, rows), Layout(segment_rows=50))
    sizes = {(r["tank_id"], r["segment"]): r["count"] for r in staged.groupBy("tank_id", "segment").count().collect()}
    assert sizes[(2, 0)] == 20 and sum(1 for k in sizes if k[0] == 2) == 1
    assert max(v for k, v in sizes.items() if k[0] == 1) <= 50 + 50 // 8 + 1


def test_bursts_get_their_own_segments(spark):
    # A third of all rows within two seconds of a ten-year history.
    dense = [{"t": hour(5000 + i / 900_000), "level": 1} for i in range(500)]
    sparse = [{"t": hour(i * 90), "level": 1} for i in range(1000)]
    staged = stage_readings(frame(spark, dense + sparse), Layout(segment_rows=100))
    spans = staged.groupBy("segment").agg(F.count("*").alias("n"), F.min("ts_us").alias("a"), F.max("ts_us").alias("b"))
    spans = spans.orderBy("segment").collect()
    assert sum(s["n"] for s in spans) == 1500 and max(s["n"] for s in spans) <= 200
    assert all(x["b"] < y["a"] for x, y in zip(spans, spans[1:]))


def test_segments_follow_time(spark):
    rows = [{"t": hour(i), "level": 1} for i in range(300)]
    staged = stage_readings(frame(spark, rows), Layout(segment_rows=30))
    spans = staged.groupBy("segment").agg(F.min("ts_us").alias("a"), F.max("ts_us").alias("b")).orderBy("segment").collect()
    assert all(x["b"] < y["a"] for x, y in zip(spans, spans[1:]))


def test_one_timestamp_with_very_many_copies(spark):
    copies = spark.range(20000).selectExpr(
        "cast(0 as bigint) tank_id", "timestamp_ntz'2024-01-01 00:00:00' timestamp", "0D rainfall_mm", "0D inflow_litres",
        "0D usage_litres", "cast(id as double) tank_level_litres", "id ingest_seq",
    )
    staged = stage_readings(copies, Layout(segment_rows=100))
    assert [r["tank_level_litres"] for r in staged.collect()] == [0.0]


def test_staged_series_is_read_without_another_shuffle(spark):
    rows = [{"tank": i % 5, "t": hour(i), "level": 1} for i in range(200)]
    staged = stage_series(segment_frame(frame(spark, rows)))
    from tidewell.plans.segments import in_segment

    plan = staged.withColumn("x", F.lag("tank_level_litres").over(in_segment()))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in text and "Bucketed: true" in text


CASES = {
    "uniform": lambda r: [r.uniform(-50, 50) for _ in range(400)],
    "heavy ties": lambda r: [r.choice((0.0, 0.0, 0.0, 1.0, 2.5)) for _ in range(300)],
    "powers of two": lambda r: [s * 2.0**k for k in range(-40, 40) for s in (1, -1, 0.999999999999, 1.000000000001)],
    "one value": lambda r: [3.25] * 17,
    "single": lambda r: [9.0],
    "huge span": lambda r: [10.0 ** r.uniform(-12, 12) for _ in range(200)],
    "far from zero": lambda r: [1.7e15 + r.randrange(10**9) for _ in range(300)],
}


@pytest.fixture(scope="module")
def samples():
    rng = random.Random(3)
    return {name: [float(v) for v in make(rng)] for name, make in CASES.items()}


def test_exact_quantiles_match_numpy(spark, samples):
    df = spark.createDataFrame([(k, v) for k, vs in samples.items() for v in vs], "g string, value double").repartition(5)
    ps = {"p0": 0.0, "p25": 0.25, "p50": 0.5, "p95": 0.95, "p100": 1.0}
    for row in exact_quantiles(df, ["g"], ps).collect():
        want = np.quantile(samples[row["g"]], list(ps.values()))
        assert [row[p] for p in ps] == pytest.approx(list(want), rel=1e-12), row["g"]


def test_order_statistics_are_exact_at_every_rank(spark, samples):
    df = spark.createDataFrame([(k, v) for k, vs in samples.items() for v in vs], "g string, value double")
    ranks = spark.createDataFrame([(k, "r", i) for k, vs in samples.items() for i in range(len(vs))], "g string, rank_name string, rank bigint")
    got = {(r["g"], r["rank"]): r["value"] for r in order_statistics(df, ["g"], ranks).collect()}
    assert got == {(k, i): v for k, vs in samples.items() for i, v in enumerate(sorted(vs))}


def test_order_statistics_take_infinities_and_subnormals(spark):
    inf = float("inf")
    values = [inf, inf, -inf, 5e-324, -5e-324, 1e-310, 2.2250738585072014e-308, 1.7976931348623157e308, -1.7976931348623157e308,
              8.98846567431158e307, 0.0, 1.0, 0.9999999999999999, -1.0]
    df = spark.createDataFrame([("g", v) for v in values], "g string, value double")
    ranks = spark.createDataFrame([("g", "r", i) for i in range(len(values))], "g string, rank_name string, rank bigint")
    got = {r["rank"]: r["value"] for r in order_statistics(df, ["g"], ranks).collect()}
    assert got == dict(enumerate(sorted(values)))
    assert exact_quantiles(df, ["g"], {"p100": 1.0, "p0": 0.0}).first()["p100"] == inf


def test_text_tank_ids_and_infinities_do_not_depend_on_the_cut(spark):
    from tidewell.operators import balance, clean

    rows = [{"t": hour(i), "level": 2500.0 + i % 9, "inflow": float(i % 7 * 40), "usage": 50.0 + i % 3, "rain": 0.0} for i in range(400)]
    rows[200]["inflow"] = float("inf")
    raw = frame(spark, rows).withColumn("tank_id", F.lit("north"))

    def run(layout):
        staged = stage_readings(raw, layout)
        flagged = clean.flag_outliers(staged)
        cleaned = stage_series(clean.clean_segments(flagged))
        level = balance.clamped_balance(cleaned)
        return [sorted(map(str, x.drop("segment", "is_hot").collect())) for x in (cleaned, level)]

    assert run(Layout(segment_rows=50)) == run(Layout())


def test_last_rows_are_limited_before_the_shuffle(spark):
    from tidewell.operators.features import latest_rows

    rows = [{"tank": i % 3, "t": hour(i), "level": float(i)} for i in range(60)]
    staged = stage_readings(frame(spark, rows))
    newest = latest_rows(staged, 2)
    assert sorted(r["tank_level_litres"] for r in newest.collect()) == [54.0, 55.0, 56.0, 57.0, 58.0, 59.0]
    plan = newest._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and plan.rindex("WindowGroupLimit") > plan.index("Exchange")
