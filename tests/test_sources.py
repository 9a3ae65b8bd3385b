from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from conftest import by_time, frame, hour

from pyspark.sql import functions as F
from tidewell.contract import REQUIRED_COLUMNS, DataValidationError
from tidewell.functions.scalars import from_micros, micros, to_number, truncate_hour
from tidewell.sources import readings, times


def test_missing_columns_are_listed_in_required_order(spark):
    df = spark.createDataFrame([("x", 0.0)], "timestamp string, rainfall_mm double")
    assert readings.missing_columns(df) == ["inflow_litres", "usage_litres", "tank_level_litres"]


def test_missing_column_error_names_missing_required_and_found(healthy):
    with pytest.raises(DataValidationError) as error:
        readings.load_readings(healthy.sparkSession, healthy.drop("tank_level_litres"))
    text = str(error.value)
    assert "lack tank_level_litres;" in text and "rainfall_mm" in text.split("the frame has")[1]


FILES = {
    "year_first": ["2024-04-09 13:00:00", "2024/4/9 13:00", "2024-04-09T15:00:00+02:00", "2024-04-09T13:00:00Z", "2024-04-09 08:30:00.000-0430", "2024-13-09", "4/9/2024 13:00"],
    "month_first": ["04/09/2024 13:00", "4/9/2024 1:00 PM", "4-9-2024, 1:00:00 p.m.", "12/25/2024", "12/25/2024 0:00", "13/04/2024 10:00", "soon"],
    "day_first": ["09.04.2024 13:00", "9/4/2024 01:00 pm", "25/12/2024", "25.12.2024", "12/25/2024", None],
    "month_name": ["Apr 9, 2024 13:00", "April 9 2024 1:00PM", "Foo 9 2024", "Apr 9, 2024 13:00 PM"],
    "day_name": ["9 Apr 2024 13:00", "09-APR-2024 13:00:00", "31 Feb 2024"],
    "compact": ["20240409T130000", "202404091300", "20240409", "20241309"],
    "epoch": ["1712667600", "1712667600000", "1712667600000000", "1712667600.25", "17126676000"],
    "none": ["x", "yesterday", None],
}
NOON, NIGHT, XMAS = datetime(2024, 4, 9, 13), datetime(2024, 4, 9), datetime(2024, 12, 25)
READ = {
    "year_first": [NOON] * 5 + [None] * 2, "month_first": [NOON] * 3 + [XMAS, XMAS, None, None], "day_first": [NOON, NOON, XMAS, XMAS, None, None],
    "month_name": [NOON, NOON, None, None], "day_name": [NOON, NOON, None], "compact": [NOON, NOON, NIGHT, None],
    "epoch": [NOON] * 3 + [NOON + timedelta(milliseconds=250), None], "none": [None] * 3,
}


@pytest.fixture(params=["UTC", "Europe/Berlin"])
def zone(spark, request):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", request.param)
    yield request.param
    spark.conf.set("spark.sql.session.timeZone", before)


def test_every_file_is_read_in_one_layout(spark, zone):
    data = [(f, i, t) for f, texts in FILES.items() for i, t in enumerate(texts)]
    frame = spark.createDataFrame(data, "source_file string, i int, timestamp string").repartition(3)
    out = {(r.source_file, r.i): r.timestamp for r in times.with_times(frame).collect()}
    assert out == {(f, i): t for f, wanted in READ.items() for i, t in enumerate(wanted)}
    chosen = {r.source_file: r.layout for r in times.settle(times.vote(frame)).collect()}
    assert chosen == {f: None if f == "none" else f for f in FILES}
    for f, texts in FILES.items():  # a file alone is read as it is among others
        alone = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, timestamp string")
        assert [r.timestamp for r in times.with_times(alone).orderBy("i").collect()] == READ[f]
    assert readings.parse_timestamps(frame).count() == sum(t is not None for wanted in READ.values() for t in wanted)


def test_unclear_layouts_are_refused_unless_told(spark):
    frame = spark.createDataFrame([("4/9/2024 13:00",), ("5/9/2024",), ("x",)], "timestamp string")
    with pytest.raises(DataValidationError, match="month_first or day_first"):
        times.with_times(frame)
    read = lambda **told: [r[0] and (r[0].month, r[0].day) for r in times.with_times(frame, **told).collect()]
    assert read(prefer="month_first") == [(4, 9), (5, 9), None] and read(prefer="day_first") == [(9, 4), (9, 5), None]
    assert read(layout="day_first") == [(9, 4), (9, 5), None]
    clear = frame.union(spark.createDataFrame([("13/9/2024",)], frame.schema))
    assert [r[0] and r[0].month for r in times.with_times(clear, prefer="month_first").collect()] == [9, 9, None, 9]
    assert times.with_times(frame.limit(0)).count() == 0


def test_hours_that_a_session_zone_skips_are_kept(spark, zone):
    frame = spark.createDataFrame([("3/31/2024 2:30",), ("3/31/2024 3:30",)], "timestamp string")
    assert [r[0].hour for r in times.with_times(frame).collect()] == [2, 3]
    typed = spark.range(1).select(F.timestamp_seconds(F.lit(1711852200)).alias("timestamp"))
    assert times.with_times(typed).first()[0] == datetime(2024, 3, 31, 2, 30)


def test_files_of_a_folder_may_differ(spark, tmp_path):
    head = "timestamp,rainfall_mm,inflow_litres,usage_litres,tank_level_litres\n"
    for name, texts in (("a", ["13/04/2024 10:00", "12/04/2024 10:00"]), ("b", ["4/13/2024 11:00 AM", "4/12/2024 11:00 AM"])):
        (tmp_path / f"{name}.csv").write_text(head + "".join(f'"{t}",0,1,2,3\n' for t in texts))
    staged = readings.stage_readings(readings.load_readings(spark, str(tmp_path)))
    assert sorted(r.timestamp for r in staged.collect()) == [datetime(2024, 4, d, h) for d in (12, 13) for h in (10, 11)]
    assert times.SOURCE not in staged.columns


def test_optional_columns_get_defaults(healthy):
    df = readings.load_readings(healthy.sparkSession, healthy.drop("temperature_c", "tank_capacity_litres", "tank_id"))
    row = df.first()
    assert row["tank_capacity_litres"] == 5000.0 and row["temperature_c"] is None and row["tank_id"] == 0


def test_absent_file_is_file_not_found(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        readings.load_readings(spark, str(tmp_path / "none.csv"))


def test_csv_words_blanks_and_broken_times(spark, tmp_path):
    path = tmp_path / "readings.csv"
    path.write_text(
        " timestamp ,rainfall_mm, inflow_litres ,usage_litres,tank_level_litres,note\n"
        "2024-01-01 00:00:00,0,N/A,40,2500,\"a, \"\"b\"\"\"\n"
        "2024-01-01 01:00:00,abc,10,,2510,x\n"
        "yesterday,1,1,1,1,y\n"
        "2024-01-01 00:00:00,9,9,9,9,late copy\n"
    )
    raw = readings.load_readings(spark, str(path))
    staged = readings.stage_readings(raw)
    assert by_time(staged, "rainfall_mm", "inflow_litres", "usage_litres", "tank_level_litres", "note") == [
        (0.0, None, 40.0, 2500.0, 'a, "b"'),
        (None, 10.0, None, 2510.0, "x"),
    ]
    # 'N/A' is a missing word of the reader, 'abc' is a value that was no number.
    assert [r[0] for r in staged.orderBy("timestamp").select("coerced_cells").collect()] == [0, 1]


HEAD = "timestamp,rainfall_mm,inflow_litres,usage_litres,tank_level_litres\n"


@pytest.fixture(params=[None, 300, 41])
def split_bytes(spark, request):
    """Splits of Spark's own size, of a few lines, and of less than one line."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(n) for n in names]
    if request.param:
        for n in names:
            spark.conf.set(n, str(request.param))
    yield request.param
    for n, value in zip(names, before, strict=True):
        spark.conf.set(n, value)


@pytest.mark.parametrize("files", [1, 7])
def test_lines_are_numbered_by_file_then_line(spark, tmp_path, split_bytes, files):
    lines = [f"2024-03-{1 + i % 3:02d} 00:00:00,{i},0,{'1' * (i % 40)},{1000 + i}\n" for i in range(140)]
    for f in range(files):  # unequal files, the longest last, as Spark starts with long splits
        lo, hi = (140 * k * k // files**2 for k in (f, f + 1))
        (tmp_path / f"part {f}").mkdir()
        (tmp_path / f"part {f}" / "é x.csv").write_text(HEAD + "".join(lines[lo:hi]))
    raw = readings.read_telemetry_csv(spark, str(tmp_path), recursive=True)
    if split_bytes:
        assert raw.rdd.getNumPartitions() > files
    rows = raw.orderBy("ingest_seq").collect()
    assert [r["rainfall_mm"] for r in rows] == [str(i) for i in range(140)]
    assert len({r["ingest_seq"] for r in rows}) == 140
    first = readings.stage_readings(readings.default_optional_columns(raw))
    assert by_time(first, "rainfall_mm") == [0.0, 1.0, 2.0]


def test_absent_parquet_is_file_not_found(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        readings.load_readings(spark, str(tmp_path / "none.parquet"))


def test_number_coercion_accepts_plain_numbers_only(spark):
    texts = ["1.5", " 2 ", "-3e2", ".5", "1.0d", "2f", "0x10", "NaN", "abc", "1_000", ""]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r[0] for r in df.orderBy("i").select(to_number(F.col("t"), "string")).collect()]
    assert got == [1.5, 2.0, -300.0, 0.5] + [None] * 7


def test_nan_becomes_null(spark):
    df = frame(spark, [{"level": float("nan"), "rain": 1.0}])
    assert readings.stage_readings(df).first()["tank_level_litres"] is None


def test_first_copy_wins_whatever_the_row_order(spark):
    rows = [{"t": hour(0), "level": 100.0 + i, "seq": i} for i in (3, 1, 2)] + [{"t": hour(1), "level": 7.0}]
    staged = readings.stage_readings(frame(spark, rows))
    assert by_time(staged, "tank_level_litres") == [101.0, 7.0]


def test_micros_do_not_depend_on_the_session_zone(spark):
    df = frame(spark, [{"t": hour(0.5)}])
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        seen = set()
        for zone in ("UTC", "America/New_York", "Asia/Kolkata"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            t = F.col("timestamp")
            seen.add(df.select(micros(t), truncate_hour(t), from_micros(micros(t))).first())
        assert len(seen) == 1
        value, start, back = seen.pop()
        assert value == 1709253000 * 1_000_000 and start == hour(0) and back == hour(0.5)
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_table_round_trip(spark, healthy, tmp_path):
    for fmt in ("parquet", "csv"):
        path = readings.write_table(healthy, str(tmp_path / f"t.{fmt}"), fmt)
        back = readings.stage_readings(readings.load_readings(spark, path))
        assert by_time(back, "tank_level_litres") == pytest.approx(by_time(healthy, "tank_level_litres"))
