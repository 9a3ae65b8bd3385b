"""Structured Streaming forms of the live path: ingest, de-duplication, hourly rollup, decisions, balance.

Event time is a zoned TIMESTAMP inside a stream (watermarks accept nothing else) and naive outside. Live decisions and
the balance keep state in ``transformWithState``, which needs the RocksDB state store (``streaming.replay`` sets it).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

from tidewell.contract import (
    CAPACITY, CLEANING, CONTROL, COERCED, DEFAULT_CAPACITY, FEATURES, INFLOW, LEVEL, RAIN, TANK, TEMPERATURE, TIME, TS_US, USAGE,
    CleaningRules, ControlRules,
)
from tidewell.functions.scalars import clip, flag, from_micros, micros, no_nan
from tidewell.functions.scan import walk
from tidewell.operators.baselines import physics_prediction
from tidewell.operators.clean import clip_nonnegative, level_out_of_range, zscore_mask
from tidewell.operators.features import LAG_SOURCES, LAGS, RAIN_WINDOWS, USAGE_WINDOWS
from tidewell.operators.recommend import Predictor
from tidewell.operators.rules import decide_action, decision_reason
from tidewell.sources.readings import type_readings

EVENT_TIME = "event_time"


def ingest_clean(stream: DataFrame, tank_stats: DataFrame, rules: CleaningRules = CLEANING) -> DataFrame:
    """Row-local cleaning of a stream of raw readings against per-tank limits from a batch table.

    Types, clips meters, nulls out-of-range levels and meter spikes. Jumps and gaps need neighbours and stay
    with the batch job.
    """
    rows = type_readings(stream).join(tank_stats, TANK, "left")
    rows = clip_nonnegative(
        rows.withColumn(CAPACITY, F.coalesce("capacity_value", F.col(CAPACITY)))
    ).withColumn("level_out_of_range", level_out_of_range())
    inflow_spike = flag(F.col(INFLOW) > F.col("inflow_fence"))
    usage_spike = zscore_mask(F.col(USAGE), rules) & flag(F.col(USAGE) > F.col("usage_median"))
    return rows.withColumns(
        {"inflow_was_outlier": inflow_spike, "usage_was_outlier": usage_spike}
    ).select(
        TANK, TIME, TS_US, COERCED,
        F.coalesce(RAIN, F.lit(0.0)).alias(RAIN),
        F.when(~F.col("inflow_was_outlier"), F.coalesce(INFLOW, F.lit(0.0))).alias(INFLOW),
        F.when(~F.col("usage_was_outlier"), F.col(USAGE)).alias(USAGE),
        F.when(~F.col("level_out_of_range"), F.col(LEVEL)).alias(LEVEL),
        CAPACITY, TEMPERATURE, "level_out_of_range", "inflow_was_outlier", "usage_was_outlier",
    )


def dedupe(stream: DataFrame, delay: str) -> DataFrame:
    """First arrival per (tank, time); state is dropped once the watermark has passed ``delay``."""
    return (
        stream.withColumn(EVENT_TIME, F.col(TIME).cast("timestamp"))
        .withWatermark(EVENT_TIME, delay)
        .dropDuplicatesWithinWatermark([TANK, EVENT_TIME])
        .drop(EVENT_TIME)
    )


def hourly_rollup(events: DataFrame, delay: str) -> DataFrame:
    """Hourly readings per tank from raw events, each hour emitted once when the watermark closes it.

    All meters of ``sources.events.telemetry``, so that cleaning and decisions can read the result.
    """
    kind = F.col("event_type")

    def signal(name: str, scale: float, offset: float):
        exact = F.sum(F.when(kind == name, F.col("value").cast("decimal(18,2)"))).cast("double")
        return exact * F.lit(scale) + F.lit(offset)

    hours = (
        events.withColumn(EVENT_TIME, F.col("ts").cast("timestamp"))
        .withWatermark(EVENT_TIME, delay)
        .groupBy(F.window(EVENT_TIME, "1 hour"), F.col("user_id").alias(TANK))
        .agg(
            signal("view", 0.1, -0.1).alias(RAIN),
            signal("click", 4.0, -4.0).alias(INFLOW),
            signal("purchase", 2.0, -2.0).alias(USAGE),
            (F.expr("max_by(value, ts) filter (where event_type = 'signup')") * 25.0 - 100.0).alias(LEVEL),
            F.lit(DEFAULT_CAPACITY).alias(CAPACITY),
            (signal("error", 1.0, 0.0) / F.count_if(kind == "error")).alias(TEMPERATURE),
            F.count("*").alias("events"),
        )
    )
    start = F.col("window.start").cast("timestamp_ntz").alias(TIME)
    return hours.select(TANK, start, RAIN, INFLOW, USAGE, LEVEL, CAPACITY, TEMPERATURE, "events")


# --- readings in event order --------------------------------------------------------------------
#: What became of a reading: it was taken in its turn, it came after its turn, or its time had come before.
TAKEN, LATE, REPEATED = "taken", "late", "repeated"
OUTCOME = "outcome"


#: Keys of the keyed state: each holds the tanks of one hash value, so that calls to the state store do not grow with tanks.
SHELVES = 512


def _packed(**columns: pa.Array) -> bytes:
    sink = pa.BufferOutputStream()
    batch = pa.RecordBatch.from_pydict(columns)
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _unpacked(data: bytes) -> pa.RecordBatch:
    return pa.ipc.open_stream(data).read_next_batch()


class _InOrder(StatefulProcessor):
    """Hands the readings of each tank to ``take`` in event order, with what sub-classes carry from reading to reading.

    A key of the state is a shelf of tanks. With a delay, readings wait in a list state, to which a delivery appends one
    element, and a timer of the shelf's earliest waiting reading drains what the watermark has passed: also for tanks that
    send nothing any more. Without one the readings of a micro-batch are due at once. The carried value holds, for each tank,
    the newest time that was taken, the tank's own watermark, and a bounded number of doubles. Elements and the carried value
    are Arrow tables.
    """

    def __init__(self, tank: str, columns: list[str], made: list[str], waits: bool) -> None:
        self.tank, self.columns, self.made, self.waits = tank, columns, made, waits

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", "readings binary")
        self.carried = handle.getValueState("carried", "tanks binary")

    def close(self) -> None:
        pass

    def take(self, past: np.ndarray | None, values: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """The ``made`` columns of readings newer than all taken before, and what to carry on; ``past`` is None at first."""
        raise NotImplementedError

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        frames = list(rows)
        tanks = np.concatenate([f[self.tank].to_numpy(object) for f in frames])
        times = np.concatenate([f[TS_US].to_numpy(np.int64) for f in frames])
        values = np.concatenate([f[self.columns].to_numpy(float) for f in frames])
        if self.waits:
            self.held.appendValue((self._element(tanks, times, values),))
            self._wake(int(times.min()))
        else:
            yield from self._drain(tanks, times, values)

    def handleExpiredTimer(
        self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo
    ) -> Iterator[pd.DataFrame]:
        waiting = [_unpacked(bytes(w[0])) for w in self.held.get()]
        if not waiting:
            return
        tanks = np.concatenate([w.column("tank").to_numpy(zero_copy_only=False) for w in waiting])
        times = np.concatenate([w.column("ts").to_numpy() for w in waiting])
        values = np.concatenate([w.column("values").flatten().to_numpy().reshape(w.num_rows, -1) for w in waiting])
        due = times <= timerValues.getCurrentWatermarkInMs() * 1000
        if due.all():
            self.held.clear()
        else:
            self._wake(int(times[~due].min()))
            if due.any():
                self.held.put([(self._element(tanks[~due], times[~due], values[~due]),)])
        if due.any():
            yield from self._drain(tanks[due], times[due], values[due])

    def _wake(self, earliest: int) -> None:
        self.handle.registerTimer(earliest // 1000 + 1)

    @staticmethod
    def _element(tanks: np.ndarray, times: np.ndarray, values: np.ndarray) -> bytes:
        listed = pa.FixedSizeListArray.from_arrays(pa.array(values.ravel()), values.shape[1])
        return _packed(tank=pa.array(tanks, pa.string(), from_pandas=True), ts=pa.array(times), values=listed)

    def _known(self) -> dict[str | None, tuple[int, np.ndarray]]:
        """Of each tank the newest time taken and what it carries on."""
        stored = self.carried.get()
        if stored is None:
            return {}
        batch = _unpacked(bytes(stored[0]))
        past = batch.column("past")
        parts = np.split(past.values.to_numpy(), past.offsets.to_numpy()[1:-1])
        return dict(zip(batch.column("tank").to_pylist(), zip(batch.column("ts").to_pylist(), parts, strict=True), strict=True))

    def _keep(self, known: dict[str | None, tuple[int, np.ndarray]]) -> None:
        times, parts = zip(*known.values(), strict=True)
        past = pa.ListArray.from_arrays(
            pa.array(np.cumsum([0, *map(len, parts)]), pa.int32()), pa.array(np.concatenate(parts), pa.float64())
        )
        self.carried.update((_packed(tank=pa.array(list(known), pa.string()), ts=pa.array(times, pa.int64()), past=past),))

    def _drain(self, tanks: np.ndarray, times: np.ndarray, values: np.ndarray) -> Iterator[pd.DataFrame]:
        """Take each tank's readings in order; of those with one time the first to arrive."""
        codes, names = pd.factorize(tanks, use_na_sentinel=False)
        names = [None if pd.isna(n) else n for n in names]
        order = np.lexsort((times, codes))  # stable
        codes, times, values = codes[order], times[order], values[order]
        known = self._known()
        outcome = np.full(len(times), TAKEN, dtype=object)
        outcome[1:][(times[1:] == times[:-1]) & (codes[1:] == codes[:-1])] = REPEATED
        met = np.array([n in known for n in names])[codes]
        last = np.array([known[n][0] if n in known else 0 for n in names], np.int64)[codes]
        outcome[met & (times == last)], outcome[met & (times < last)] = REPEATED, LATE
        taken = np.flatnonzero(outcome == TAKEN)
        made = np.full((len(times), len(self.made)), np.nan)
        starts = np.flatnonzero(np.diff(codes[taken], prepend=-1))
        for rows in np.split(taken, starts[1:]) if len(taken) else []:
            name = names[codes[rows[0]]]
            found, past = self.take(known[name][1] if name in known else None, values[rows])
            made[rows] = np.stack([found[c] for c in self.made], axis=1)
            known[name] = (int(times[rows[-1]]), past)
        if len(taken):
            self._keep(known)
        yield pd.DataFrame({self.tank: tanks[order], TS_US: times, OUTCOME: outcome, "made": list(made)})


def _by_tank(rows: DataFrame, delay: str | None, processor: _InOrder) -> DataFrame:
    """Apply a processor per tank. The result has the tank, TIME, OUTCOME and the made columns.

    Spark drops rows behind the watermark where it sees their event time, before anything could count them. So the
    watermark is taken below and the operator gets the time as a plain number. Made values travel as one array a row,
    tanks as text.
    """
    rows = rows.filter(F.col(TS_US).isNotNull())
    if delay is not None:
        rows = rows.withColumn(EVENT_TIME, F.col(TIME).cast("timestamp")).withWatermark(EVENT_TIME, delay)
    kind = rows.schema[TANK].dataType
    out = T.StructType([
        T.StructField(TANK, T.StringType()), T.StructField(TS_US, T.LongType()), T.StructField(OUTCOME, T.StringType()),
        T.StructField("made", T.ArrayType(T.DoubleType())),
    ])
    shelf = F.pmod(F.xxhash64(TANK), F.lit(SHELVES)).alias("shelf")
    shelved = rows.select(shelf, F.col(TANK).cast("string").alias(TANK), TS_US, *processor.columns)
    found = shelved.groupBy("shelf").transformWithStateInPandas(
        processor, out, "append", "none" if delay is None else "eventTime"
    )
    return found.select(
        F.col(TANK).cast(kind).alias(TANK), from_micros(F.col(TS_US)).alias(TIME), OUTCOME,
        *(no_nan(F.col("made")[k]).alias(c) for k, c in enumerate(processor.made)),
    )


def missed_readings(table: DataFrame) -> DataFrame:
    """(tank, late, repeated): readings of a job's output table that came too late or again; tanks without any are left out."""
    return table.filter(F.col(OUTCOME) != TAKEN).groupBy(TANK).agg(
        *(F.count_if(F.col(OUTCOME) == o).alias(o) for o in (LATE, REPEATED))
    )


# --- live decisions -----------------------------------------------------------------------------
_SIGNALS = [RAIN, INFLOW, USAGE, LEVEL, TEMPERATURE]
_DERIVED = [f for f in FEATURES if f not in _SIGNALS and f not in ("hour", "day_of_week", "is_weekend")]


def _last_rows(values: np.ndarray, n: int, rows: int) -> np.ndarray:
    """(rows, n): each of the last ``rows`` values and the ones before it; NaN before the first."""
    padded = np.concatenate([np.full(max(0, n + rows - 1 - len(values)), np.nan), values])
    return np.lib.stride_tricks.sliding_window_view(padded[len(padded) - (n + rows - 1) :], n)


def look_back(past: np.ndarray, now: np.ndarray, cap: np.ndarray, rules: ControlRules) -> dict[str, np.ndarray]:
    """Features of the readings ``now``, and whether the ones before each make its sensor suspect.

    Columns of ``past`` and ``now`` are the signals; ``past`` are the tank's readings right before. Missing values are
    skipped. A sensor is suspect without any reading before, if one of the last few lacks a level, is out of range
    or has negative inflow, or if enough levels in a row are the same.
    """
    n = len(now)
    both = {c: np.concatenate([past[:, k], now[:, k]]) for k, c in enumerate(_SIGNALS)}
    out = {c: now[:, k] for k, c in enumerate(_SIGNALS)} | {CAPACITY: cap}
    for prefix, column in LAG_SOURCES.items():
        for k in LAGS:
            out[f"{prefix}_lag_{k}"] = _last_rows(both[column], k + 1, n)[:, 0]
    for width in RAIN_WINDOWS:
        out[f"rain_roll_{width}"] = np.nansum(_last_rows(both[RAIN], width, n), axis=1)
    for width in USAGE_WINDOWS:
        seen = _last_rows(both[USAGE], width, n)
        known = np.count_nonzero(~np.isnan(seen), axis=1)
        out[f"usage_roll_mean_{width}"] = np.where(known > 0, np.nansum(seen, axis=1) / np.maximum(known, 1), np.nan)
    level = out[LEVEL]
    out["fill_pct"] = np.maximum(level / cap * 100.0, 0.0)
    out["net_flow_litres"] = out[INFLOW] - out[USAGE]
    out["headroom_litres"] = cap - level
    out["delta_lag_1"] = level - out["level_lag_1"]

    window, flat = max(rules.flatline_hours + 2, 8), rules.flatline_hours
    rank = len(past) + np.arange(n)  # how many readings there are before
    before = _last_rows(both[LEVEL], window + 1, n)[:, :-1]
    there = np.arange(window, 0, -1) <= rank[:, None]
    wrong = there & (np.isnan(before) | (before < 0) | (before > cap[:, None]))
    negative = _last_rows(both[INFLOW], window + 1, n)[:, :-1] < 0
    same = before[:, 1:] == before[:, :-1]
    runs = np.lib.stride_tricks.sliding_window_view(same, flat - 1, axis=1).all(axis=2)
    out["fault"] = (rank == 0) | wrong.any(axis=1) | negative.any(axis=1) | runs.any(axis=1)
    return out


class _LiveRows(_InOrder):
    """Carries as many of a tank's last readings as the features look back to."""

    def __init__(self, tank: str, waits: bool, rules: ControlRules) -> None:
        super().__init__(tank, [CAPACITY, *_SIGNALS], [CAPACITY, *_SIGNALS, *_DERIVED, "fault"], waits)
        self.rules = rules
        self.keep = max(*LAGS, *RAIN_WINDOWS, *USAGE_WINDOWS, rules.flatline_hours + 2, 8)

    def take(self, past: np.ndarray | None, values: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
        past = np.empty((0, len(_SIGNALS))) if past is None else past.reshape(-1, len(_SIGNALS))
        now = values[:, 1:]
        made = look_back(past, now, values[:, 0], self.rules)
        return made, np.concatenate([past, now])[-self.keep :].ravel()


def live_rows(stream: DataFrame, rules: ControlRules = CONTROL, delay: str | None = None) -> DataFrame:
    """Feature row per cleaned reading, from a state of the tank's last readings.

    With ``delay`` readings wait in the state until the watermark has passed them and come out in event-time order,
    however deliveries are cut. Without it those of a micro-batch come out at once, in order. ``outcome`` tells the
    readings that were taken from those that were not newer than the last one taken (``late``) or had the time of
    one that came before (``repeated``); those have nothing but their tank and time.
    """
    wanted = stream.select(TANK, TIME, CAPACITY, *_SIGNALS, micros(F.col(TIME)).alias(TS_US))
    rows = _by_tank(wanted, delay, _LiveRows(TANK, delay is not None, rules))
    day = F.weekday(TIME)
    return rows.withColumns({
        "fault": F.col("fault") == 1.0, "hour": F.hour(TIME), "day_of_week": day, "is_weekend": (day >= 5).cast("int"),
    })


def live_decisions(
    stream: DataFrame, predictor: Predictor, rules: ControlRules = CONTROL, delay: str | None = None
) -> DataFrame:
    """Next-hour prediction and action per reading; ``delay`` and ``outcome`` as in ``live_rows``.

    The tank's previous readings are checked for a suspect sensor (empty history, out-of-range or frozen
    levels, negative inflow); then the water balance answers instead of the predictor.
    """
    rows = predictor(live_rows(stream, rules, delay))
    taken, cap = F.col(OUTCOME) == TAKEN, F.col(CAPACITY)
    physics = physics_prediction(F.col(LEVEL), F.col(INFLOW), F.col("usage_roll_mean_24"), cap)
    predicted = F.when(F.col("used_fallback"), physics).otherwise(clip(F.col("model_level"), 0.0, cap))
    args = (F.col("predicted_fill_pct"), F.col("rain_roll_3"), F.col("rain_roll_24"))
    return (
        rows.withColumnRenamed("fault", "used_fallback")
        .withColumn("predicted_level", F.when(taken, predicted))
        .withColumn("predicted_fill_pct", F.col("predicted_level") / cap * 100.0)
        .select(
            TANK, TIME, OUTCOME, "used_fallback", "predicted_level", "predicted_fill_pct",
            F.when(taken, decide_action(*args, rules)).alias("action"),
            F.when(taken, decision_reason(*args, rules)).alias("reason"),
        )
    )


# --- running balance ----------------------------------------------------------------------------
class _Balance(_InOrder):
    """Carries the tank's level."""

    def __init__(self, tank: str, waits: bool) -> None:
        super().__init__(tank, [CAPACITY, LEVEL, "flow"], ["level", "overflow_litres"], waits)

    def take(self, past: np.ndarray | None, values: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
        cap, first, flow = values.T
        before, after = walk(flow, cap, first[0] if past is None else past[0])
        return {"level": after, "overflow_litres": np.maximum(before + flow - cap, 0.0)}, after[-1:]


def running_balance(stream: DataFrame, delay: str | None = None) -> DataFrame:
    """Clamped balance carried from reading to reading; the tank's first recorded level starts it.

    ``delay`` and ``outcome`` as in ``live_rows``. Late readings cannot be applied any more.
    """
    wanted = stream.select(
        TANK, TIME, micros(F.col(TIME)).alias(TS_US), CAPACITY, LEVEL, (F.col(INFLOW) - F.col(USAGE)).alias("flow")
    )
    return _by_tank(wanted, delay, _Balance(TANK, delay is not None))
