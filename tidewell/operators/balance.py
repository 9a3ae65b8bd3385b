"""Clamped running balance, with and without the controller, and what the controller changed.

The controller reacts to supplied predictions and rain, never to the simulated level, so every hour is a
known map ``l -> min(cap, max(0, l + a))``. Such maps compose into ``(a, lo, hi)`` triples. A long tank is
therefore folded segment by segment, the few triples are chained to give each segment its starting level,
and all segments are replayed at once. A tank of one segment is simply replayed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from tidewell.contract import (
    CAPACITY, CONSERVE, CONTROL, HARVEST, HOT, INFLOW, LEVEL, PREVENT, SEGMENT, SEGMENT_KEYS, TANK,
    TIME, TS_US, USAGE, ControlRules,
)
from tidewell.functions.scan import clamp_levels, compose, fold
from tidewell.operators.rules import decide_action
from tidewell.plans.segments import (
    along_tank, attach, earlier, has_long_tanks, in_segment, so_far, summarise, with_tank_values,
)

NO_CONTROLLER = "no_controller"
WITH_CONTROLLER = "with_controller"

# --- fixed values of the catchment -------------------------------------------------------------
CATCHMENT_AREA_M2 = 150.0
RUNOFF_COEFFICIENT = 0.85
INITIAL_LEVEL_FRACTION = 0.55


def catchment_inflow(rain: Column) -> Column:
    """Litres that rain on the catchment brings."""
    return rain * F.lit(CATCHMENT_AREA_M2 * RUNOFF_COEFFICIENT)


# --- the scan -----------------------------------------------------------------------------------
def _in_order(df: DataFrame) -> DataFrame:
    """Rows of each partition segment by segment in time order, numbered within the segment.

    The window brings every segment into one partition and sorts it; on a staged table that moves nothing.
    Readers of the result check the numbering, so a broken order cannot pass unnoticed.
    """
    return df.withColumn("row_in_segment", F.row_number().over(in_segment()))


def _floats(column: pa.Array) -> np.ndarray:
    """Values as doubles of their own, missing ones as NaN."""
    return np.array(column.to_numpy(zero_copy_only=False), float)


def _numbers(column: pa.Array, before: int) -> np.ndarray:
    """Row numbers within segments; each must follow the one before it or begin a segment."""
    number = column.to_numpy()
    if ((number != 1) & (number != np.concatenate([[before], number[:-1]]) + 1)).any():
        raise RuntimeError("rows of a segment are not in order")
    return number


def clamp_scan(df: DataFrame, flows: list[str], start: str) -> DataFrame:
    """Add ``before_<flow>`` and ``after_<flow>``: the level around every row, one balance per flow column.

    ``df`` is segmented and has the tank's starting level in ``start``. Batches stream through a task; only
    the running level is kept between them.
    """
    starts = {f: f"start_{f}" for f in flows}
    if has_long_tanks(df):
        begun = attach(df, _segment_starts(df, flows, start, starts)).withColumns(
            {s: F.coalesce(F.col(s), F.col(start)) for s in starts.values()}
        )
    else:
        begun = df.withColumns({s: F.col(start) for s in starts.values()})
    rows = _in_order(begun)
    helpers = ["row_in_segment", *starts.values()]
    kept = [f for f in rows.schema.fields if f.name not in helpers]
    added = [f"{side}_{f}" for f in flows for side in ("before", "after")]
    schema = T.StructType(kept + [T.StructField(a, T.DoubleType()) for a in added])

    def replay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level, at = dict.fromkeys(flows, 0.0), 0
        for batch in batches:
            column = {n: batch.column(n) for n in batch.schema.names}
            number, cap = _numbers(column["row_in_segment"], at), _floats(column[CAPACITY])
            begins, at = number == 1, int(number[-1])
            out = {f.name: column[f.name] for f in kept}
            for f in flows:
                start = _floats(column[starts[f]])
                if not begins[0]:  # the segment goes on from the batch before
                    start[0] = level[f]
                before, after = clamp_levels(_floats(column[f]), cap, begins, start)
                level[f] = after[-1]
                out[f"before_{f}"], out[f"after_{f}"] = pa.array(before), pa.array(after)
            yield pa.RecordBatch.from_pydict(out)

    return rows.mapInArrow(replay, schema)


def _segment_starts(df: DataFrame, flows: list[str], start: str, starts: dict[str, str]) -> DataFrame:
    """Level at which each segment of a long tank begins."""
    keys = [T.StructField(c, df.schema[c].dataType) for c in (TANK, SEGMENT)]
    parts = [f"{p}_{f}" for f in flows for p in ("a", "lo", "hi")]
    fold_schema = T.StructType(
        [*keys, T.StructField("at", T.DoubleType()), *[T.StructField(p, T.DoubleType()) for p in parts]]
    )

    def fold_segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One triple per segment and flow; a segment may go on in the next batch."""
        done: list[list] = []
        at = 0
        for batch in batches:
            column = {n: batch.column(n) for n in batch.schema.names}
            number = _numbers(column["row_in_segment"], at)
            at = int(number[-1])
            cap, values = _floats(column[CAPACITY]), [_floats(column[f]) for f in flows]
            edges = np.union1d([0], np.flatnonzero(number == 1)).tolist()
            for low, high in zip(edges, [*edges[1:], len(number)], strict=True):
                if number[low] == 1:
                    keys = [column[c][low].as_py() for c in (TANK, SEGMENT, start)]
                    done.append([*keys, *[0.0, -np.inf, np.inf] * len(flows)])
                for i, flow in enumerate(values):
                    k = 3 + 3 * i
                    done[-1][k : k + 3] = map(float, compose(tuple(done[-1][k : k + 3]), fold(flow[low:high], cap[low:high])))
        if done:
            yield pa.RecordBatch.from_pydict(
                {n: list(v) for n, v in zip(fold_schema.names, zip(*done))}
            )

    chain_schema = T.StructType([*keys, *[T.StructField(s, T.DoubleType()) for s in starts.values()]])

    def chain(group: pd.DataFrame) -> pd.DataFrame:
        # One row per segment of one long tank.
        group = group.sort_values(SEGMENT)
        out = group[[TANK, SEGMENT]].copy()
        for f in flows:
            level, begins = float(group["at"].iloc[0]), []
            for a, lo, hi in zip(group[f"a_{f}"], group[f"lo_{f}"], group[f"hi_{f}"]):
                begins.append(level)
                level = min(hi, max(lo, level + a))
            out[starts[f]] = begins
        return out

    long_tanks = df.filter(F.col(HOT)).select(*SEGMENT_KEYS, TS_US, CAPACITY, start, *flows)
    triples = _in_order(long_tanks).mapInArrow(fold_segments, fold_schema)
    return triples.groupBy(TANK).applyInPandas(chain, chain_schema)


def with_first_value(df: DataFrame, column: str, name: str) -> DataFrame:
    """Put the tank's first value of ``column`` on every row."""
    firsts = df.groupBy(TANK).agg(F.min_by(column, TS_US).alias(name))
    segments = summarise(df, F.count("*").alias("n"))
    return attach(df, with_tank_values(segments.drop("n"), firsts))


def clamped_balance(df: DataFrame, start_fraction: float | None = None) -> DataFrame:
    """Hourly level and overflow of ``level + inflow - usage`` kept within the tank.

    Starts from a share of capacity, or from the tank's first recorded level.
    """
    if start_fraction is None:
        rows = with_first_value(df, LEVEL, "start")
    else:
        rows = df.withColumn("start", F.col(CAPACITY) * F.lit(float(start_fraction)))
    scanned = clamp_scan(rows.withColumn("flow", F.col(INFLOW) - F.col(USAGE)), ["flow"], "start")
    spill = F.greatest(F.col("before_flow") + F.col("flow") - F.col(CAPACITY), F.lit(0.0))
    return scanned.select(
        TANK, TIME, F.col("after_flow").alias("level"), spill.alias("overflow_litres")
    )


# --- with and without the controller ------------------------------------------------------------
def simulate(test_rows: DataFrame, rules: ControlRules = CONTROL) -> DataFrame:
    """Both passes of the balance, one row per (tank, hour, scenario).

    ``test_rows`` is segmented and has ``current_level``, inflow, usage, rolling rain, capacity and ``pred``.
    The first ``current_level`` starts both passes, although it already includes that hour's flow.
    """
    demand = F.col(USAGE)
    fill = F.col("pred") / F.col(CAPACITY) * 100.0
    rows = with_first_value(test_rows, "current_level", "start").withColumn(
        "action", decide_action(fill, F.col("rain_roll_3"), F.col("rain_roll_24"), rules)
    )
    essential = F.when(
        F.col("action") == CONSERVE, demand * F.lit(1.0 - rules.conserve_reduction)
    ).otherwise(demand)
    rows = rows.withColumn("essential", essential).withColumns(
        {"free": F.col(INFLOW) - demand, "steered": F.col(INFLOW) - F.col("essential")}
    )
    needed = [*SEGMENT_KEYS, TS_US, TIME, HOT, CAPACITY, USAGE, "essential", "action", "start", "free", "steered"]
    scanned = clamp_scan(rows.select(*needed), ["free", "steered"], "start")
    cap = F.col(CAPACITY)

    def pass_of(name: str, flow: str, action: Column, essential: Column) -> Column:
        wish = F.col(f"before_{flow}") + F.col(flow)
        spill = F.greatest(wish - cap, F.lit(0.0))
        extra = F.when(action == PREVENT, F.least(spill, F.lit(rules.max_preventive_draw))).otherwise(0.0)
        unmet = F.greatest(-wish, F.lit(0.0))
        level = F.col(f"after_{flow}")
        return F.struct(
            F.lit(name).alias("scenario"),
            action.alias("action"),
            level.alias("level"),
            (spill - extra).alias("overflow_litres"),
            extra.alias("extra_used_litres"),
            unmet.alias("unmet_litres"),
            (F.col(USAGE) - essential).alias("restricted_litres"),
            shortage_flag(unmet, level, cap, rules).alias("is_shortage"),
        )

    passes = F.array(
        pass_of(NO_CONTROLLER, "free", F.lit(HARVEST), F.col(USAGE)),
        pass_of(WITH_CONTROLLER, "steered", F.col("action"), F.col("essential")),
    )
    rows = scanned.select(*SEGMENT_KEYS, TS_US, TIME, F.inline(passes))
    return rows.withColumn("is_overflow", F.col("overflow_litres") > rules.event_eps_litres)


def shortage_flag(unmet: Column, level: Column, capacity: Column, rules: ControlRules = CONTROL) -> Column:
    """Demand missed by more than a litre, or the level at or under the reserve line."""
    return (unmet > rules.event_eps_litres) | (level <= capacity * F.lit(rules.reserve_fraction))


# --- events -------------------------------------------------------------------------------------
def count_events(df: DataFrame, flags: dict[str, str], by: list[str]) -> DataFrame:
    """Number of maximal runs of true per group for each ``result name -> flag column``.

    Runs are counted inside segments; a run that continues over a segment border is taken off once.
    """
    groups = [*by, SEGMENT]
    within = in_segment().partitionBy(*groups).orderBy(TS_US)
    along = along_tank().partitionBy(*by).orderBy(SEGMENT)
    rises = {
        name: (F.col(c) & ~F.coalesce(F.lag(c).over(within), F.lit(False))).cast("int")
        for name, c in flags.items()
    }
    per_segment = (
        df.withColumns({f"rise_{name}": v for name, v in rises.items()})
        .groupBy(*groups)
        .agg(
            *[F.sum(f"rise_{n}").alias(f"runs_{n}") for n in flags],
            *[F.min_by(c, TS_US).alias(f"first_{n}") for n, c in flags.items()],
            *[F.max_by(c, TS_US).alias(f"last_{n}") for n, c in flags.items()],
        )
    )
    joined = {
        f"joined_{n}": (
            F.col(f"first_{n}") & F.coalesce(F.lag(f"last_{n}").over(along), F.lit(False))
        ).cast("int")
        for n in flags
    }
    return (
        per_segment.withColumns(joined)
        .groupBy(*by)
        .agg(*[(F.sum(f"runs_{n}") - F.sum(f"joined_{n}")).alias(n) for n in flags])
    )


def longest_runs(df: DataFrame, column: str) -> DataFrame:
    """Longest run of equal consecutive values per tank; missing values are skipped, they do not break runs.

    Runs are formed inside segments. Only a segment's first and last run can continue in a neighbour, so only
    those are chained along the tank.
    """
    rows = df.filter(F.col(column).isNotNull())
    same = F.coalesce(F.col(column) == F.lag(column).over(in_segment()), F.lit(False))
    runs = (
        rows.withColumn("change", (~same).cast("int"))
        .withColumn("run", F.sum("change").over(so_far(in_segment())))
        .groupBy(*SEGMENT_KEYS, "run")
        .agg(F.count("*").alias("length"), F.first(column).alias("value"))
    )
    bounds = runs.groupBy(*SEGMENT_KEYS).agg(F.max("run").alias("runs"), F.max("length").alias("longest"))
    edge = runs.join(bounds.select(*SEGMENT_KEYS, "runs"), SEGMENT_KEYS).filter(
        (F.col("run") == 1) | (F.col("run") == F.col("runs"))
    )
    along = along_tank().orderBy(SEGMENT, "run")
    continues = (F.lag(SEGMENT).over(along) < F.col(SEGMENT)) & (F.lag("value").over(along) == F.col("value"))
    chained = (
        edge.withColumn("start", (~F.coalesce(continues, F.lit(False))).cast("int"))
        .withColumn("chain", F.sum("start").over(so_far(along)))
        .groupBy(TANK, "chain")
        .agg(F.sum("length").alias("longest"))
    )
    return (
        bounds.select(TANK, "longest")
        .unionByName(chained.select(TANK, "longest"))
        .groupBy(TANK)
        .agg(F.max("longest").alias("longest_run"))
    )


# --- summaries ----------------------------------------------------------------------------------
def balance_summary(trajectory: DataFrame) -> DataFrame:
    """Totals, hours, events and levels per (tank, scenario)."""
    keys = [TANK, "scenario"]
    totals = trajectory.groupBy(*keys).agg(
        F.sum("overflow_litres").alias("overflow_litres"),
        F.count_if("is_overflow").alias("overflow_hours"),
        F.count_if("is_shortage").alias("shortage_hours"),
        F.sum("unmet_litres").alias("unmet_demand_litres"),
        F.sum("extra_used_litres").alias("productive_extra_used_litres"),
        F.sum("restricted_litres").alias("demand_restricted_litres"),
        F.max_by("level", TS_US).alias("final_level"),
        F.avg("level").alias("mean_level"),
        F.min("level").alias("min_level"),
        F.count("*").alias("hours"),
    )
    events = count_events(
        trajectory, {"overflow_events": "is_overflow", "shortage_events": "is_shortage"}, keys
    )
    return totals.join(events, keys)


def impact_comparison(summary: DataFrame) -> DataFrame:
    """What the controller changed, per tank."""
    def of(scenario: str, column: str) -> Column:
        return F.max(F.when(F.col("scenario") == scenario, F.col(column)))

    measures = [
        "overflow_litres", "overflow_events", "shortage_events", "unmet_demand_litres",
        "productive_extra_used_litres", "demand_restricted_litres", "hours",
    ]
    wide = summary.groupBy(TANK).agg(
        *[of(s, m).alias(f"{p}_{m}") for s, p in ((NO_CONTROLLER, "n"), (WITH_CONTROLLER, "w")) for m in measures]
    )
    saved = F.col("n_overflow_litres") - F.col("w_overflow_litres")
    gain = lambda m: F.greatest(F.col(f"n_{m}") - F.col(f"w_{m}"), F.lit(0))
    hours = F.greatest(F.col("n_hours"), F.lit(1).cast("bigint"))
    return wide.select(
        TANK,
        F.greatest(saved, F.lit(0.0)).alias("litres_saved_from_overflow"),
        gain("overflow_events").alias("overflow_events_avoided"),
        gain("shortage_events").alias("shortage_events_avoided"),
        F.when(F.col("n_overflow_litres") > 0, saved / F.col("n_overflow_litres") * 100.0)
        .otherwise(0.0)
        .alias("overflow_reduction_pct"),
        F.col("w_productive_extra_used_litres").alias("water_used_productively_litres"),
        F.col("w_demand_restricted_litres").alias("litres_conserved_by_restricting_demand"),
        (F.col("n_unmet_demand_litres") - F.col("w_unmet_demand_litres")).alias("unmet_demand_avoided_litres"),
        hours.alias("test_hours"),
        F.bround(hours / F.lit(24.0), 1).alias("test_days"),
    )


def trajectory_compare(trajectory: DataFrame) -> DataFrame:
    """Level of both scenarios side by side, by hour. Grouped inside segments: staged rows stay where they are."""
    level = lambda s: F.max(F.when(F.col("scenario") == s, F.col("level")))
    return trajectory.groupBy(*SEGMENT_KEYS, TIME).agg(
        level(NO_CONTROLLER).alias("level_no_controller"), level(WITH_CONTROLLER).alias("level_with_controller")
    ).drop(SEGMENT)


def simulated_actions(trajectory: DataFrame) -> DataFrame:
    """What the controller did in the simulation: hours per tank and action, first and last hour of each."""
    return trajectory.filter(F.col("scenario") == WITH_CONTROLLER).groupBy(TANK, "action").agg(
        F.count("*").alias("hours"), F.min(TIME).alias("first_hour"), F.max(TIME).alias("last_hour")
    )


def cumulative_overflow(trajectory: DataFrame) -> DataFrame:
    """Running overflow per tank and scenario: a running sum inside the segment plus what came before it."""
    groups = [TANK, "scenario"]
    along = along_tank().partitionBy(*groups).orderBy(SEGMENT)
    offsets = (
        trajectory.groupBy(*groups, SEGMENT)
        .agg(F.sum("overflow_litres").alias("spilt"))
        .select(*groups, SEGMENT, F.coalesce(F.sum("spilt").over(earlier(along)), F.lit(0.0)).alias("spilt_before"))
    )
    within = in_segment().partitionBy(*groups, SEGMENT).orderBy(TS_US)
    total = F.sum("overflow_litres").over(so_far(within)) + F.col("spilt_before")
    return trajectory.join(offsets, [*groups, SEGMENT]).select(
        *groups, TIME, total.alias("cumulative_overflow_litres")
    )
