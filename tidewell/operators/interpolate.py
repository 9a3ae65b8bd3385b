"""Linear interpolation in elapsed time, across segment borders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidewell.contract import SEGMENT_KEYS, TS_US
from tidewell.plans.segments import (
    along_tank, along_tank_reversed, attach, earlier, has_long_tanks, in_segment, in_segment_reversed, so_far,
    summarise,
)


def _at(column: str) -> Column:
    """Time of a valid reading, NULL where the value is missing."""
    return F.when(F.col(column).isNotNull(), F.col(TS_US))


def time_interpolate(df: DataFrame, columns: list[str]) -> DataFrame:
    """Fill NULLs from the nearest valid readings on both sides; leading and trailing gaps are held flat.

    A column with no valid value in the whole tank stays NULL.
    """
    sides = {}
    for side, window in (("before", so_far(in_segment())), ("after", so_far(in_segment_reversed()))):
        for c in columns:
            sides[f"__{c}_{side}"] = F.last(c, ignorenulls=True).over(window)
            sides[f"__{c}_{side}_at"] = F.last(_at(c), ignorenulls=True).over(window)
    near = df.withColumns(sides)
    if has_long_tanks(df):
        near = attach(near, _valid_neighbours(df, columns))
        near = near.withColumns({s: F.coalesce(s, f"{s}_far") for s in sides}).drop(*[f"{s}_far" for s in sides])
    return near.withColumns({c: _between(c) for c in columns}).drop(*sides)


def _valid_neighbours(df: DataFrame, columns: list[str]) -> DataFrame:
    """Per segment: the last valid (time, value) before it and the first one after it."""
    point = {c: F.when(F.col(c).isNotNull(), F.struct(F.col(TS_US), F.col(c).alias("v"))) for c in columns}
    ends = summarise(
        df,
        *[F.max(point[c]).alias(f"{c}_last") for c in columns],
        *[F.min(point[c]).alias(f"{c}_first") for c in columns],
    )
    carried = {}
    for c in columns:
        for side, edge, along in (("before", "last", along_tank()), ("after", "first", along_tank_reversed())):
            nearest = F.last(f"{c}_{edge}", ignorenulls=True).over(earlier(along))
            carried[f"__{c}_{side}_far"] = nearest["v"]
            carried[f"__{c}_{side}_at_far"] = nearest[TS_US]
    return ends.select(*SEGMENT_KEYS, *[v.alias(name) for name, v in carried.items()])


def _between(column: str) -> Column:
    v0, t0 = F.col(f"__{column}_before"), F.col(f"__{column}_before_at")
    v1, t1 = F.col(f"__{column}_after"), F.col(f"__{column}_after_at")
    return (
        F.when(F.col(column).isNotNull(), F.col(column))
        .when(v0.isNotNull() & v1.isNotNull(), v0 + (v1 - v0) * ((F.col(TS_US) - t0) / (t1 - t0)))
        .otherwise(F.coalesce(v0, v1))
    )
