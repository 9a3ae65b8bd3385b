"""Segmented series: how one very long tank is spread over many tasks.

Every order-dependent operator works on (tank_id, segment) groups of bounded size. What a segment must
know about its neighbours (previous reading, nearest valid value, running totals, clamp triples) is first
reduced to one summary row per segment, carried along the tank in a window over that small summary table,
and joined back on (tank_id, segment). A tank holding a third of all rows therefore costs as many tasks as
it has segments, and the rows themselves are shuffled once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidewell.contract import HOT, LAYOUT_DEFAULT, SEGMENT, SEGMENT_KEYS, TANK, TS_US, Layout
from tidewell.plans.lake import stage_table


def in_segment():
    """Rows of one segment in time order."""
    return Window.partitionBy(*SEGMENT_KEYS).orderBy(TS_US)


def in_segment_reversed():
    """Rows of one segment, latest first. A second sort, but never an unbounded-following frame, which
    Spark would re-evaluate for every row."""
    return Window.partitionBy(*SEGMENT_KEYS).orderBy(F.col(TS_US).desc())


def along_tank():
    """Segments of one tank in order: rows of the summary table, not readings."""
    return Window.partitionBy(TANK).orderBy(SEGMENT)


def along_tank_reversed():
    return Window.partitionBy(TANK).orderBy(F.col(SEGMENT).desc())


def earlier(window):
    """Everything strictly before the current row of ``window``."""
    return window.rowsBetween(Window.unboundedPreceding, -1)


def so_far(window):
    """Everything up to and including the current row of ``window``."""
    return window.rowsBetween(Window.unboundedPreceding, Window.currentRow)


def assign_segments(
    rows: DataFrame, layout: Layout = LAYOUT_DEFAULT, sizing: DataFrame | None = None
) -> DataFrame:
    """Add ``segment`` and ``is_hot`` to rows that carry ``tank_id`` and ``ts_us``.

    Tanks with at most ``segment_rows`` readings are one segment. The span of a longer tank is cut into time
    cells; a cell that still holds more than that is cut again, down to single microseconds, so that bursts
    of any density are spread. Consecutive cells are then packed into segments of ``segment_rows`` readings
    plus at most one cell. Every table joined back has at most a few rows per ``segment_rows`` readings.

    ``sizing`` may be a cheaper frame with the same keys to count on, such as the rows before
    de-duplication: counting too many only makes segments smaller.
    """
    size = layout.segment_rows
    keys = (rows if sizing is None else sizing).select(TANK, TS_US)
    spans = keys.groupBy(TANK).agg(F.count("*").alias("n"), F.min(TS_US).alias("lo"), F.max(TS_US).alias("hi"))
    # Written out first: usually no tank is long, and then nothing has to be joined.
    grid = stage_table(
        spans.filter(F.col("n") > size).select(TANK, "lo", _cell_width(F.col("hi") - F.col("lo") + 1, layout))
    )
    if grid.isEmpty():
        return rows.withColumns({HOT: F.lit(False), SEGMENT: F.lit(0).cast("bigint")})

    cut = F.floor((F.col(TS_US) - F.col("lo")) / F.col("cell_us")) * F.col("cell_us") + F.col("lo")
    on_tank = grid
    placed = keys.join(on_tank, TANK).select(TANK, TS_US, cut.alias("cell"), F.col("cell_us").alias("width"))
    finer: list[DataFrame] = []
    leaves = None
    while True:
        counts = stage_table(placed.groupBy(TANK, "cell", "width").agg(F.count("*").alias("n")))
        crowded = (F.col("n") > size) & (F.col("width") > 1)
        done = counts.filter(~crowded).select(TANK, "cell", "n")
        leaves = done if leaves is None else leaves.unionByName(done)
        grid = stage_table(counts.filter(crowded).select(TANK, "cell", _cell_width(F.col("width"), layout)))
        if grid.isEmpty():
            break
        finer.append(grid)
        # Only rows of crowded cells are counted again.
        placed = placed.drop("width").join(grid, [TANK, "cell"]).select(
            TANK, TS_US, _finer_cell().alias("cell"), F.col("cell_us").alias("width")
        )
    along = Window.partitionBy(TANK).orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    packed = leaves.select(
        TANK, "cell", F.floor(F.coalesce(F.sum("n").over(along), F.lit(0)) / size).alias(SEGMENT)
    )
    out = rows.join(on_tank, TANK, "left").withColumn("cell", cut).withColumn(HOT, F.col("lo").isNotNull())
    out = out.drop("lo", "cell_us")
    for grid in finer:
        out = out.join(grid, [TANK, "cell"], "left").withColumn("cell", _finer_cell()).drop("cell_us")
    return (
        out.join(packed, [TANK, "cell"], "left")
        .withColumn(SEGMENT, F.coalesce(F.col(SEGMENT), F.lit(0).cast("bigint")))
        .drop("cell")
    )


def _cell_width(span: Column, layout: Layout) -> Column:
    """Width that splits ``n`` evenly spread readings into cells of a fraction of a segment."""
    share = F.lit(float(layout.segment_rows)) / (F.col("n") * layout.cells_per_segment)
    return F.greatest(F.ceil(span * share), F.lit(1).cast("bigint")).alias("cell_us")


def _finer_cell() -> Column:
    """Start of the finer cell of a row whose cell was cut again; the cell itself otherwise."""
    step = F.floor((F.col(TS_US) - F.col("cell")) / F.col("cell_us")) * F.col("cell_us")
    return F.coalesce(F.col("cell") + step, F.col("cell"))


def has_long_tanks(df: DataFrame) -> bool:
    """Whether any tank spans several segments.

    On a staged table this reads one Boolean column, pruned by its row-group statistics, and spares the
    usual case everything that deals with segment borders.
    """
    return not df.filter(F.col(HOT)).select(HOT).isEmpty()


def summarise(df: DataFrame, *aggregates: Column) -> DataFrame:
    """One summary row per segment."""
    return df.groupBy(*SEGMENT_KEYS).agg(*aggregates)


def attach(df: DataFrame, context: DataFrame) -> DataFrame:
    """Join per-segment context back to the rows; co-partitioned with them on (tank, segment)."""
    return df.join(context, SEGMENT_KEYS, "left")


def with_tank_values(context: DataFrame, per_tank: DataFrame) -> DataFrame:
    """Put per-tank values on the segment summary, so rows never join on the (skewed) tank alone."""
    return context.join(per_tank, TANK, "left")
