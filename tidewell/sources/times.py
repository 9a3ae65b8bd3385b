"""Times in text columns: one layout a file, found by counting which one reads most of its cells.

A file is never read in two layouts. Cells that do not fit its layout are unreadable, as is everything where no layout
fits. Where two layouts read equally many cells, as days first and months first do if no day is above 12, the file is
refused unless the caller says which one is meant. Text with a zone is converted to ``UTC``; nothing depends on the
zone of the session, as times are put together from their numbers.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame, functions as F

from tidewell.contract import TIME, DataValidationError
from tidewell.functions.scalars import from_micros
from tidewell.plans.lake import stage_table

#: Names the file a row comes from, where its source is files.
SOURCE = "source_file"

_CLOCK = r"(?:(?:T|,?\s+)(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d{1,9}))?)?\s*([AaPp]\.?[Mm]\.?)?)?\s*(Z|UTC|GMT|[+-]\d{2}:?\d{2})?"
_MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec"
#: Pattern, and where year, month and day are among its first three groups; hours to zone follow as groups 4 to 9.
_DATED = {
    "year_first": (rf"^(\d{{4}})[-/.](\d{{1,2}})[-/.](\d{{1,2}}){_CLOCK}$", (1, 2, 3)),
    "compact": (r"^(\d{4})(\d{2})(\d{2})(?:[T ]?(\d{2}):?(\d{2}):?(\d{2})?)?()()()$", (1, 2, 3)),
    "month_first": (rf"^(\d{{1,2}})[-/.](\d{{1,2}})[-/.](\d{{4}}){_CLOCK}$", (3, 1, 2)),
    "day_first": (rf"^(\d{{1,2}})[-/.](\d{{1,2}})[-/.](\d{{4}}){_CLOCK}$", (3, 2, 1)),
    "month_name": (rf"^([A-Za-z]{{3,9}})\.?\s+(\d{{1,2}}),?\s+(\d{{4}}){_CLOCK}$", (3, 1, 2)),
    "day_name": (rf"^(\d{{1,2}})[-\s]([A-Za-z]{{3,9}})\.?[-,\s]+(\d{{4}}){_CLOCK}$", (3, 2, 1)),
}
#: Seconds, milliseconds or microseconds since 1970, told apart by their digits.
_EPOCH = r"^(\d{10}(\.\d{1,6})?|\d{13}|\d{16})$"


def _dated(text: Column, pattern: str, places: tuple[int, int, int]) -> Column:
    groups = "|".join(f"${k}" for k in (*places, 4, 5, 6, 7, 8, 9))
    parts = F.split(F.regexp_replace(text, pattern, groups), r"\|")
    # the array of one binds the parts, so that they are split once
    return F.when(text.rlike(pattern), F.transform(F.array(parts), _assembled)[0])


def _assembled(part: Column) -> Column:
    number = lambda k: F.when(part[k] == "", 0).otherwise(part[k].try_cast("int"))
    month = F.when(
        part[1].rlike("[A-Za-z]"), F.ceil(F.instr(F.lit(_MONTHS), F.lower(F.substring(part[1], 1, 3))) / 4).cast("int")
    ).otherwise(number(1))
    hour, half = number(3), F.lower(F.substring(part[7], 1, 1))
    hour = F.when(half == "", hour).when(hour.between(1, 12), hour % 12 + F.when(half == "p", 12).otherwise(0))
    second = F.concat(F.when(part[5] == "", "0").otherwise(part[5]), F.lit("."), F.rpad(F.substring(part[6], 1, 6), 6, "0"))
    naive = F.try_make_timestamp_ntz(number(0), month, number(2), hour, number(4), second.try_cast("decimal(8,6)"))
    digits = F.regexp_replace(part[8], "[^0-9]", "")
    minutes = F.when(digits == "", 0).otherwise(
        F.substring(digits, 1, 2).try_cast("int") * 60 + F.substring(digits, 3, 2).try_cast("int")
    ) * F.when(part[8].startswith("-"), -1).otherwise(1)
    return naive - F.make_dt_interval(mins=minutes)


def _epoch(text: Column) -> Column:
    digits = F.length(F.regexp_extract(text, r"^(\d+)", 1))
    scale = F.when(digits == 10, 1_000_000).when(digits == 13, 1_000).otherwise(1)
    return F.when(text.rlike(_EPOCH), from_micros((text.try_cast("decimal(26,6)") * scale).cast("bigint")))


#: Every layout's reader: text to a naive timestamp, NULL where it does not fit.
LAYOUTS: dict[str, Callable[[Column], Column]] = {
    **{name: partial(_dated, pattern=pattern, places=places) for name, (pattern, places) in _DATED.items()}, "epoch": _epoch,
}


def vote(df: DataFrame, column: str = TIME) -> DataFrame:
    """(source_file, cells, reads, layouts): per file how many cells there are, how many its best layouts read, and which.

    One pass over the column; what is shuffled is one row per task and file.
    """
    text = F.trim(F.col(column).cast("string"))
    source = F.col(SOURCE) if SOURCE in df.columns else F.lit("")
    read = {name: F.count_if(layout(F.col("text")).isNotNull()).alias(name) for name, layout in LAYOUTS.items()}
    counted = df.select(source.alias(SOURCE), text.alias("text")).groupBy(SOURCE).agg(F.count("text").alias("cells"), *read.values())
    best = F.greatest(*LAYOUTS)
    return counted.select(
        SOURCE, "cells", best.alias("reads"),
        F.filter(F.array(*(F.when((F.col(n) == best) & (best > 0), F.lit(n)) for n in LAYOUTS)), lambda n: n.isNotNull()).alias("layouts"),
    )


def settle(votes: DataFrame, prefer: str | None = None) -> DataFrame:
    """(source_file, layout): the layout with most votes; of several the preferred one, without one of those an error.

    A file that no layout reads has none.
    """
    chosen = F.when(F.size("layouts") == 1, F.col("layouts")[0])
    if prefer is not None:
        chosen = chosen.when(F.array_contains("layouts", prefer), F.lit(prefer))
    settled = stage_table(votes.withColumn("layout", chosen))
    open_ = settled.filter(F.col("layout").isNull() & (F.size("layouts") > 1)).limit(3).collect()
    if open_:
        named = "; ".join(f"{r[SOURCE] or 'the frame'}: {' or '.join(r['layouts'])}" for r in open_)
        raise DataValidationError(f"the layout of times is not certain, say which one is preferred ({named})")
    return settled.select(SOURCE, "layout")


def with_times(df: DataFrame, layout: str | None = None, prefer: str | None = None, column: str = TIME) -> DataFrame:
    """The frame with ``column`` as TIMESTAMP_NTZ, NULL where unreadable.

    ``layout`` forces one of :data:`LAYOUTS`; otherwise each file's is found by vote, and ``prefer`` settles ties. Zoned
    timestamps are converted to UTC. A stream cannot vote: its text is read years first unless a layout is given.
    """
    kind = dict(df.dtypes)[column]
    if kind == "timestamp_ntz":
        return df
    if kind == "timestamp":
        return df.withColumn(column, from_micros(F.unix_micros(column)))
    if kind == "date":
        return df.withColumn(column, F.col(column).cast("timestamp_ntz"))
    text = F.trim(F.col(column).cast("decimal(26,6)" if kind in ("double", "float") else "string").cast("string"))
    if layout is None and df.isStreaming:
        layout = "year_first"
    if layout is not None:
        return df.withColumn(column, LAYOUTS[layout](text))
    settled = settle(vote(df.withColumn(column, text), column), prefer)
    found = [r[0] for r in settled.select("layout").distinct().collect()]  # as many as there are layouts at most
    if len(found) <= 1:
        only = LAYOUTS[found[0]](text) if found and found[0] else F.lit(None).cast("timestamp_ntz")
        return df.withColumn(column, only)
    read = F.lit(None).cast("timestamp_ntz")
    for name in found:
        if name:
            read = F.when(F.col("layout") == name, LAYOUTS[name](text)).otherwise(read)
    order = df.columns
    return df.join(settled, SOURCE, "left").withColumn(column, read).select(*order)
