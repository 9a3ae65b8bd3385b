"""Column expressions shared by the operators. All JVM-side."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tidewell.contract import MISSING_TEXT

_NUMBER = r"^\s*[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|inf|infinity|nan)\s*$"


def no_nan(c: Column) -> Column:
    """NaN becomes NULL; Spark orders NaN above every number, so none may reach a comparison."""
    return F.nanvl(c, F.lit(None).cast("double"))


def finite(c: Column) -> Column:
    """NULL unless the value is a finite number."""
    clean = no_nan(c.cast("double"))
    return F.when(F.abs(clean) < F.lit(float("inf")), clean)


def text_or_missing(c: Column) -> Column:
    """CSV cell with the reader's missing-value words mapped to NULL."""
    return F.when(~c.isin(MISSING_TEXT), c)


def to_number(c: Column, dtype: str) -> Column:
    """Coerce to DOUBLE; anything that is not a plain number becomes NULL."""
    if dtype == "string":
        # Java also parses '1.0d' and '1f'; the pattern keeps those out.
        c = F.when(F.lower(c).rlike(_NUMBER), c).try_cast("double")
    else:
        c = c.try_cast("double")
    return no_nan(c)


def micros(c: Column) -> Column:
    """Microseconds since the epoch of a naive timestamp, independent of the session time zone."""
    day = F.unix_date(c.cast("date")).cast("bigint")
    seconds = day * 86400 + F.hour(c) * 3600 + F.minute(c) * 60
    fraction = F.extract(F.lit("SECOND"), c) * F.lit(1_000_000)
    return seconds * 1_000_000 + fraction.cast("bigint")


def from_micros(c: Column) -> Column:
    """Inverse of :func:`micros` at whole-second and microsecond precision."""
    return F.expr("timestamp_ntz'1970-01-01 00:00:00'") + F.make_dt_interval(
        secs=(c / F.lit(1_000_000)).cast("decimal(18,6)")
    )


def truncate_hour(c: Column) -> Column:
    """Start of the hour of a naive timestamp (date_trunc would leave NTZ for a zoned type)."""
    hours = F.floor(micros(c) / F.lit(3_600_000_000))
    return F.timestamp_add("HOUR", hours.cast("int"), F.expr("timestamp_ntz'1970-01-01 00:00:00'"))


def at_least(c: Column, low: Column | float) -> Column:
    """Lower clip that keeps NULL (greatest() would drop it)."""
    low = low if isinstance(low, Column) else F.lit(float(low))
    return F.when(c < low, low).otherwise(c)


def clip(c: Column, low: Column | float, high: Column | float) -> Column:
    """Two-sided clip that keeps NULL."""
    low = low if isinstance(low, Column) else F.lit(float(low))
    high = high if isinstance(high, Column) else F.lit(float(high))
    return F.when(c > high, high).when(c < low, low).otherwise(c)


def fixed(c: Column, places: int = 0) -> Column:
    """Number as text with a fixed count of decimals, ties to even."""
    return F.when(c.isNotNull(), F.format_string(f"%.{places}f", F.bround(c, places)))


def flag(c: Column) -> Column:
    """Three-valued condition as plain true/false."""
    return F.coalesce(c, F.lit(False))


def display(c: Column, places: int) -> Column:
    """Rounded for a report. The nudge keeps noise in the last digits from deciding a decimal tie."""
    return F.round(c.cast("double") + F.lit(1e-9), places)
