"""Exact order statistics and linear-interpolated quantiles, safe for groups of any size.

``percentile`` keeps every distinct value of a group in one task. That is fine for groups of proven size
and wrong for a group holding a third of all rows. For those, ranks are found by narrowing: rows are counted
per order-preserving bin of their value, only the bins that hold a wanted rank are kept and cut finer, until a
bin holds hardly two neighbouring doubles; then the wanted value is read off the distinct values left. Each step
is an aggregate by bin with map-side combining; no step sorts, gathers or shuffles a group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidewell.plans.lake import stage_table

#: Mantissa bits of each round; the widest key still fits 63 bits.
_BITS = (12, 32, 51)
#: Added to binary exponents (-1074 to 1023; 1024 stands for infinity) to make them positive.
_EXPONENT_SPAN = 1075


def _prefix(value: Column, bits: int) -> Column:
    """Monotone integer key: sign, binary exponent and the first ``bits`` mantissa bits."""
    size = F.abs(value)
    exponent = F.greatest(F.least(F.floor(F.log2(size)), F.lit(1023)), F.lit(-1074))
    scale = 2**bits
    infinite = F.lit((1024 + _EXPONENT_SPAN) * scale)
    # If log2 rounds across a power of two, the mantissa part leaves [0, scale) by exactly the amount
    # that puts the key back into the right bin, so the key stays monotone.
    mantissa = F.floor((size / F.pow(F.lit(2.0), exponent) - 1.0) * scale)
    key = F.when(size == float("inf"), infinite).otherwise((exponent + _EXPONENT_SPAN) * scale + mantissa)
    return F.when(value == 0, F.lit(0).cast("bigint")).when(value > 0, key).otherwise(-key)


def order_statistics(values: DataFrame, keys: list[str], ranks: DataFrame) -> DataFrame:
    """Exact k-th smallest values.

    ``values`` has ``keys`` and ``value`` (never NULL); ``ranks`` has ``keys``, ``rank_name`` and the
    0-based ``rank``. Returns ``ranks`` with ``value``. Ranks outside a group yield no row.
    """
    pool, held = values, []
    wanted = ranks.withColumn("below", F.lit(0).cast("bigint"))
    for bits in (*_BITS, None):
        name = f"bin_{bits}" if bits else "value"
        if bits:
            pool = pool.withColumn(name, _prefix(F.col("value"), bits))
        counted = pool.groupBy(*keys, *held, name).agg(F.count("*").alias("in_bin"))
        wanted = _locate(counted, wanted, keys + held, name, "in_bin")
        if bits:
            # The next round sees only rows of the bins that were hit: a row per rank, written so that rounds add up
            # instead of repeating each other.
            held = held + [name]
            wanted = stage_table(wanted)
            pool = pool.join(wanted.select(*keys, *held).distinct(), keys + held)
    located = wanted
    return located.select(*keys, "rank_name", "rank", "value")


def _locate(
    slots: DataFrame, wanted: DataFrame, group: list[str], slot: str, size: str
) -> DataFrame:
    """For each wanted rank, the slot whose cumulative count covers it; ``below`` counts earlier rows."""
    along = Window.partitionBy(*group).orderBy(slot).rowsBetween(Window.unboundedPreceding, -1)
    placed = slots.withColumn("before", F.coalesce(F.sum(size).over(along), F.lit(0).cast("bigint")))
    position = F.col("rank") - F.col("below")
    hit = (position >= F.col("before")) & (position < F.col("before") + F.col(size))
    return (
        wanted.join(placed, group)
        .filter(hit)
        .withColumn("below", F.col("below") + F.col("before"))
        .drop("before", size)
    )


def exact_quantiles(values: DataFrame, keys: list[str], probabilities: dict[str, float]) -> DataFrame:
    """Linear-interpolated quantiles of ``value`` per ``keys`` for groups of any size.

    Returns one row per group with one column per entry of ``probabilities``.
    """
    sizes = values.groupBy(*keys).agg(F.count("*").alias("n"))
    points = F.array(
        *[F.struct(F.lit(name).alias("q"), F.lit(float(p)).alias("p")) for name, p in probabilities.items()]
    )
    at = (F.col("n") - 1) * F.col("point.p")
    spots = sizes.withColumn("point", F.explode(points)).select(
        *keys, F.col("point.q").alias("q"), at.alias("at")
    )
    low, high = F.floor("at"), F.ceil("at")
    ranks = spots.select(
        *keys,
        F.explode(F.array_distinct(F.array(low, high))).alias("rank"),
    ).distinct().withColumn("rank_name", F.lit("r"))
    found = order_statistics(values, keys, ranks)
    pairs = spots.join(found.select(*keys, "rank", "value"), keys).filter(
        (F.col("rank") == low) | (F.col("rank") == high)
    )
    weight = F.col("at") - F.floor("at")
    lower, upper = F.min("value"), F.max("value")
    share = F.first(weight)
    between = F.when(lower == upper, lower).otherwise(lower + (upper - lower) * share)  # also where both are infinite
    per_point = pairs.groupBy(*keys, "q").agg(between.alias("v"))
    return per_point.groupBy(*keys).agg(
        *[F.max(F.when(F.col("q") == name, F.col("v"))).alias(name) for name in probabilities]
    )
