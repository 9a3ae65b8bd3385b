"""Chronological split and walk-forward folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidewell.contract import SEGMENT_KEYS, TANK, TIME, TS_US
from tidewell.functions.quantiles import order_statistics
from tidewell.plans.segments import along_tank, attach, earlier, in_segment, summarise

TRAIN_FRACTION = 0.80
CV_SPLITS = 5
#: Folds are only cut when there are more training rows than this many per fold.
ROWS_PER_FOLD = 10


def number_rows(df: DataFrame) -> DataFrame:
    """1-based ``row_index`` of every reading within its tank, and the tank's ``tank_rows``."""
    sizes = summarise(df, F.count("*").alias("n"))
    totals = sizes.groupBy(TANK).agg(F.sum("n").alias("tank_rows"))
    offsets = sizes.select(
        *SEGMENT_KEYS,
        F.coalesce(F.sum("n").over(earlier(along_tank())), F.lit(0)).alias("rows_before"),
    ).join(totals, TANK)
    index = F.row_number().over(in_segment()) + F.col("rows_before")
    return attach(df, offsets).withColumn("row_index", index).drop("rows_before")


def chronological_split(df: DataFrame, train_fraction: float = TRAIN_FRACTION) -> DataFrame:
    """Mark each tank's first rows ``train`` and the rest ``test``; never shuffled."""
    cut = F.floor(F.col("tank_rows") * F.lit(float(train_fraction)))
    part = F.when(F.col("row_index") <= cut, "train").otherwise("test")
    return number_rows(df).withColumn("split", part)


def split_summary(split: DataFrame) -> DataFrame:
    """Rows and period of both parts, per tank."""
    def of(part: str, value: Column) -> Column:
        return F.when(F.col("split") == part, value)

    return split.groupBy(TANK).agg(
        F.count_if(F.col("split") == "train").alias("train_rows"),
        F.count_if(F.col("split") == "test").alias("test_rows"),
        *[
            fn(of(part, F.col(TIME))).alias(f"{part}_{name}")
            for part in ("train", "test")
            for name, fn in (("start", F.min), ("end", F.max))
        ],
    )


def walk_forward_folds(train: DataFrame, splits: int = CV_SPLITS) -> DataFrame:
    """Expanding-window folds per tank: one row per (reading, fold) with its ``role``.

    Fold i validates the i-th of the last ``splits`` equal blocks and trains on everything before it.
    A row takes part in at most ``splits`` folds.
    """
    rows = number_rows(train).filter(F.col("tank_rows") > splits * ROWS_PER_FOLD)
    block = F.floor(F.col("tank_rows") / (splits + 1))
    first_row = F.col("tank_rows") - (splits - F.col("fold") + 1) * block
    position = F.col("row_index") - 1
    role = F.when(position < first_row, "train").when(position < first_row + block, "validate")
    folds = F.array(*[F.lit(i).cast("bigint") for i in range(1, splits + 1)])
    return (
        rows.withColumn("fold", F.explode(folds))
        .withColumn("role", role)
        .filter(F.col("role").isNotNull())
    )


# --- pooled training: cuts by time, shared by all tanks -----------------------------------------
def pooled_cuts(df: DataFrame, ranks: dict[str, Column]) -> dict[str, int]:
    """Times (in microseconds) at given 0-based ranks over all rows of all tanks.

    A pooled model must not see one tank's future through another tank, so every tank is cut at the same
    moment. For a single tank with unique times this is exactly the row cut. ``ranks`` maps names to
    expressions over the row count ``n``; a handful of numbers comes back to the driver.
    """
    pooled = df.select(F.lit(0).alias("g"), F.col(TS_US).cast("double").alias("value"))
    wanted = F.array(*[F.struct(F.lit(k).alias("k"), v.cast("bigint").alias("r")) for k, v in ranks.items()])
    spots = (
        pooled.groupBy("g")
        .agg(F.count("*").alias("n"))
        .withColumn("w", F.explode(wanted))
        .select("g", F.col("w.k").alias("rank_name"), F.col("w.r").alias("rank"))
    )
    found = order_statistics(pooled, ["g"], spots).collect()
    return {r["rank_name"]: int(r["value"]) for r in found}


def pooled_split(df: DataFrame, train_fraction: float = TRAIN_FRACTION) -> DataFrame:
    """Train before the moment at which ``train_fraction`` of all rows has been recorded, test after."""
    cut = pooled_cuts(df, {"cut": F.floor(F.col("n") * F.lit(float(train_fraction)))})["cut"]
    return df.withColumn("split", F.when(F.col(TS_US) < cut, "train").otherwise("test"))


def pooled_fold_bounds(train: DataFrame, splits: int = CV_SPLITS) -> list[tuple[int, int]] | None:
    """(first, end) validation moments of each walk-forward fold; None when there are too few rows."""
    n = F.col("n")
    block = F.floor(n / (splits + 1))
    ranks = {str(i): n - (splits - i) * block for i in range(splits)}
    ranks["last"] = n - 1
    if train.limit(splits * ROWS_PER_FOLD + 1).count() <= splits * ROWS_PER_FOLD:
        return None
    cuts = pooled_cuts(train, ranks)
    edges = [cuts[str(i)] for i in range(splits)] + [cuts["last"] + 1]
    return list(zip(edges[:-1], edges[1:]))
