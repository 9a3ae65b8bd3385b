"""Bounded replays: feed stored rows to a streaming job in time order, as a restartable query."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidewell.functions.scalars import micros
from tidewell.plans.lake import staging_root


#: Settings of the state store that jobs with keyed state need, for queries started by a user as well.
STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


@contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """Queries started inside keep their state in RocksDB, with the log of changes as checkpoint; later ones as before."""
    before = {k: spark.conf.get(k, None) for k in STATE_STORE}
    for k, v in STATE_STORE.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def replay(
    df: DataFrame, time_column: str, job: Callable[[DataFrame], DataFrame], chunks: int = 3, closing_row: bool = False,
    shuffled_us: int = 0,
) -> DataFrame:
    """Result of ``job`` over ``df`` delivered as ``chunks`` consecutive deliveries.

    Every delivery appends files to the source folder and restarts the query from its checkpoint until all
    input is used, so state, watermark and sink carry over as they would across restarts. ``closing_row``
    delivers one more row far in the future, which pushes the watermark past every real one; its own window
    stays open and is never emitted. ``shuffled_us`` deals the rows by times that are later by up to so many
    microseconds, each by a hash of its own, so that deliveries overlap.
    """
    spark = df.sparkSession
    root = f"{staging_root(spark)}/replay_{uuid.uuid4().hex}"
    stream = job(_source(df, f"{root}/in"))
    for part in _deliveries(df, time_column, chunks, closing_row, shuffled_us):
        part.write.mode("append").parquet(f"{root}/in")
        with state_store(spark):
            query = (
                stream.writeStream.format("parquet")
                .option("path", f"{root}/out")
                .option("checkpointLocation", f"{root}/checkpoint")
                .outputMode("append")
                .trigger(availableNow=True)
                .start()
            )
            query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{root}/out")


def _source(df: DataFrame, path: str) -> DataFrame:
    spark = df.sparkSession
    # The folder must exist before the stream is defined.
    df.limit(0).write.mode("overwrite").parquet(path)
    return spark.readStream.schema(df.schema).parquet(path)


def _deliveries(df: DataFrame, time_column: str, chunks: int, closing_row: bool, shuffled_us: int) -> list[DataFrame]:
    at = micros(F.col(time_column))
    if shuffled_us:
        at = at + F.pmod(F.xxhash64(*df.columns), F.lit(shuffled_us))
    shares = [i / chunks for i in range(1, chunks)]
    edges = df.agg(F.approx_percentile(at, F.array(*map(F.lit, shares)), 1000)).first()[0] if shares else []
    low, parts = None, []
    for high in [*(edges or []), None]:
        part = df
        if low is not None:
            part = part.filter(at > low)
        if high is not None:
            part = part.filter(at <= high if low is not None else at.isNull() | (at <= high))
        parts.append(part)
        low = high
    if closing_row:
        last = df.agg(F.max(time_column).alias("m")).withColumn("m", F.col("m") + F.expr("interval 1000 days"))
        fields = [
            (F.col("m") if f.name == time_column else F.lit(None).cast(f.dataType)).alias(f.name)
            for f in df.schema.fields
        ]
        parts.append(last.select(*fields))
    return parts
