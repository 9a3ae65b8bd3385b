"""Staged tables: cut lineage by writing to the cluster's shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from tidewell.contract import SEGMENT_KEYS, TS_US


def staging_root(spark: SparkSession) -> str:
    """Shared folder for staged tables: ``spark.checkpoint.dir``, or a scratch folder on local masters."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        root = tempfile.mkdtemp(prefix="run-", dir="/tmp")
        spark.sparkContext.setCheckpointDir(root)
    return root


def bucket_count(spark: SparkSession) -> int:
    """Buckets of a staged series table; one bucket becomes one task of every later stage."""
    return int(
        spark.conf.get("tidewell.series.buckets", None) or spark.conf.get("spark.sql.shuffle.partitions")
    )


def stage_series(df: DataFrame) -> DataFrame:
    """Write a segmented frame bucketed and sorted by (tank, segment, time) and read it back.

    The one shuffle by (tank, segment) happens here. Bucketed scans then satisfy every later window,
    segment summary and segment join without moving the rows again, and Parquet keeps column pruning.
    """
    spark = df.sparkSession
    n = bucket_count(spark)
    name = f"tidewell_{uuid.uuid4().hex}"
    database = spark.conf.get("tidewell.series.database", None)
    table = f"{database}.{name}" if database else name
    (
        df.repartition(n, *SEGMENT_KEYS)
        .sortWithinPartitions(*SEGMENT_KEYS, TS_US)
        .write.mode("overwrite")
        .bucketBy(n, *SEGMENT_KEYS)
        .sortBy(*SEGMENT_KEYS, TS_US)
        .option("path", f"{staging_root(spark)}/{name}")
        .saveAsTable(table)
    )
    return spark.table(table)


def stage_table(df: DataFrame) -> DataFrame:
    """Write any frame as plain Parquet in the staging folder and read it back."""
    spark = df.sparkSession
    path = f"{staging_root(spark)}/tidewell_{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
