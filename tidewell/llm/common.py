"""Small helpers the training-data operators share: tables, the shared folder, words."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Bytes A-Z to a-z; every other byte, so also UTF-8 beyond ASCII, stays.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
UPPER_LETTERS, LOWER_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Rows turned into Python objects at a time; Arrow batches hold up to 64 MB.
SLICE = 1024


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the cluster's ``spark.checkpoint.dir``.

    Only a local master without that setting gets a scratch folder, as in tests.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
        root = tempfile.mkdtemp(prefix="run-")
        spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/llm-{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write a frame to the shared folder and read it back: cuts lineage, survives lost executors."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. ``lower`` does the same, faster, where all characters are ASCII."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER_LETTERS, LOWER_LETTERS)
    )


def id_remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text modulo ``modulus``; a missing id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def per_batch(df: DataFrame, work: Callable[[dict[str, pa.Array]], dict | None], schema: str) -> DataFrame:
    """``mapInArrow`` for work that turns the columns of one batch into columns of one batch."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    out = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, SLICE) for b in batches for at in range(0, b.num_rows, SLICE)):
            if batch.num_rows:
                made = work({name: batch.column(i) for i, name in enumerate(batch.schema.names)})
                if made is not None:
                    yield pa.RecordBatch.from_arrays(
                        [x.cast(f.type) if isinstance(x, pa.Array) else pa.array(x, f.type)
                         for x, f in ((made[f.name], f) for f in out)], schema=out,
                    )

    return df.mapInArrow(run, schema)
