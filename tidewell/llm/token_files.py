"""Token ids as flat binary files with 64-bit document offsets.

A store is a folder of parts in ascending id order. Part ``p`` is three flat little-endian files: ``tokens`` (unsigned
16- or 32-bit ids, by vocabulary size), ``offsets`` (int64, where each document starts in the whole store, one more
than documents) and ``docs`` (int64 ids, and a byte that says whether the id is null). A part's base in the store is the
prefix sum of the parts before it, one number per part. Parts are written under names of their own by each attempt;
the manifest, a table, names those that count, so that a task that ran twice or died half way leaves nothing wrong.

Reading maps local files into memory and streams others in blocks.

Defined cases. Null or empty text: only the end id. Null ids come first, equal ids are ordered by text. Repeated rows
are documents of their own. Empty input: a store without parts. Columns other than id and text are not looked at.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tidewell.llm import tokens
from tidewell.llm.common import staged

END_ID = 0
#: Documents encoded and written at a time.
BLOCK_DOCS = 2048
#: Ids read at a time from a store that cannot be mapped.
BLOCK_IDS = 1 << 20
_DOC = np.dtype([("doc_id", "<i8"), ("null", "u1")])


def id_type(vocabulary: int) -> str:
    return "<u2" if vocabulary <= 1 << 16 else "<u4"


@dataclass(frozen=True)
class Store:
    folder: str
    dtype: str
    #: One row per part: part, name, docs, tokens, base.
    manifest: DataFrame


def _open(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)


def _map(system: fs.FileSystem, path: str, dtype: str | np.dtype) -> np.ndarray:
    """A whole small file, or a local file mapped into memory."""
    if system.get_file_info(path).size == 0:
        return np.empty(0, dtype)
    if isinstance(system, fs.LocalFileSystem):
        return np.memmap(path, dtype, mode="r")
    with system.open_input_stream(path) as f:
        return np.frombuffer(f.read(), dtype)


def write_store(
    docs: DataFrame, folder: str, tokenizer: str, spaced: bool = True, doc_id: str = "doc_id", text: str = "text",
    parts: int | None = None,
) -> Store:
    """Encode every text, append the end id, write the parts, and their offsets once the bases are known.

    Rows are range-partitioned by id: a part holds neighbouring ids, and many equal ids only make it longer.
    """
    spark = docs.sparkSession
    dtype = id_type(tokens.encoder(tokenizer, spaced).size)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder = tokens.encoder(tokenizer, spaced)
        system, base = _open(folder)
        system.create_dir(base, recursive=True)
        name = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}"
        n_docs = n_tokens = 0
        out = None
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_DOCS):
                ids_of, texts = (c.slice(at, BLOCK_DOCS) for c in batch.columns)
                if out is None:
                    out = [system.open_output_stream(f"{base}/{name}.{kind}") for kind in ("tokens", "lengths", "docs")]
                found = encoder.encode(texts.to_pylist())
                lengths = np.fromiter((len(x) + 1 for x in found), "<i8", len(found))
                flat = np.full(int(lengths.sum()), END_ID, dtype)
                for end, n, x in zip(np.cumsum(lengths), lengths, found, strict=True):
                    flat[end - n : end - 1] = x
                head = np.empty(len(found), _DOC)
                head["null"] = ids_of.is_null().to_numpy(zero_copy_only=False)
                head["doc_id"] = ids_of.fill_null(0).to_numpy(zero_copy_only=False)
                for f, data in zip(out, (flat, lengths, head), strict=True):
                    f.write(data.tobytes())
                n_docs, n_tokens = n_docs + len(found), n_tokens + len(flat)
        for f in out or ():
            f.close()
        if out:
            yield pa.RecordBatch.from_pydict({
                "part": pa.array([TaskContext.get().partitionId()], pa.int32()), "name": [name],
                "docs": pa.array([n_docs], pa.int64()), "tokens": pa.array([n_tokens], pa.int64()),
            })

    written = staged(ordered.mapInArrow(write, "part int, name string, docs long, tokens long"), "token-parts")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per part
    based = staged(written.withColumn("base", F.coalesce(F.sum("tokens").over(before), F.lit(0))), "token-bases")
    return Store(folder, dtype, _with_offsets(based, folder))


def _with_offsets(manifest: DataFrame, folder: str) -> DataFrame:
    """Write each part's document offsets in the whole store; returns the manifest."""

    def offsets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = _open(folder)
        for batch in batches:
            for row in batch.to_pylist():
                lengths = _map(system, f"{root}/{row['name']}.lengths", "<i8")
                starts = np.concatenate([[0], np.cumsum(lengths)]) + row["base"]
                own = f"{row['name']}-{uuid.uuid4().hex}.offsets"
                with system.open_output_stream(f"{root}/{own}") as f:
                    f.write(starts.astype("<i8").tobytes())
                row["offsets"] = own
                yield pa.RecordBatch.from_pylist([row], schema=batch.schema.append(pa.field("offsets", pa.string())))

    spread = manifest.repartition(manifest.sparkSession.sparkContext.defaultParallelism, "part")
    schema = "part int, name string, docs long, tokens long, base long, offsets string"
    return staged(spread.mapInArrow(offsets, schema), "token-manifest")


def read_store(spark: SparkSession, store: Store) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) from the files alone; crc32 of the ids as unsigned 32-bit integers."""
    folder, dtype = store.folder, store.dtype

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = _open(folder)
        for batch in batches:
            for row in batch.to_pylist():
                path = f"{root}/{row['name']}"
                heads = _map(system, f"{path}.docs", _DOC)
                starts = _map(system, f"{root}/{row['offsets']}", "<i8")
                sums = np.empty(len(heads), np.int64)
                for k, ids in enumerate(_documents(system, f"{path}.tokens", dtype, starts - row["base"])):
                    sums[k] = ids
                for at in range(0, len(heads), 1 << 16):
                    to = min(len(heads), at + (1 << 16))
                    yield pa.RecordBatch.from_pydict({
                        "doc_id": pa.array(heads["doc_id"][at:to], pa.int64(), mask=heads["null"][at:to] != 0),
                        "start": pa.array(starts[at:to]), "n_tokens": pa.array(np.diff(starts[at : to + 1])),
                        "ids_crc32": pa.array(sums[at:to]),
                    })

    parts = store.manifest.repartition(max(1, store.manifest.count()), "part")
    return parts.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _documents(system: fs.FileSystem, path: str, dtype: str, starts: np.ndarray) -> Iterator[int]:
    """crc32 of each document's ids, in order; at most a block of ids is held."""
    width = np.dtype(dtype).itemsize
    if isinstance(system, fs.LocalFileSystem):
        flat = _map(system, path, dtype)

        def block(a: int, b: int) -> np.ndarray:
            return flat[a:b]
    else:
        file = system.open_input_file(path)

        def block(a: int, b: int) -> np.ndarray:
            return np.frombuffer(file.read_at((b - a) * width, a * width), dtype)

    for a, b in zip(starts[:-1], starts[1:], strict=True):
        crc = 0
        for x in range(int(a), int(b), BLOCK_IDS):
            crc = zlib.crc32(block(x, min(int(b), x + BLOCK_IDS)).astype("<u4").tobytes(), crc)
        yield crc
