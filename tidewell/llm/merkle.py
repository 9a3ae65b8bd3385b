"""Fixity audit of WARC replicas with Merkle trees.

A leaf hashes a record's bytes and length, not its offset: a record that grew moves all behind it without making them
differ. Records of a file, in order, are the leaves of a tree; ``FANOUT`` neighbouring nodes make one node above, whose
hash covers theirs in order and whose range runs from the first offset to the last end. Trees are a table (file, level,
node), built level by level with map-side work on small rows; record bodies are hashed where they are read and never
move. Two replicas are compared from the roots down: only children of nodes that differ are joined on the next level.
Records left at the bottom are aligned by their hashes, which finds those that lie elsewhere because records before them
were added or lost; between aligned neighbours, what is left over on both sides is paired in order.

Status of what is reported, and ``shift``, by how many bytes it moves what follows: ``changed`` (other bytes; shift: other
length), ``missing`` (only in the first replica), ``extra`` (only in the second; numbered and placed as there), and
``shifted``: a run of sound neighbouring records with another number, one row for the run (first record; shift: of its offset).

Defined cases. A null body is an empty record. Files that only one replica has are damaged throughout. Equal records of a
file are aligned first to first, second to second. Equal (file, record_no) in one replica is an error of the
input; records made from pages are numbered without ties. Empty replicas have no damage. Other columns are not read.
"""

from __future__ import annotations

import gzip
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tidewell.llm.common import staged

FANOUT = 16
#: Pages of one WARC file made from a table.
FILE_PAGES = 1000
RECORDS = "file string, record_no long, offset long, length long, digest string"


def page_record(page_id: Column, url: Column, body: Column) -> Column:
    """The bytes of a response record: header, body, two line ends. Fixed values of the WARC format."""
    body = F.coalesce(body, F.lit(""))
    header = F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")),
        F.lit(">\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")), F.lit("\r\nContent-Length: "),
        F.octet_length(body).cast("string"), F.lit("\r\n\r\n"),
    )
    return F.concat(header, body, F.lit("\r\n\r\n"))


def page_records(pages: DataFrame, page_id: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """The records of ``pages`` as WARC files of neighbouring ids; pages without an id are dealt out by their hash."""
    record = page_record(F.col(page_id), F.col(url), F.col(page))
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), record.alias("record")).select(
        "page_id", F.octet_length("record").cast("long").alias("length"), F.sha2("record", 256).alias("digest")
    )
    number = F.floor(F.col("page_id") / FILE_PAGES)
    rows = rows.withColumn(
        "file", F.concat(F.lit("pages-"), F.coalesce(
            number.cast("string"), F.concat(F.lit("none-"), F.pmod(F.xxhash64("digest"), F.lit(4096)).cast("string"))
        ), F.lit(".warc"))
    )
    order = Window.partitionBy("file").orderBy("page_id", "digest")
    return rows.select(
        "file", (F.row_number().over(order) - 1).cast("long").alias("record_no"),
        F.coalesce(F.sum("length").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("offset"),
        "length", "digest", "page_id",
    )


def read_warc(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The records of WARC files (plain or gzip) as they lie there, read in one stream a file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            for path in batch.column(0).to_pylist():
                system, own = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
                with system.open_input_stream(own, compression=None) as raw:
                    stream = gzip.GzipFile(fileobj=raw) if path.endswith(".gz") else raw
                    found = list(_parsed(stream))
                yield pa.RecordBatch.from_pylist(
                    [{"file": path.rsplit("/", 1)[-1], "record_no": k, "offset": o, "length": n, "digest": d}
                     for k, (o, n, d) in enumerate(found)],
                    schema=pa.schema([("file", pa.string()), ("record_no", pa.int64()), ("offset", pa.int64()),
                                      ("length", pa.int64()), ("digest", pa.string())]),
                )

    files = spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(1, len(paths)), "path")
    return files.mapInArrow(run, RECORDS)


def _parsed(stream) -> Iterator[tuple[int, int, str]]:
    """(offset, length, SHA-256) of each record; a record cut off by the end of the file is as long as it is."""
    offset, held = 0, b""

    def more(n: int) -> bytes:
        nonlocal held
        while len(held) < n and (data := stream.read(max(n - len(held), 1 << 16))):
            held += data
        out, held = held[:n], held[n:]
        return out

    while True:
        head = b""
        while not head.endswith(b"\r\n\r\n") and (c := more(1)):
            head += c
        if not head:
            return
        size = next(
            (int(x.split(b":", 1)[1]) for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:")), 0
        )
        seen, length, left = hashlib.sha256(head), len(head), size + 4
        while left and (data := more(min(left, 1 << 20))):
            seen.update(data)
            length, left = length + len(data), left - len(data)
        yield offset, length, seen.hexdigest()
        offset += length


def build_tree(records: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """(file, level, node, first, end, hash) of all nodes; level 0 are the records."""
    level = staged(records.select(
        "file", F.lit(0).alias("level"), F.col("record_no").alias("node"), F.col("offset").alias("first"),
        (F.col("offset") + F.col("length")).alias("end"),
        F.sha2(F.concat_ws("|", "length", "digest"), 256).alias("hash"),
    ), "merkle")
    tree, widest = level, level.agg(F.max("node")).first()[0] or 0
    depth = 0
    while widest > 0:
        depth, widest = depth + 1, widest // fanout
        children = F.array_sort(F.collect_list(F.struct("node", "hash")))  # at most ``fanout``
        level = level.groupBy("file", F.floor(F.col("node") / fanout).alias("up")).agg(
            F.min("first").alias("first"), F.max("end").alias("end"), children.alias("below")
        ).select(
            "file", F.lit(depth).alias("level"), F.col("up").alias("node"), "first", "end",
            F.sha2(F.array_join(F.transform("below", lambda c: c["hash"]), "|"), 256).alias("hash"),
        )
        tree = tree.unionByName(level)
    return staged(tree, "merkle-tree")


def find_damage(left: DataFrame, right: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """(file, record_no, status, first, end, shift) of the records in which two trees differ."""
    top = [t.agg(F.max("level")).first()[0] or 0 for t in (left, right)]
    high = max(top)

    def at(tree: DataFrame, level: int, highest: int, side: str) -> DataFrame:
        # above its own root, the lower tree's root stands for itself
        own = tree.filter(F.col("level") == min(level, highest))
        return own.select("file", "node", *(F.col(c).alias(f"{side}_{c}") for c in ("first", "end", "hash")))

    frontier = None
    for level in range(high, -1, -1):
        a, b = at(left, level, top[0], "l"), at(right, level, top[1], "r")
        if frontier is not None:
            up = F.floor(F.col("node") / fanout)
            a, b = (
                x.withColumn("up", up if level < t else F.lit(0).cast("long")).join(frontier, ["file", "up"], "left_semi").drop("up")
                for x, t in ((a, top[0]), (b, top[1]))
            )
        met = a.join(b, ["file", "node"], "full").filter(~F.col("l_hash").eqNullSafe(F.col("r_hash")))
        if level:
            frontier = staged(met.select("file", F.col("node").alias("up")), "merkle-frontier")
    return _aligned(staged(met, "merkle-leaves"))


def _aligned(met: DataFrame) -> DataFrame:
    """Status of leaves that differ from the one in their place. Groups are the differing records of one file."""

    def side(name: str) -> DataFrame:
        return met.filter(F.col(f"{name}_hash").isNotNull()).select(
            "file", "node", *(F.col(f"{name}_{c}").alias(c) for c in ("first", "end", "hash"))
        )

    def occurrence(rows: DataFrame) -> DataFrame:
        return rows.withColumn("nth", F.row_number().over(Window.partitionBy("file", "hash").orderBy("node")))

    left, right = side("l"), side("r")
    there = occurrence(right).select(
        "file", "hash", "nth", F.col("node").alias("r_node"), F.col("first").alias("r_first")
    )
    same = staged(
        occurrence(left).join(there, ["file", "hash", "nth"]).select("file", "node", "first", "end", "r_node", "r_first"),
        "merkle-same",
    )
    run = F.col("node") - F.row_number().over(Window.partitionBy("file", "moved").orderBy("node"))
    shifted = (
        same.withColumn("moved", F.col("r_node") - F.col("node")).withColumn("run", run)
        .groupBy("file", "moved", "run")
        .agg(
            F.min("node").alias("record_no"), F.min("first").alias("first"), F.max("end").alias("end"),
            F.min_by(F.col("r_first") - F.col("first"), "node").alias("shift"),
        )
        .select("file", "record_no", F.lit("shifted").alias("status"), "first", "end", "shift")
    )

    # A gap is named by the aligned record before it, numbered as in the first replica; -1 at the start of a file.
    mine = _gaps(left.join(same, ["file", "node"], "left_anti")).withColumn("gap", F.col("before"))
    known = same.select("file", F.col("r_node").alias("before"), F.col("node").alias("aligned"))
    other = _gaps(right.join(known.withColumnRenamed("before", "node"), ["file", "node"], "left_anti"))
    other = other.join(known, ["file", "before"], "left").withColumn("gap", F.coalesce("aligned", "before"))
    keys = ["file", "gap", "place"]
    named = lambda rows, p: rows.select(*keys, *(F.col(c).alias(f"{p}_{c}") for c in ("node", "first", "end")))
    pairs = named(mine, "l").join(named(other, "r"), keys, "full")
    gone, new = F.col("r_node").isNull(), F.col("l_node").isNull()
    length = lambda p: F.coalesce(F.col(f"{p}_end") - F.col(f"{p}_first"), F.lit(0))
    return pairs.select(
        "file", F.coalesce("l_node", "r_node").alias("record_no"),
        F.when(gone, "missing").when(new, "extra").otherwise("changed").alias("status"),
        F.coalesce("l_first", "r_first").alias("first"), F.coalesce("l_end", "r_end").alias("end"),
        (length("r") - length("l")).alias("shift"),
    ).unionByName(shifted)


def _gaps(rows: DataFrame) -> DataFrame:
    """Neighbouring records as one run: ``before``, the number ahead of the run, and ``place``, the number in it."""
    run = F.col("node") - F.row_number().over(Window.partitionBy("file").orderBy("node"))
    start = F.min("node").over(Window.partitionBy("file", "run"))
    return rows.withColumn("run", run).withColumn("start", start).withColumns(
        {"before": F.col("start") - 1, "place": F.col("node") - F.col("start")}
    )
