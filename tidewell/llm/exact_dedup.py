"""Exact de-duplication through an extendible-hash index on shared files; DataFrame functions only.

Every row gets an index key, a hash of its normalised text (A-Z lower-cased). Copies collapse on the map side to one
entry per text, so a text that fills a third of the table is one entry. The directory addresses entries by the
leading bits of their keys: it starts with one slot and doubles; a bucket that holds more than ``capacity`` entries
splits in two. Each bucket has an owner task that writes the entries of its key range, sorted, as one file of the index.

Entries whose key occurs more than once are chained: their texts are brought together and compared byte by byte
(grouping by the text itself). A directory slot without such a key needs no comparison, and its texts are not moved.

Defined cases. Null text counts as empty; empty texts are equal. Of equal texts the row with the largest id stays,
null ids are smallest; of rows that repeat id and text exactly one stays. Empty input gives no rows. Columns other
than id and text are not looked at.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from itertools import accumulate

from pyspark.sql import Column, DataFrame, functions as F

from tidewell.llm.common import ascii_lower, shared_folder, staged

#: Entries in a bucket before it splits.
CAPACITY = 16_384
#: Most bits of a directory: 65,536 slots at most.
MAX_DEPTH = 16
#: Bits of the slots that are told apart when texts are fetched: a broadcast of at most 1,048,576 numbers.
FETCH_BITS = 20
KEY_BITS = 64


def _slot(key: Column, bits: int) -> Column:
    """The key's leading bits."""
    return F.shiftrightunsigned(key, 64 - bits) if bits else F.lit(0).cast("long")


def hash_rows(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", key_bits: int = KEY_BITS) -> DataFrame:
    """(row, doc_id, key, sha, normal): ``row`` numbers the rows, ``normal`` is the text that is compared.

    ``key_bits`` below 64 shortens the key, for tests of chains.
    """
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(doc_id).alias("doc_id"),
        F.coalesce(F.col(text), F.lit("")).alias("normal"),
    ).withColumn("normal", ascii_lower(F.col("normal")))
    key = F.xxhash64("normal").bitwiseAND(F.lit((-1 << (64 - key_bits)) if key_bits else 0))
    return rows.select("row", "doc_id", key.alias("key"), F.unhex(F.sha2(F.col("normal"), 256)).alias("sha"), "normal")


def grow_directory(
    leaves: dict[int, int], capacity: int = CAPACITY, max_depth: int = MAX_DEPTH
) -> tuple[list[tuple[int, int]], int]:
    """Buckets (first leaf, depth) in key order, and the depth to which the directory doubled.

    ``leaves`` counts entries by their ``max_depth`` leading bits, at most 65,536 numbers. A bucket of depth d covers
    the keys that share d bits. One that holds too many splits; if it is as deep as the directory, that doubles. Keys
    that agree in all these bits cannot be parted: their bucket stays overfull and is chained.
    """
    at = sorted(leaves)
    total = [0, *accumulate(leaves[k] for k in at)]

    def size(first: int, depth: int) -> int:
        return total[bisect_left(at, first + (1 << (max_depth - depth)))] - total[bisect_left(at, first)]

    buckets, depth, todo = [], 0, [(0, 0)]
    while todo:
        first, own = todo.pop()
        if size(first, own) <= capacity or own == max_depth:
            buckets.append((first, own))
            continue
        depth = max(depth, own + 1)  # a split at the directory's depth doubles it
        todo += [(first + (1 << (max_depth - own - 1)), own + 1), (first, own + 1)]
    return buckets, depth


def build_index(rows: DataFrame, capacity: int = CAPACITY, max_depth: int = MAX_DEPTH) -> DataFrame:
    """One entry per distinct (key, text hash): its rows, the row that stays, its owner; stored by owner and key."""
    entries = staged(
        rows.groupBy("key", "sha").agg(
            F.count("*").alias("n"), F.max(F.struct("doc_id", "row")).alias("keep"),
        ), "dedup-entries",
    )
    leaf = _slot(F.col("key"), max_depth)
    counted = {r[0]: r[1] for r in entries.groupBy(leaf.alias("leaf")).agg(F.count("*").alias("n")).collect()}
    buckets, _ = grow_directory(counted, capacity, max_depth)
    firsts = [first for first, _ in buckets]
    directory = rows.sparkSession.createDataFrame(
        [(k, bisect_right(firsts, k) - 1) for k in sorted(counted)], "leaf long, owner int"
    )
    path = shared_folder(rows.sparkSession, "dedup-index")
    owned = entries.withColumn("leaf", leaf).join(F.broadcast(directory), "leaf").drop("leaf")
    owned.repartitionById(len(buckets), F.col("owner")).sortWithinPartitions("key", "sha").write.parquet(path)
    return rows.sparkSession.read.schema(owned.schema).parquet(path)


def compare_chains(index: DataFrame, rows: DataFrame) -> DataFrame:
    """(key, sha, n, equal) of the texts in slots with a repeated key, from their bytes.

    ``n`` is the number of rows with that very text. Copies meet on the map side; what is left of a chain is one
    row per text.
    """
    per_key = index.groupBy("key").agg(F.sum("n").alias("n")).filter("n > 1")
    slots = F.broadcast(per_key.select(_slot(F.col("key"), FETCH_BITS).alias("slot")).distinct())
    texts = rows.withColumn("slot", _slot(F.col("key"), FETCH_BITS)).join(slots, "slot", "left_semi")
    chains = texts.groupBy("key", "normal").agg(F.count("*").alias("n"))
    return chains.select("key", F.unhex(F.sha2("normal", 256)).alias("sha"), F.col("n").alias("n_bytes"))


def find_copies(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
    capacity: int = CAPACITY, max_depth: int = MAX_DEPTH, key_bits: int = KEY_BITS,
) -> DataFrame:
    """Per row: doc_id, keep_id, group_size, kept, sha (32 bytes)."""
    rows = hash_rows(docs, doc_id, text, key_bits)
    hashed = staged(rows.drop("normal"), "dedup-rows")
    index = build_index(hashed, capacity, max_depth)
    # a text's entry stands only if as many rows carry its very bytes
    same = F.col("n") == F.col("n_bytes")
    proven = (
        index.filter("n > 1").join(compare_chains(index, rows), ["key", "sha"], "left")
        .select("key", "sha", "keep", "n", F.when(same, True).otherwise(
            F.raise_error(F.lit("two texts share key and SHA-256"))).alias("equal"))
        .filter("equal")
    )
    found = hashed.join(proven, ["key", "sha"], "left")
    return found.select(
        "doc_id", F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("keep.doc_id")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        (F.col("n").isNull() | (F.col("keep.row") == F.col("row"))).alias("kept"), "sha",
    )


def drop_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    found = staged(find_copies(docs, doc_id, text), "dedup-found")
    names = [f"d{i}" for i in range(len(docs.columns))]
    id_at, text_at = (names[docs.columns.index(c)] for c in (doc_id, text))
    rows = docs.toDF(*names).withColumn(
        "sha", F.unhex(F.sha2(ascii_lower(F.coalesce(F.col(text_at), F.lit(""))), 256))
    )
    stays = found.filter("kept").select(F.col("doc_id").alias("kept_id"), F.col("sha").alias("kept_sha"))
    same = F.col(id_at).eqNullSafe(F.col("kept_id")) & (F.col("sha") == F.col("kept_sha"))
    left = rows.join(stays, same, "left_semi")
    if not found.filter(F.col("doc_id").eqNullSafe(F.col("keep_id")) & ~F.col("kept")).isEmpty():
        left = left.dropDuplicates([id_at, "sha"])  # rows that repeat id and text are one document
    return left.select(*(F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True)))
