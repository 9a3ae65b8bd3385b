"""Packing token sequences: Martello-Toth dominance reduction, then best fit.

Lengths are whole numbers up to the capacity, so a corpus of any size is a histogram of at most ``capacity`` numbers.
The packing is worked out on that histogram: a bin *pattern* with the number of bins that follow it. First the
reduction fixes small sets that provably dominate every other bin with their largest document (they can only be part
of some best packing); then best fit decreasing packs what is left. Documents find their place by their rank among
the documents of equal length, which is a prefix sum over tasks, so no document passes through the driver.

Defined cases. Null or empty text: one piece with the end id alone. Longer documents are cut into full pieces and a
rest. Ties: pieces of equal length are taken in the order they are stored. Repeated rows are documents of their own.
Empty input: no rows.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tidewell.llm import tokens
from tidewell.llm.common import staged

CAPACITY = 2048
END_ID = 0
#: Documents encoded at a time.
BLOCK_DOCS = 2048

#: Runs of (length, how many) that fill one bin, and the number of such bins.
Pattern = tuple[tuple[tuple[int, int], ...], int]


def reduce_dominated(counts: np.ndarray) -> list[Pattern]:
    """Take sets that dominate all others with their largest length out of ``counts`` (how many of each length).

    With ``x`` the largest and ``y`` the longest other document that still fits beside it:
    x alone, if nothing fits; {x, y}, if they fill the bin, if no two others fit beside x, or if at most two fit and
    no such pair is longer than y (then y can take the pair's place in any packing).
    """
    capacity = len(counts) - 1
    fixed: list[Pattern] = []
    changed = True
    while changed:
        changed = False
        for x in range(capacity, 0, -1):
            while counts[x]:
                room = capacity - x
                counts[x] -= 1
                fits = np.flatnonzero(counts[: room + 1])
                smallest = np.repeat(fits[:3], np.minimum(counts[fits[:3]], 3))[:3]
                y = int(fits[-1]) if len(fits) else 0
                counts[x] += 1
                if not y:
                    times = int(counts[x])
                    pattern = ((x, 1),)
                else:
                    two = len(smallest) > 1 and smallest[:2].sum() <= room
                    three = len(smallest) > 2 and smallest.sum() <= room
                    if y != room and two and (three or _best_pair(fits, counts, room) > y):
                        break
                    times = int(counts[x]) // 2 if x == y else int(min(counts[x], counts[y]))
                    pattern = ((x, 2),) if x == y else ((x, 1), (y, 1))
                for length, n in pattern:
                    counts[length] -= n * times
                fixed.append((pattern, times))
                changed = True
    return fixed


def _best_pair(lengths: np.ndarray, counts: np.ndarray, room: int) -> int:
    """The longest two documents that fit into ``room`` together."""
    best, low, high = 0, 0, len(lengths) - 1
    while low <= high:
        total = int(lengths[low] + lengths[high])
        if total > room or (low == high and counts[lengths[low]] < 2):
            high -= 1
        else:
            best, low = max(best, total), low + 1
    return best


def best_fit(counts: np.ndarray) -> list[Pattern]:
    """Best fit decreasing on a histogram: equal lengths go together into the fullest bins that take them."""
    capacity = len(counts) - 1
    open_bins: dict[int, list[Pattern]] = defaultdict(list)
    rooms = np.zeros(capacity + 1, bool)

    def put(runs: tuple, bins: int, room: int) -> None:
        if bins:
            open_bins[room].append((runs, bins))
            rooms[room] = True

    for length in range(capacity, 0, -1):
        left = int(counts[length])
        while left:
            fitting = np.flatnonzero(rooms[length:])
            if len(fitting):
                room = length + int(fitting[0])
                runs, bins = open_bins[room].pop()
                rooms[room] = bool(open_bins[room])
            else:
                room, runs, bins = capacity, (), left
            each = room // length
            full = min(bins, left // each)
            put((*runs, (length, each)), full, room - each * length)
            left -= full * each
            rest = min(left, each) if bins > full else 0
            put((*runs, (length, rest)), int(rest > 0), room - rest * length)
            left -= rest
            if runs:
                put(runs, bins - full - int(rest > 0), room)
    return [p for patterns in open_bins.values() for p in patterns]


@dataclass(frozen=True)
class Placement:
    """For each length, runs of ranks: first rank, first sequence, offset, documents of this length per sequence."""

    runs: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]
    sequences: int

    def of(self, lengths: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sequence, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
        for length in np.unique(lengths):
            at = np.flatnonzero(lengths == length)
            first, base, start, each = self.runs[int(length)]
            run = np.searchsorted(first, ranks[at], side="right") - 1
            bin_no, place = np.divmod(ranks[at] - first[run], each[run])
            sequence[at] = base[run] + bin_no
            offset[at] = start[run] + place * length
        return sequence, offset


def plan_bins(histogram: dict[int, int], capacity: int = CAPACITY) -> Placement:
    """The packing of a histogram of lengths (at most ``capacity`` entries)."""
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        counts[length] = n
    fixed = reduce_dominated(counts)
    runs: dict[int, list[tuple[int, int, int, int]]] = defaultdict(list)
    taken: dict[int, int] = defaultdict(int)
    sequences = 0
    for pattern, bins in fixed + best_fit(counts):
        offset = 0
        for length, each in pattern:
            runs[length].append((taken[length], sequences, offset, each))
            taken[length] += bins * each
            offset += each * length
        sequences += bins
    return Placement({k: tuple(np.array(v, np.int64).T) for k, v in runs.items()}, sequences)


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, seq long"


def cut_pieces(
    docs: DataFrame, tokenizer: str, spaced: bool = False, doc_id: str = "doc_id", text: str = "text",
    capacity: int = CAPACITY,
) -> DataFrame:
    """Pieces of at most ``capacity`` ids, each document's end id included; ``part`` and ``seq`` number the pieces
    of one length within a task."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, part = tokens.encoder(tokenizer, spaced), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_DOCS):
                ids_of, texts = (c.slice(at, BLOCK_DOCS) for c in batch.columns)
                docs_at, piece, start, length, crc = [], [], [], [], []
                for k, ids in enumerate(encoder.encode(texts.to_pylist())):
                    whole = np.append(ids, END_ID).astype("<u4")
                    for p, s in enumerate(range(0, len(whole), capacity)):
                        cut_out = whole[s : s + capacity]
                        docs_at.append(k)
                        piece.append(p)
                        start.append(s)
                        length.append(len(cut_out))
                        crc.append(zlib.crc32(cut_out.tobytes()))
                lengths = np.array(length, np.int64)
                order = np.argsort(lengths, kind="stable")
                ordered = lengths[order]
                first = np.searchsorted(ordered, ordered)
                seq = np.empty(len(lengths), np.int64)
                seq[order] = seen[ordered] + np.arange(len(ordered)) - first
                seen += np.bincount(lengths, minlength=capacity + 1)
                yield pa.RecordBatch.from_arrays([
                    ids_of.take(pa.array(docs_at, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                    pa.array(lengths), pa.array(crc, pa.int64()), pa.array([part] * len(piece), pa.int32()), pa.array(seq),
                ], names=["doc_id", "piece", "start", "length", "ids_crc32", "part", "seq"])

    return rows.mapInArrow(cut, PIECES)


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``sequence_id`` and ``offset`` for staged pieces with ``length``, ``part`` and ``seq``."""
    counted = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counted.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    histogram = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}
    placement = pieces.sparkSession.sparkContext.broadcast(plan_bins(histogram, capacity))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                lengths = batch.column("length").to_numpy()
                ranks = batch.column("base").to_numpy() + batch.column("seq").to_numpy()
                sequence, offset = placement.value.of(lengths, ranks)
                kept = [batch.column(n) for n in batch.schema.names if n not in ("part", "seq", "base")]
                names = [n for n in batch.schema.names if n not in ("part", "seq", "base")]
                yield pa.RecordBatch.from_arrays(
                    [*kept, pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"]
                )

    kept = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in pieces.schema if f.name not in ("part", "seq"))
    rows = pieces.join(bases, ["part", "length"]).select(*pieces.columns, "base")
    return rows.mapInArrow(place, f"{kept}sequence_id long, offset long")


def pack_documents(
    docs: DataFrame, tokenizer: str, spaced: bool = False, doc_id: str = "doc_id", text: str = "text",
    capacity: int = CAPACITY,
) -> DataFrame:
    """One row per piece with its place."""
    return pack(staged(cut_pieces(docs, tokenizer, spaced, doc_id, text, capacity), "pieces"), capacity)
