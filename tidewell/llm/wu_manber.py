"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

The patterns are the windows of the benchmark items. A word is a symbol; a block is two neighbouring words (one where
patterns have a single word). The shift table says for each block how far a window may move because the block does not
end, or stand nearer to the end of, any pattern; most blocks of a text occur in none, and the window jumps by almost
a whole pattern. Where the shift is 0, the hash of the block selects the bucket of patterns that end in it, and those
are compared word by word. Many lanes of text move at once, as arrays.

Defined cases. Null text has no words. An item without words has no windows; one with fewer words than a window is
one window. Items that share a window all occur where it does. Repeated documents are rows of their own; repeated item
ids are one item. Null item ids read ``null`` in lists. Texts are searched whole. An empty benchmark hits nothing.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tidewell.llm.common import LOWER, SLICE

WINDOW = 13
#: Windows searched for in one pass; a larger benchmark is searched in several blocks of items, one pass each.
BLOCK_WINDOWS = 1_000_000
#: Slots of a shift table.
SLOTS = 1 << 20
#: Words searched at a time; longer texts are searched in overlapping stretches.
STRETCH = 1 << 21
#: Stretches of a long text overlap by the longest window less one.
WINDOW_OVERLAP = WINDOW - 1
LANES = 4096
#: Bytes that are no part of a word become blanks: ASCII other than digits and letters.
_WORDS = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in LOWER)


def words(text: bytes | None) -> list[bytes]:
    """Runs of digits, lower-cased letters and non-ASCII characters."""
    return text.translate(_WORDS).split() if text else []


class Patterns:
    """Shift tables and buckets for one block of items, one set per pattern length."""

    def __init__(self, items: list[tuple[str, bytes]], window: int = WINDOW) -> None:
        self.vocabulary: dict[bytes, int] = {}
        self.items = sorted({i for i, _ in items})
        number = {x: k for k, x in enumerate(self.items)}
        owners: dict[int, dict[tuple[int, ...], set[int]]] = defaultdict(lambda: defaultdict(set))
        for item, text in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words(text)]
            m = min(window, len(ids))
            for k in range(len(ids) - m + 1 if m else 0):
                owners[m][tuple(ids[k : k + m])].add(number[item])
        self.tables = [_Table(m, dict(found)) for m, found in sorted(owners.items())]

    def search(self, ids: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
        """(last word, item number, pattern length) of all occurrences; 0 in ``ids`` is in no pattern."""
        for table in self.tables:
            ends, patterns = table.search(ids)
            if len(ends):
                n = np.diff(table.owner_at)[patterns]
                first = np.repeat(table.owner_at[patterns] - (np.cumsum(n) - n), n)
                yield np.repeat(ends, n), table.owner[first + np.arange(int(n.sum()))], table.m


class _Table:
    def __init__(self, m: int, owners: dict[tuple[int, ...], set[int]]) -> None:
        self.m, self.block = m, min(2, m)
        self.patterns = np.array(list(owners), np.int64).reshape(-1, m)
        self.owner = np.array([i for x in owners.values() for i in sorted(x)], np.int64)
        self.owner_at = np.concatenate([[0], np.cumsum([len(x) for x in owners.values()])])
        self.shift = np.full(SLOTS, m - self.block + 1, np.int64)
        for end in range(self.block - 1, m):  # a block nearer to the end allows less
            np.minimum.at(self.shift, self.slots(self.patterns, end), m - 1 - end)
        suffix = self.slots(self.patterns, m - 1)
        self.by_suffix = np.argsort(suffix, kind="stable")
        self.suffixes = suffix[self.by_suffix]

    def slots(self, rows: np.ndarray, end: int | np.ndarray) -> np.ndarray:
        """Table slot of the block that ends in column ``end``."""
        return _slot(rows[:, end - 1] if self.block == 2 else 0, rows[:, end])

    def search(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n, m = len(ids), self.m
        found = [(np.empty(0, np.int64), np.empty(0, np.int64))]
        if n >= m:
            lanes = min(LANES, n - m + 1)
            bounds = np.linspace(m - 1, n, lanes + 1).astype(np.int64)
            at, stop = bounds[:-1].copy(), bounds[1:]
            while len(at):
                step = self.shift[_slot(ids[at - 1] if self.block == 2 else 0, ids[at])]
                here = at[step == 0]
                if len(here):
                    found.append(self.confirm(ids, here))
                at = at + np.maximum(step, 1)
                going = at < stop
                at, stop = at[going], stop[going]
        ends, patterns = (np.concatenate(x) for x in zip(*found, strict=True))
        return ends, patterns

    def confirm(self, ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Compare the patterns of each suffix bucket with the words that end here."""
        suffix = _slot(ids[ends - 1] if self.block == 2 else 0, ids[ends])
        low, high = np.searchsorted(self.suffixes, suffix), np.searchsorted(self.suffixes, suffix, side="right")
        n = high - low
        at = np.repeat(ends, n)
        pattern = self.by_suffix[np.repeat(low - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
        for back in range(self.m):
            same = self.patterns[pattern, self.m - 1 - back] == ids[at - back]
            at, pattern = at[same], pattern[same]
        return at, pattern


def _slot(before: np.ndarray | int, last: np.ndarray) -> np.ndarray:
    return (before * 1_000_003 + last * 7919) & (SLOTS - 1)


def _hits(patterns: Patterns, texts: list[bytes | None]) -> Iterator[tuple[int, np.ndarray, set[int]]]:
    """Per text: number of words, spans (first word, one past the last) of hits, numbers of occurring items."""
    held: list[tuple[int, int, int]] = []  # text, its first word in the stretch, words
    parts: list[np.ndarray] = []
    spans: dict[int, list[np.ndarray]] = defaultdict(list)
    items: dict[int, set[int]] = defaultdict(set)
    counts = [0] * len(texts)
    size = 0

    def flush() -> None:
        nonlocal size
        if not parts:
            return
        ids = np.concatenate(parts)
        starts = np.cumsum([0, *(len(p) for p in parts[:-1])])
        for ends, owners, m in patterns.search(ids):
            at = np.searchsorted(starts, ends, side="right") - 1
            order = np.argsort(at, kind="stable")
            cuts = np.flatnonzero(np.diff(at[order])) + 1
            for group in np.split(order, cuts):
                text, first, _ = held[at[group[0]]]
                last = ends[group] - starts[at[group[0]]] + first
                spans[text].append(np.stack([last - m + 1, last + 1], axis=1))
                items[text].update(owners[group].tolist())
        parts.clear()
        held.clear()
        size = 0

    for k, text in enumerate(texts):
        found = words(text)
        counts[k] = len(found)
        step = STRETCH - WINDOW_OVERLAP
        for first in range(0, max(1, len(found) - WINDOW_OVERLAP), step):
            own = found[first : first + STRETCH]
            parts.append(np.fromiter(map(patterns.vocabulary.get, own, repeat(0)), np.int64, len(own)))
            parts[-1] = np.append(parts[-1], 0)  # nothing spans two texts
            held.append((k, first, len(own)))
            size += len(own) + 1
            if size >= STRETCH:
                flush()
    flush()
    for k, n in enumerate(counts):
        yield n, merged(np.concatenate(spans[k])) if k in spans else np.empty((0, 2), np.int64), items[k]


def merged(spans: np.ndarray) -> np.ndarray:
    """Spans as disjoint ascending ones."""
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    new = np.concatenate([[True], spans[1:, 0] > reach[:-1]])
    last = np.append(np.flatnonzero(new)[1:], len(spans)) - 1
    return np.stack([spans[new, 0], reach[last]], axis=1)


def find_contamination(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", carry: dict[str, Column] | None = None,
    block_windows: int = BLOCK_WINDOWS,
) -> DataFrame:
    """``carry``'s columns of each document, ``n_words``, ``spans`` (first word, one past the last) and ``items``.

    The benchmark is the query set: it is counted first and searched for in as many blocks of items as that needs,
    each a narrow pass over the documents, one behind the other.
    """
    carry = dict(carry or {})
    own = carry.pop(text, None)  # ``text`` may name a column of ``carry``, which then travels once
    at_text = "__text" if own is None else text
    spark = docs.sparkSession
    query = benchmark.select(
        F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), F.col("text").cast("binary").alias("text")
    ).dropna()
    # a text of n bytes has at most (n + 1) / 2 words, and no more windows
    size = query.agg(F.sum((F.length("text") + 1) / 2)).first()[0] or 0
    blocks = max(1, -(-int(size) // block_windows))
    rows = docs.select(
        *(c.alias(n) for n, c in carry.items()),
        F.col(text).cast("binary").alias("__text") if own is None else own.alias(text), F.lit(0).cast("long").alias("n_words"),
        F.expr("cast(array() as array<array<long>>)").alias("spans"), F.expr("cast(array() as array<string>)").alias("items"),
    )
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    for block in range(blocks):
        own = query.filter(F.pmod(F.xxhash64("item"), F.lit(blocks)) == block).collect()
        patterns = spark.sparkContext.broadcast(Patterns([(r[0], bytes(r[1])) for r in own]))

        def search(batches: Iterator[pa.RecordBatch], patterns=patterns) -> Iterator[pa.RecordBatch]:
            for batch in (b.slice(k, SLICE) for b in batches for k in range(0, b.num_rows, SLICE)):
                at = {n: i for i, n in enumerate(batch.schema.names)}
                counts, spans, items = [], [], []
                found = _hits(patterns.value, batch.column(at[at_text]).cast(pa.binary()).to_pylist())
                for (n, own, names), old, known in zip(
                    found, batch.column(at["spans"]).to_pylist(), batch.column(at["items"]).to_pylist(), strict=True
                ):
                    counts.append(n)
                    spans.append(merged(np.concatenate([np.array(old, np.int64), own])).tolist() if old and len(own) else old or own.tolist())
                    items.append(sorted({*known, *(patterns.value.items[i] for i in names)}))
                made = {"n_words": pa.array(counts, pa.int64()), "spans": pa.array(spans, pa.list_(pa.list_(pa.int64()))),
                        "items": pa.array(items, pa.list_(pa.string()))}
                yield pa.RecordBatch.from_arrays(
                    [made.get(n, batch.column(i)) for n, i in at.items()], names=list(at)
                )

        rows = rows.mapInArrow(search, schema)
    return rows.drop("__text")


def verdicts(found: DataFrame) -> DataFrame:
    """Counts and the verdict: contaminated from one hit word in twenty on."""
    n_hit = F.expr("aggregate(spans, 0L, (n, s) -> n + s[1] - s[0])")
    listed = F.array_join(F.array_sort("items"), ",")
    return found.withColumns({
        "n_hit": n_hit, "n_items": F.size("items").cast("long"), "items_sha256": F.sha2(listed, 256),
    }).withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def item_digest(items: list[str]) -> str:
    """The digest of a list of item ids, as ``verdicts`` computes it."""
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
