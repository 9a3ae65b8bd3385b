"""Language identification by rank-order profiles.

A language's profile is the list of its most frequent character n-grams (1 to 3 letters, words padded with a
mark on both sides), most frequent first. A document gets the language with the smallest out-of-place distance:
for each of the document's own most frequent n-grams, how far its rank lies from its rank in the profile, or the
profile length if it is not there.

Defined cases. Null or letterless text: ``und``, score 0. Null or missing languages are not learned from. Ties in
counts are ordered by n-gram, ties in distance by language name. Repeated rows count once each. Without any
labelled row nothing is learned and every text is ``und``. Text is taken whole; long ones are counted in pieces.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tidewell.llm.common import per_batch

#: Length of a profile and of a document's own list.
PROFILE = 300
#: Code points counted at a time; bounds memory for very long texts.
PIECE = 1 << 20
#: Rows of (language, n-gram) a task holds before it hands them on.
HELD = 1 << 20
#: A profile table this long is refused: languages are an enumerated set, not free text.
MOST_LANGUAGES = 10_000
UNDETERMINED = "und"
_PAD, _SHIFT = 1, 21


@cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def _counted(grams: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams in ascending order and how often each occurs."""
    if counts is None:
        return np.unique(grams, return_counts=True)
    distinct, at = np.unique(grams, return_inverse=True)
    return distinct, np.bincount(at, counts, len(distinct)).astype(np.int64)


def _grams(codes: np.ndarray) -> np.ndarray:
    """N-grams of one piece; letters are code points, everything else is the pad mark, packed 21 bits each."""
    codes = codes[~((codes == _PAD) & (np.append(_PAD, codes[:-1]) == _PAD))]
    codes = np.append(np.append(_PAD, codes), _PAD)
    letter = codes != _PAD
    two = (codes[:-1] << _SHIFT) | codes[1:]
    three = (two[:-1] << _SHIFT) | codes[2:]
    return np.concatenate([codes[letter], two[letter[:-1] | letter[1:]], three[letter[1:-1]]])


def text_grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of a text, ascending, and their counts."""
    found = []
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    codes = np.where(_letters()[codes], codes, _PAD)
    start = 0
    while start < len(codes):
        end = min(len(codes), start + PIECE)
        if end < len(codes):  # a piece ends between two words, or where a word of a whole piece forces it
            breaks = np.flatnonzero(codes[start:end] == _PAD)
            end = start + int(breaks[-1]) + 1 if len(breaks) else end
        found.append(_counted(_grams(codes[start:end])))
        start = end
    if len(found) == 1:
        return found[0]
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return _counted(np.concatenate([g for g, _ in found]), np.concatenate([c for _, c in found]))


def _ranked(grams: np.ndarray, counts: np.ndarray, keep: int) -> np.ndarray:
    """The most frequent n-grams, most frequent first, ties by n-gram."""
    return grams[np.argsort(-counts, kind="stable")[:keep]]


def learn_profiles(labelled: DataFrame, text: str = "text", lang: str = "lang", keep: int = PROFILE) -> DataFrame:
    """(lang, gram, rank) from rows with both columns; counts are merged in the task before they are shuffled."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        size = 0

        def out(final: bool) -> Iterator[pa.RecordBatch]:
            nonlocal size
            size = 0
            for name, parts in held.items():
                parts[:] = [_counted(np.concatenate([g for g, _ in parts]), np.concatenate([c for _, c in parts]))]
                size += len(parts[0][0])
            if final or size > HELD:
                for name, ((grams, counts),) in held.items():
                    yield pa.RecordBatch.from_pydict({"lang": [name] * len(grams), "gram": grams, "n": counts})
                held.clear()
                size = 0

        for batch in batches:
            for value, name in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                grams = text_grams(value)
                held.setdefault(name, []).append(grams)
                size += len(grams[0])
                if size > 4 * HELD:
                    yield from out(False)
        yield from out(True)

    rows = labelled.select(F.col(text).alias("text"), F.col(lang).alias("lang")).dropna()
    counts = rows.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    best = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    return counts.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= keep).drop("n")


class Profiles:
    """Profiles of all languages as one sorted n-gram table; a few thousand rows."""

    def __init__(self, rows: list[tuple[str, int, int]], keep: int) -> None:
        self.keep = keep
        self.names = sorted({r[0] for r in rows})
        at = {name: i for i, name in enumerate(self.names)}
        self.grams = np.unique(np.array([r[1] for r in rows], np.int64))
        self.ranks = np.full((len(self.grams), len(self.names)), -1, np.int32)
        for name, gram, rank in rows:
            self.ranks[np.searchsorted(self.grams, gram), at[name]] = rank - 1

    def best(self, text: str | None) -> tuple[str, float]:
        """Language and one minus the normalised distance."""
        grams, counts = text_grams(text) if text and self.names else (np.empty(0, np.int64),) * 2
        if not len(grams):
            return UNDETERMINED, 0.0
        own = _ranked(grams, counts, self.keep)
        at = np.minimum(np.searchsorted(self.grams, own), len(self.grams) - 1)
        ranks = self.ranks[at]
        away = np.abs(ranks - np.arange(len(own), dtype=np.int32)[:, None])
        away[(ranks < 0) | (self.grams[at] != own)[:, None]] = self.keep
        total = np.minimum(away, self.keep).sum(axis=0)
        first = int(total.argmin())
        return self.names[first], 1.0 - float(total[first]) / (self.keep * len(own))


def collect_profiles(profiles: DataFrame, keep: int = PROFILE) -> Profiles:
    """Profiles on the driver: ``keep`` rows a language; their number is checked."""
    rows = profiles.select("lang", "gram", "rank").limit(MOST_LANGUAGES * keep + 1).collect()
    if len(rows) > MOST_LANGUAGES * keep:
        raise ValueError(f"more than {MOST_LANGUAGES} languages to learn; the label column is not a language")
    return Profiles([tuple(r) for r in rows], keep)


def identify(docs: DataFrame, profiles: Profiles, text: str = "text", carry: dict[str, Column] | None = None) -> DataFrame:
    """``carry``'s columns of each row, its language ``lang_pred`` and ``score``; one narrow pass.

    ``text`` may name a column of ``carry``, which then travels once.
    """
    carry = dict(carry or {})
    own = carry.pop(text, None)
    travels = own is not None
    model = docs.sparkSession.sparkContext.broadcast(profiles)

    def work(columns: dict[str, pa.Array]) -> dict:
        texts = columns[text] if travels else columns.pop("__text")
        found = [model.value.best(x) for x in texts.to_pylist()]
        return columns | {"lang_pred": [x for x, _ in found], "score": [x for _, x in found]}

    first = F.col(text).alias("__text") if own is None else own.alias(text)
    rows = docs.select(first, *(c.alias(name) for name, c in carry.items()))
    kept = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema if f.name != "__text")
    return per_batch(rows, work, f"{kept}lang_pred string, score double")
