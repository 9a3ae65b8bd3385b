"""Word shingles of whole texts as sorted arrays of 64-bit hashes, in numpy."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import numpy as np

from tidewell.llm.common import LOWER

#: Bytes hashed at a time; bounds memory for very long texts.
PIECE = 1 << 20
_BLANK = re.compile(rb"[\x20\x09-\x0D]")
_IS_WORD = np.array([not (b == 0x20 or 0x09 <= b <= 0x0D) for b in range(256)])
_LOWER = np.array([x + 1 for x in LOWER], np.uint64)
_BASE = 0x9E3779B97F4A7C15 | 1
_PLACES = np.array([0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63,
                    0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    def run(base: int) -> np.ndarray:
        steps = np.full(n, base, np.uint64)
        steps[0] = 1
        return np.multiply.accumulate(steps)

    return run(_BASE), run(pow(_BASE, -1, 1 << 64))


def _pieces(data: bytes) -> Iterator[bytes]:
    start = 0
    while len(data) - start > PIECE:
        cut = _BLANK.search(data, start + PIECE)
        if not cut:
            break
        yield data[start : cut.start()]
        start = cut.end()
    yield data[start:]


def word_hashes(data: bytes) -> np.ndarray:
    """Hashes of the words, A-Z lower-cased, of a UTF-8 text; words are runs without white space."""
    found = []
    for piece in _pieces(data):
        raw = np.frombuffer(piece, np.uint8)
        word = np.zeros(len(raw) + 2, np.int8)
        word[1:-1] = _IS_WORD[raw]
        edges = np.flatnonzero(np.diff(word))
        starts, ends = edges[::2], edges[1::2]
        power, inverse = _powers(PIECE if len(raw) <= PIECE else 1 << (len(raw) - 1).bit_length())
        total = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(_LOWER[raw] * power[: len(raw)], out=total[1:])
        found.append(mix((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64)))
    return found[0] if len(found) == 1 else np.concatenate(found)


def shingle_set(data: bytes | None, size: int) -> np.ndarray:
    """Distinct shingles of ``size`` words, ascending; a shorter text is one shingle, one without words none."""
    words = word_hashes(data) if data else np.empty(0, np.uint64)
    if not len(words):
        return words
    width = min(size, len(words))
    last = len(words) - width + 1
    sums = np.full(last, np.uint64(width * 0x51ED270B), np.uint64)
    for k in range(width):
        sums += words[k : k + last] * _PLACES[k]
    return np.unique(mix(sums))


def set_id(shingles: np.ndarray) -> int:
    """One signed 64-bit number for a set."""
    total = np.array([mix(shingles + np.uint64(0x632BE59BD9B4E019)).sum(dtype=np.uint64) + np.uint64(len(shingles))])
    return int(mix(total).view(np.int64)[0])
