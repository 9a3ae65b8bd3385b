"""Token ids of whole texts with a public tokenizer, quickly.

The two vocabularies used here never merge across white space, so a text's ids are those of its white-space units
one after the other. A Python worker keeps the ids of the units it has met (a bounded cache) and asks the tokenizer
only for new ones. Texts in which units cannot be told apart safely are given to the tokenizer as they are.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Units a worker remembers by their hash, some 40 bytes each; when it is full, those not met again are forgotten.
CACHED = 1_500_000
#: Code points encoded at a time; bounds memory for very long texts.
PIECE = 1 << 20
#: A unit with its leading space, or white space as the byte-level vocabulary cuts it.
_SPACED = re.compile(r" ?\S+|\s+(?!\S)|\s+")
#: Starts of special-token strings, and the separators that only Python takes for white space.
_WHOLE = ("<|", "\x1c", "\x1d", "\x1e", "\x1f")
#: A place where a long text may be cut: before a single space between two words.
_CUT = re.compile(r"(?<=\S) (?=\S)")


def _hashes(units: list[str]) -> np.ndarray:
    """64-bit hashes, good within one process."""
    return np.fromiter(map(hash, units), np.int64, len(units))


@cache
def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """``encode(texts)`` as arrays of ids, for one tokenizer file.

    ``spaced``: the vocabulary keeps white space (byte-level); otherwise it drops it.
    """

    def __init__(self, path: str, spaced: bool, cached: int = CACHED) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.spaced, self.cached = spaced, cached
        self._forget()

    def _forget(self) -> None:
        # sorted hashes of units, and each one's number; per number where its ids start, and whether it was met again
        self.keys = np.empty(0, np.int64)
        self.numbers = np.empty(0, np.int32)
        self.starts = np.zeros(1 << 16, np.int64)
        self.again = np.zeros(1 << 16, bool)
        self.pool = np.empty(1 << 16, np.uint32)
        self.used = 0

    def _thin(self) -> None:
        """Keep the units that were met again since they were learned."""
        met = self.again[self.numbers]
        keys, (ids, lengths) = self.keys[met], self._gathered(self.numbers[met])
        self._forget()
        if len(keys) <= self.cached // 2:
            self._remember(keys, ids, lengths)

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """Numbers of remembered units, -1 for others."""
        if not len(self.keys):
            return np.full(len(keys), -1, np.int64)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.numbers[at], -1)

    def _learn(self, units: list[str]) -> None:
        """Remember the ids of new units.

        A full stop or comma behind a letter or digit is a token of its own in both vocabularies, so such a unit is
        put together from the word and the mark.
        """
        marked = [u for u in units if u[-1] in ".," and u[-2:-1].isalnum()]
        plain = set(units).difference(marked)
        plain.update(u[:-1] for u in marked)
        plain.update(u[-1] for u in marked)
        new = list(plain)
        known = self._find(_hashes(new)).tolist()
        new = [u for u, k in zip(new, known, strict=True) if k < 0]
        found = [e.ids for e in self.tokenizer.encode_batch_fast(new, add_special_tokens=False)]
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter(chain.from_iterable(found), np.uint32, int(lengths.sum()))
        self._remember(_hashes(new), flat, lengths)
        if marked:
            words, marks = self._find(_hashes([u[:-1] for u in marked])), self._find(_hashes([u[-1] for u in marked]))
            both, lengths = self._gathered(np.stack([words, marks], axis=1).ravel())
            self._remember(_hashes(marked), both, lengths[::2] + lengths[1::2])

    def _remember(self, keys: np.ndarray, ids: np.ndarray, lengths: np.ndarray) -> None:
        n, more = len(self.keys), len(keys)
        if self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool[: self.used], np.empty(self.used // 2 + len(ids), np.uint32)])
        if n + more + 1 > len(self.starts):
            self.starts = np.concatenate([self.starts[: n + 1], np.zeros(n // 2 + more + 1, np.int64)])
            self.again = np.concatenate([self.again[: n + 1], np.zeros(n // 2 + more + 1, bool)])
        self.pool[self.used : self.used + len(ids)] = ids
        self.starts[n + 1 : n + 1 + more] = self.used + np.cumsum(lengths)
        self.used += len(ids)
        order = np.argsort(keys)
        at = np.searchsorted(self.keys, keys[order])
        self.keys = np.insert(self.keys, at, keys[order])
        self.numbers = np.insert(self.numbers, at, n + order)

    def _gathered(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of remembered units, and how many each has."""
        starts = self.starts[numbers]
        lengths = self.starts[numbers + 1] - starts
        before = np.cumsum(lengths) - lengths
        return self.pool[np.repeat(starts - before, lengths) + np.arange(int(lengths.sum()))], lengths

    def _of_units(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of any units, and how many each has."""
        if len(self.keys) > self.cached:
            self._thin()
        keys, first, at = np.unique(_hashes(units), return_index=True, return_inverse=True)
        numbers = self._find(keys)
        missing = np.flatnonzero(numbers < 0)
        if len(missing):
            self.again[numbers[numbers >= 0]] = True
            self._learn([units[i] for i in first[missing].tolist()])
            numbers[missing] = self._find(keys[missing])
        return self._gathered(numbers[at])

    def _pieces(self, text: str) -> Iterator[str]:
        start = 0
        while len(text) - start > PIECE:
            cut = _CUT.search(text, start + PIECE)
            if not cut:
                break
            yield text[start : cut.start()]
            start = cut.start()
        yield text[start:]

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """One id array per text; null counts as empty."""
        out: list[np.ndarray] = [np.empty(0, np.uint32)] * len(texts)
        held: list[tuple[int, int]] = []
        units: list[str] = []

        def flush() -> None:
            if units:
                ids, lengths = self._of_units(units)
                ends = np.concatenate([[0], np.cumsum(lengths)])
                first = 0
                for k, n in held:
                    part = ids[ends[first] : ends[first + n]]
                    out[k] = np.concatenate([out[k], part]) if len(out[k]) else part
                    first += n
            units.clear()
            held.clear()

        size = 0
        for k, text in enumerate(texts):
            if not text:
                continue
            if any(x in text for x in _WHOLE):
                found = self.tokenizer.encode(text, add_special_tokens=False).ids
                out[k] = np.array(found, np.uint32)
                continue
            for piece in self._pieces(text):
                new = _SPACED.findall(piece) if self.spaced else piece.split()
                held.append((k, len(new)))
                units.extend(new)
                size += len(piece)
                if size > PIECE:
                    flush()
                    size = 0
        flush()
        return out


@cache
def encoder(path: str, spaced: bool) -> Encoder:
    """One encoder per Python worker and file."""
    return Encoder(path, spaced)
