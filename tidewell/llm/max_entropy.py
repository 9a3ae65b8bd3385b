"""A hashed maximum-entropy language model with a class-factored softmax.

The probability of a token is the product of the choices on its way through nested classes: each node is a softmax over
``WIDTH`` children, relative to the children's shares of all counts, with hashed features of the two tokens before: a
bias, the last token (bigram), the one before (skip) and both (trigram). Classes are cut by counts, so frequent tokens
have short ways. Every token has a way of its own: the most frequent ones (``HEAD``) by rank, the others below one leaf
by the digits of a hash, with as many leaves there as such types; types that share a leaf, and unknown tokens, divide it
by their counts.

Texts become events (token, last, before). An event goes to the shelf of its last token; shelves grow in number, not in
size, with the tokens. The events of a frequent last token are dealt to several shelves by the token before it, and by
text where that is frequent too. Shelves share no features, so one task trains a shelf (AdaGrad over its distinct
training events in the order of their hashes, tables sized by them) and scores its events; nothing is averaged, and the
weights depend neither on the splits of the input nor on its order. Sums by text come back by stretch.

Counts of all tokens are a Spark aggregate over all training texts. The most frequent ones travel to the tasks;
the counts of the others meet the texts in a join, once for each text and task, so that copies of a text cost nothing.

Defined cases. Null or empty text: the end token alone. Ties in counts are ordered by token. Repeated rows are counted
and scored each. Nothing to train on: all counts are 0 and both scores are 0. Long texts are read whole, in stretches.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from tidewell.llm.common import staged

END = b"\n"  # white space, so no word
#: Tokens whose counts every task holds.
HEAD = 1 << 18
#: Children of a node, a power of two.
WIDTH, BITS = 8, 3
#: The leaf of all other tokens in weights made without counts.
RARE = 1 << 10
#: What stands before a text.
START = -2
RATE = 0.3
#: Events of one gradient step, and the bits of a place in it.
STEP = 8192
PLACE = (STEP - 1).bit_length()
#: Tokens handled at a time, and bytes of text that are cut into words at a time.
STRETCH, GROUP = 1 << 20, 8 << 20
#: Distinct tokens a task counts before it hands them on.
HELD = 1 << 19
#: Training tokens for each shelf, and how many events of one context may share a shelf.
SHELF, PART = 1 << 20, 1 << 18
#: Events for each drawer of a shelf.
DRAWER = 1 << 16
#: Seed of Spark's ``xxhash64``.
SEED = 42
#: Spreads features over a table.
SPREAD = np.uint64(0x9E3779B97F4A7C15)
#: Adds up the children of each row into all its columns.
ALIKE = np.ones((WIDTH, WIDTH), np.float32)


def split_words(texts: list[bytes | None]) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts in turn, and how many each text has."""
    data = pa.array([x or b"" for x in texts], pa.binary())
    text = pa.Array.from_buffers(pa.string(), len(data), data.buffers())  # any bytes; both functions know ASCII only
    parts = pc.ascii_split_whitespace(pc.ascii_lower(text))
    words = parts.flatten().cast(pa.binary())
    # Before the first and behind the last white space of a text stands an empty part.
    kept = pc.binary_length(words).to_numpy() > 0
    sums = np.concatenate([[0], np.cumsum(kept)])
    return words.filter(pa.array(kept)), np.diff(sums[parts.offsets.to_numpy()])


def _groups(texts: list[bytes | None]) -> Iterator[slice]:
    """Texts that are cut into words together."""
    sizes = np.cumsum([len(x or b"") + 1 for x in texts], dtype=np.int64)
    edges = np.flatnonzero(np.diff(sizes // GROUP, prepend=0)).tolist()
    for low, high in zip([0, *edges], [*edges, len(texts)], strict=True):
        if low < high:
            yield slice(low, high)


def count_tokens(texts: DataFrame) -> DataFrame:
    """(token, c) over a frame of one binary column; tasks add up before rows are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []

        def add_up() -> pa.Table:
            made = pa.concat_tables(held).group_by("token", use_threads=False).aggregate([("n", "sum")])
            return made.select(["token", "n_sum"]).rename_columns(["token", "n"])

        for batch in batches:
            column = batch.column(0).to_pylist()
            for own in _groups(column):
                found = pc.value_counts(split_words(column[own])[0])
                held.append(pa.table({"token": found.field(0), "n": found.field(1)}))
                held.append(pa.table({"token": pa.array([END], pa.binary()), "n": pa.array([own.stop - own.start], pa.int64())}))
                if sum(len(x) for x in held) > 2 * HELD:
                    held[:] = [add_up()]
                    if len(held[0]) > HELD:
                        yield from held.pop().to_batches()
        if held:
            yield from add_up().to_batches()

    return texts.mapInArrow(run, "token binary, n long").groupBy("token").agg(F.sum("n").alias("c"))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _u64(x: np.ndarray) -> np.ndarray:
    return x.astype(np.int64).view(np.uint64)


class Classes:
    """Nested classes over tokens 0, 1, ... and one leaf of all others, each cut into parts of about equal mass.

    The leaf of the others goes on for ``deep`` levels, one for each digit of the token's number beyond it.
    """

    def __init__(self, mass: np.ndarray, deep: int = 0) -> None:
        n = len(mass)
        self.rest, self.deep = n - 1, deep
        sums = np.concatenate([[0.0], np.cumsum(mass, dtype=np.float64)])
        middle = (sums[:-1] + sums[1:]) / 2
        alive, low, high, node = np.arange(n), np.zeros(n, int), np.full(n, n), np.zeros(n, int)
        self.count = int(n > 1)
        nodes, digits, shares = [], [], []
        self.depth = np.zeros(n, np.int8)
        if n == 1:
            alive = alive[:0]
        while len(alive):
            size, at = high[alive] - low[alive], sums[low[alive]]
            cut = ((middle[alive] - at) / (sums[high[alive]] - at) * WIDTH).astype(int)
            digit = np.where(size <= WIDTH, alive - low[alive], np.clip(cut, 0, WIDTH - 1))
            nodes.append(np.zeros(n, np.int32))
            digits.append(np.zeros(n, np.int8))
            nodes[-1][alive], digits[-1][alive] = node[alive], digit
            self.depth[alive] += 1
            shares.append((node[alive] * WIDTH + digit, mass[alive]))
            edge = np.flatnonzero(np.diff(node[alive] * WIDTH + digit, prepend=-1))
            sizes = np.diff(np.append(edge, len(alive)))
            low[alive], high[alive] = np.repeat(alive[edge], sizes), np.repeat(alive[edge] + sizes, sizes)
            inner = sizes > 1
            node[alive] = np.repeat(self.count + np.cumsum(inner) - 1, sizes)
            self.count += int(inner.sum())
            alive = alive[np.repeat(inner, sizes)]
        self.nodes, self.digits = np.array(nodes).reshape(-1, n), np.array(digits).reshape(-1, n)
        total = np.zeros(max(self.count, 1) * WIDTH)
        for child, m in shares:
            total += np.bincount(child, m, len(total))
        total = total.reshape(-1, WIDTH)
        with np.errstate(divide="ignore", invalid="ignore"):
            prior = np.log(total / total.sum(axis=1, keepdims=True))
        prior = np.where(total > 0, prior, -1e4).astype(np.float32)
        #: The last row is that of all nodes below the leaf of the others.
        self.prior = np.concatenate([prior[: self.count], np.zeros((1, WIDTH), np.float32)])

    def way(self, token: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(which tokens go on, their nodes, the children taken) at a level."""
        leaf = np.minimum(token, self.rest)
        goes = self.depth.take(leaf) > level
        below = level - int(self.depth[self.rest])
        if not 0 <= below < self.deep:
            own = np.flatnonzero(goes)
            leaf = leaf.take(own)
            return own, self.nodes[level].take(leaf), self.digits[level].take(leaf)
        further = token >= self.rest
        own = np.flatnonzero(goes | further)
        further, leaf, number = further.take(own), leaf.take(own), token.take(own) - self.rest
        node = self.count + (1 << BITS * below) + (number >> BITS * (self.deep - below))
        digit = (number >> BITS * (self.deep - below - 1)) & (WIDTH - 1)
        if level < len(self.nodes):
            node = np.where(further, node, self.nodes[level].take(leaf))
            digit = np.where(further, digit, self.digits[level].take(leaf))
        return own, node, digit

    @property
    def levels(self) -> int:
        return max(len(self.nodes), int(self.depth[self.rest]) + self.deep)

    def prior_of(self, node: np.ndarray) -> np.ndarray:
        """Logarithms of the children's shares; the same for all children below the leaf of the others."""
        return self.prior.take(node, axis=0, mode="clip")


@dataclass
class Weights:
    """Rows of the root's features and of those of all other nodes; the numbers of rows are powers of two."""

    classes: np.ndarray
    words: np.ndarray
    tree: Classes

    @staticmethod
    def zero(tree: Classes | None = None, events: int = 1 << 15) -> Weights:
        rows = 1 << max(events - 1, 255).bit_length()
        shapes = (max(rows >> 2, 256), WIDTH), (rows, WIDTH)
        return Weights(*(np.zeros(s, np.float32) for s in shapes), tree or Classes(np.ones(RARE + 1)))

    def table(self, level: int) -> np.ndarray:
        return self.words if level else self.classes


def _contexts(last: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Hashes of the four features of each event."""
    a, b = _u64(last), _u64(before)
    pair = _mixed(_mixed(a + np.uint64(1 << 40)) + b)
    out = np.stack([np.full(len(a), 1 << 42, np.uint64), _mixed(a + np.uint64(1 << 41)), _mixed(b + np.uint64(3 << 41)), pair])
    out *= SPREAD
    return out


def _rows(contexts: np.ndarray, node: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Rows of the features in ``table``; the node is part of every feature."""
    x = contexts + _u64(node) * np.uint64(0xD6E8FEB86659FD93) * SPREAD
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x >>= np.uint64(65 - len(table).bit_length())
    return x.view(np.int64)


def _odds(table: np.ndarray, rows: np.ndarray, prior: np.ndarray) -> np.ndarray:
    """What the children's probabilities are in proportion to."""
    out = table.take(rows[0], axis=0)
    for own in rows[1:]:
        out += table.take(own, axis=0)
    out += prior
    return np.exp(np.minimum(out, 60, out=out), out=out)


def _cells(table: np.ndarray) -> np.ndarray:
    """The rows of a table as single items, which numpy copies in one piece each."""
    return table.view(f"V{table.itemsize * WIDTH}").ravel()


#: Of a level: which of some events go on, their nodes, the children taken and the rows of their features.
Way = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def _ways(weights: Weights, token: np.ndarray, last: np.ndarray, before: np.ndarray) -> Iterator[list[Way]]:
    """The ways of the events of each step, by level."""
    for at in range(0, len(token), STEP):
        cut = slice(at, at + STEP)
        contexts = _contexts(last[cut], before[cut])
        made = []
        for level in range(weights.tree.levels):
            own, node, digit = weights.tree.way(token[cut], level)
            held = contexts if len(own) == contexts.shape[1] else contexts.take(own, axis=1)
            rows = _rows(held, node, weights.table(level))
            made.append(tuple(x.astype(np.int32) for x in (own, node, digit, rows)))
        yield made


def _scores(weights: Weights, ways: Iterable[list[Way]], n: int) -> np.ndarray:
    """log10 of the ways of ``n`` events."""
    out = np.zeros(n)
    for at, made in zip(range(0, n, STEP), ways, strict=True):
        for level, (own, node, digit, rows) in enumerate(made):
            if len(own):
                odds = _odds(weights.table(level), rows, weights.tree.prior_of(node))
                taken = odds.ravel().take(np.arange(0, odds.size, WIDTH) + digit) / (odds @ ALIKE[0])
                out[at + own] += np.log10(np.maximum(taken, np.float32(1e-30)))
    return out


def log_probability(weights: Weights, token: np.ndarray, last: np.ndarray, before: np.ndarray) -> np.ndarray:
    """log10 of the way to each token."""
    return _scores(weights, _ways(weights, token, last, before), len(token))


def _step(table: np.ndarray, squares: np.ndarray, rows: np.ndarray, prior: np.ndarray, right: np.ndarray, n: np.ndarray) -> None:
    """One AdaGrad step on the rows of a batch."""
    p = _odds(table, rows, prior)
    p /= p @ ALIKE
    p.ravel()[np.arange(0, p.size, WIDTH) + right] -= 1
    many = np.flatnonzero(n != 1)
    p[many] *= n[many, None]
    # A row and the event that has it make one number, so a plain sort brings the events of a row together.
    key = rows.astype(np.uint32 if len(table) << PLACE <= 1 << 32 else np.uint64)
    key <<= PLACE
    key |= np.arange(len(p), dtype=key.dtype)
    key = key.ravel()
    key.sort()
    event, key = key & (1 << PLACE) - 1, key >> PLACE
    starts = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1])
    sizes = np.diff(starts, append=len(key))
    gradient = p.take(event.take(starts), axis=0)
    several = sizes > 1
    if several.any():
        # Most rows have one event; the sums of the others are taken two numbers at a time.
        shared, ends = p.take(event[np.repeat(several, sizes)], axis=0), np.cumsum(sizes[several])
        sums = np.add.reduceat(shared.view(np.complex64), ends - sizes[several])
        _cells(gradient)[several] = _cells(sums.view(np.float32))
    touched = key.take(starts).astype(np.int64)
    seen = squares.take(touched, axis=0)
    seen += gradient * gradient
    _cells(squares)[touched] = _cells(seen)
    # The 1 keeps children that are rare in a context near their shares.
    seen += 1
    np.sqrt(seen, out=seen)
    gradient /= seen
    gradient *= RATE
    _cells(table)[touched] = _cells(table.take(touched, axis=0) - gradient)


def fit_events(weights: Weights, ways: Iterable[list[Way]], n: np.ndarray) -> None:
    """Weights from distinct events, each ``n`` times, in the order given."""
    squares = Weights.zero(weights.tree, len(n))
    for at, made in zip(range(0, len(n), STEP), ways, strict=True):
        m = n[at : at + STEP].astype(np.float32)
        for level, (own, node, digit, rows) in enumerate(made):
            if len(own):
                prior = weights.tree.prior_of(node)
                _step(weights.table(level), squares.table(level), rows, prior, digit, m.take(own))


def fit_and_score(
    tree: Classes, token: np.ndarray, last: np.ndarray, before: np.ndarray, n: np.ndarray
) -> np.ndarray:
    """log10 probabilities of all events of a shelf, learned from those that stand ``n`` > 0 times in training texts.

    A shelf has drawers, by the last token, of a size whose weights stay in a processor's cache.
    """
    out = np.empty(len(token))
    drawers = max(1, len(token) // DRAWER)
    drawer = (_mixed(_u64(last) + np.uint64(1 << 44)) % np.uint64(drawers)).astype(np.uint16 if drawers <= 1 << 16 else np.int64)
    order = np.argsort(drawer, kind="stable")
    for own in np.split(order, np.flatnonzero(np.diff(drawer[order])) + 1):
        t, a, b, _, at = _distinct(token[own], last[own], before[own])
        often = np.bincount(at, n[own], len(t))
        # Those to learn come first; their ways serve training and scoring.
        turn = np.argsort(often == 0, kind="stable")
        t, a, b, learned = t[turn], a[turn], b[turn], int(np.count_nonzero(often))
        weights = Weights.zero(tree, learned)
        ways = list(_ways(weights, t[:learned], a[:learned], b[:learned]))
        fit_events(weights, ways, often[turn[:learned]])
        logs = np.empty(len(t))
        logs[turn[:learned]] = _scores(weights, ways, learned)
        logs[turn[learned:]] = log_probability(weights, t[learned:], a[learned:], b[learned:])
        out[own] = logs[at]
    return out


def _head_numbers(words: pa.Array, ids: dict[bytes, int]) -> np.ndarray:
    """Numbers of the words that have one in ``ids``, -1 for all others."""
    return pc.index_in(words, value_set=pa.array(list(ids), pa.binary())).fill_null(-1).to_numpy().astype(np.int64)


def _numbers(words: pa.Array, ids: dict[bytes, int], leaves: int) -> np.ndarray:
    """Numbers of words; those outside ``ids`` are numbered behind them, by their leaf."""
    import xxhash

    out = _head_numbers(words, ids)
    far = np.flatnonzero(out < 0)
    if len(far):
        coded = words.take(pa.array(far)).dictionary_encode()
        leaf = [xxhash.xxh64_intdigest(w, SEED) & (leaves - 1) for w in coded.dictionary.to_numpy(zero_copy_only=False)]
        out[far] = len(ids) + np.array(leaf, np.int64)[coded.indices.to_numpy()]
    return out


def _stretches(
    texts: list[bytes | None], ids: dict[bytes, int], leaves: int = 1
) -> Iterator[tuple[list[int], list[np.ndarray], list[int]]]:
    """Texts, or stretches of long ones, as (text numbers, token numbers with two starting marks first, numbers of tokens)."""
    end = _numbers(pa.array([END], pa.binary()), ids, leaves)
    numbers: list[int] = []
    parts: list[np.ndarray] = []
    lengths: list[int] = []
    size = 0
    for group in _groups(texts):
        words, counts = split_words(texts[group])
        found, low = _numbers(words, ids, leaves), 0
        for k, n in enumerate(counts.tolist(), group.start):
            own = np.concatenate([[START, START], found[low : low + n], end])
            low += n
            for at in range(0, n + 1, STRETCH):
                numbers.append(k)
                parts.append(own[at : at + STRETCH + 2])
                lengths.append(len(parts[-1]) - 2)
                size += lengths[-1]
                if size >= STRETCH:
                    yield numbers, parts, lengths
                    numbers, parts, lengths, size = [], [], [], 0
    if numbers:
        yield numbers, parts, lengths


def _events(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(token, last, before) at each place."""
    ids = np.concatenate(parts)
    inside = np.ones(len(ids), bool)
    starts = np.cumsum([0, *(len(p) for p in parts[:-1])])
    inside[starts] = inside[starts + 1] = False
    at = np.flatnonzero(inside)
    return ids[at], ids[at - 1], ids[at - 2]


def _distinct(token: np.ndarray, last: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct (token, last, before) in the order of their hashes, how often, and which one stands at each place."""
    code = _mixed(_mixed(_mixed(_u64(token)) + _u64(last)) + _u64(before))
    _, first, at, n = np.unique(code, return_index=True, return_inverse=True, return_counts=True)
    return token[first], last[first], before[first], n, at


def _triples(parts: list[np.ndarray]) -> tuple[np.ndarray, ...]:
    return _distinct(*_events(parts))


def _packed(columns: list[np.ndarray]) -> bytes:
    """Columns of 32-bit numbers, their bytes sorted by place and compressed."""
    planes = np.stack(columns, dtype=np.int32, casting="same_kind").view(np.uint8).reshape(len(columns), -1, 4).transpose(0, 2, 1)
    return pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def _unpacked(data: bytes, columns: int, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(data, 4 * columns * n, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(columns, 4, n).transpose(0, 2, 1)).view(np.int32)[:, :, 0]


class LanguageModel:
    """Counts and classes; what a task needs. ``texts`` are the training texts of the shelves."""

    def __init__(self, head: list[tuple[bytes, int]], total: int, distinct: int, texts: DataFrame | None = None) -> None:
        self.ids = {bytes(t): k for k, (t, _) in enumerate(head)}
        self.counts = np.array([c for _, c in head], np.int64)
        self.least = head[-1][1] if head else None
        self.log_counts = np.log10(np.append(self.counts, 0) + 1.0)
        self.total, self.distinct, self.texts = total, distinct, texts
        self.base_log = float(np.log10(total + distinct + 1))
        others = distinct - len(head)
        deep = 0
        while 1 << BITS * deep < others and deep < 10:  # numbers have 31 bits
            deep += 1
        self.leaves = 1 << BITS * deep
        mass = np.append(self.counts + 1.0, total - self.counts.sum() + others + 1.0)
        self.tree = Classes(mass, deep)
        self.shelves, self.part = max(1, -(-total // SHELF)), PART

    def __getstate__(self) -> dict:
        return self.__dict__ | {"texts": None}

    def shelf(self, last: np.ndarray, before: np.ndarray, name: np.ndarray) -> np.ndarray:
        """Shelf of each event; frequent contexts have several, by the token before and the text's name."""
        starts = self.counts[self.ids[END]] if END in self.ids else 0
        # The two marks are the last entries, reached by their negative numbers.
        parts = 1 + np.concatenate([self.counts, [0], [starts, 0]]) // self.part
        own, other = (parts.take(np.minimum(x, len(self.counts))) for x in (last, before))
        part = np.zeros(len(last), np.uint64)
        hot = np.flatnonzero(own > 1)
        salt = name[hot] % np.minimum(own[hot], other[hot]).astype(np.uint64)
        part[hot] = _mixed(_mixed(_u64(before[hot])) + salt) % own[hot].astype(np.uint64)
        return (_mixed(_mixed(_u64(last) + np.uint64(1 << 43)) + part) % np.uint64(self.shelves)).astype(np.int64)


def _most_frequent(counts: DataFrame) -> list[tuple[bytes, int]]:
    """At most ``HEAD`` tokens, those above a count, most frequent first.

    The count is found from a histogram on a fine logarithmic scale, so only the tokens themselves reach the driver.
    """
    step = F.floor(F.log2("c") * 64)
    room, least = HEAD, None
    for at, n in sorted(counts.groupBy(step.alias("at")).agg(F.count("*").alias("n")).collect(), reverse=True):
        room -= n
        if room < 0:
            break
        least = at
    if least is None:
        return []
    found = counts.filter(step >= least).toArrow()
    rows = zip(found.column("token").to_pylist(), found.column("c").to_pylist(), strict=True)
    return sorted(rows, key=lambda r: (-r[1], r[0]))


def fit(docs: DataFrame, text: Column, remainder: Column, held_out: int) -> tuple[LanguageModel, DataFrame]:
    """The model, and the staged counts of all training tokens. Shelves are trained where they score."""
    known = docs.filter(remainder != held_out).select(text.cast("binary").alias("text"))
    counts = staged(count_tokens(known), "token-counts")
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    return LanguageModel(_most_frequent(counts), total, distinct, known), counts


def _name_of(text: bytes | None) -> bytes:
    import xxhash

    return xxhash.xxh3_128_digest(text or b"")


def _text_scores(texts: DataFrame, model: LanguageModel) -> DataFrame:
    """(name, n_tokens, known, logs, logp) of the distinct texts of a frame (text, scored, known); tokens outside the
    head count neither as known nor in ``logs``.

    Stretches of texts are dealt to shelves, shelves train and score, and their sums are added up by stretch.
    """
    shared = texts.sparkSession.sparkContext.broadcast(model)
    number = np.dtype([("name", "V16"), ("unit", "i8"), ("scored", "i8"), ("n", "i8"), ("known", "i8"), ("logs", "f8")])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        lm, task = shared.value, TaskContext.get().partitionId() << 32
        stretch = unit = 0
        for batch in batches:
            held: dict[bytes, list] = {}
            for text, scored, known in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = held.setdefault(_name_of(text), [text, 0, 0])
                own[1] |= scored
                own[2] += known
            names = np.array(list(held), "V16")
            keys = names.view(np.uint64)[::2]
            scored, often = (np.array([h[i] for h in held.values()], np.int64) for i in (1, 2))
            for numbers, parts, lengths in _stretches([h[0] for h in held.values()], lm.ids, lm.leaves):
                token, last, before = _events(parts)
                starts = np.cumsum(lengths) - lengths
                of = np.array(numbers)
                place = np.repeat(np.arange(len(of)), lengths)
                known = token < len(lm.ids)
                head = np.empty(len(of), number)
                head["name"], head["unit"], head["scored"], head["n"] = names[of], task + unit + of, scored[of], lengths
                head["known"] = np.add.reduceat(known.astype(np.int64), starts)
                head["logs"] = np.add.reduceat(np.where(known, lm.log_counts[np.minimum(token, len(lm.ids))], 0.0), starts)
                shelf = lm.shelf(last, before, keys[of][place])
                order = np.argsort(shelf.astype(np.int32 if lm.shelves > 1 << 15 else np.int16), kind="stable")
                edges = np.flatnonzero(np.diff(shelf[order], prepend=-1))
                rows = [(lm.shelves + (task + stretch) % lm.shelves, len(of), head.tobytes())]
                columns = [x.astype(np.int32).take(order) for x in (token, last, before, place, often[of][place])]
                for low, high in zip(edges, np.append(edges[1:], len(order)), strict=True):
                    own = [x[low:high] for x in columns]
                    own[3] = np.diff(own[3], prepend=np.int32(0))
                    rows.append((shelf[order[low]], high - low, _packed(own)))
                for low in range(0, len(rows), 256):
                    own = list(zip(*rows[low : low + 256], strict=True))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(own[0], pa.int64()), pa.array([task + stretch] * len(own[0]), pa.int64()),
                         pa.array(own[1], pa.int32()), pa.array(own[2], pa.binary())], names=["shelf", "stretch", "n", "data"],
                    )
                stretch += 1
            unit += len(held)

    def of_shelf(lm: LanguageModel, rows: list[tuple[int, int, bytes]]) -> Iterator[pa.RecordBatch]:
        columns = np.concatenate([_unpacked(data, 5, n) for _, n, data in rows], axis=1)
        each = fit_and_score(lm.tree, *columns[:3].astype(np.int64), columns[4])
        low = 0
        for stretch, size, _ in rows:
            place = np.cumsum(columns[3, low : low + size])
            edge = np.flatnonzero(np.diff(place, prepend=-1))
            sums = np.add.reduceat(each[low : low + size], edge).astype(np.float32)
            low += size
            data = _packed([np.diff(place[edge], prepend=0), sums.view(np.int32)])
            yield pa.RecordBatch.from_arrays(
                [pa.array([stretch], pa.int64()), pa.array([False]), pa.array([len(edge)], pa.int32()), pa.array([data], pa.binary())],
                names=["stretch", "head", "n", "data"],
            )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lm, held, current = shared.value, [], None
        for batch in batches:
            for shelf, stretch, n, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if shelf != current:
                    if held:
                        yield from of_shelf(lm, held)
                    held, current = [], shelf
                if shelf < lm.shelves:
                    held.append((stretch, n, data))
                else:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([stretch], pa.int64()), pa.array([True]), pa.array([n], pa.int32()), pa.array([data], pa.binary())],
                        names=["stretch", "head", "n", "data"],
                    )
        if held:
            yield from of_shelf(lm, held)

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = logp = None

        def out() -> Iterator[pa.RecordBatch]:
            if head is not None and head["scored"].any():
                own = np.flatnonzero(head["scored"])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x.tobytes() for x in head["name"][own]], pa.binary()),
                     *(pa.array(head[c][own]) for c in ("unit", "n", "known", "logs")), pa.array(logp[own])],
                    names=["name", "unit", "n_tokens", "known", "logs", "logp"],
                )

        for batch in batches:
            for _, is_head, n, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if is_head:
                    yield from out()
                    head, logp = np.frombuffer(data, number), np.zeros(n)
                else:
                    place, sums = _unpacked(data, 2, n)
                    logp[np.cumsum(place)] += sums.view(np.float32)
        yield from out()

    partitions = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = texts.mapInArrow(deal, "shelf long, stretch long, n int, data binary")
    dealt = dealt.repartition(max(partitions, 2 * model.shelves), "shelf").sortWithinPartitions("shelf", "stretch")
    sums = dealt.mapInArrow(work, "stretch long, head boolean, n int, data binary")
    sums = sums.repartition("stretch").sortWithinPartitions("stretch", F.desc("head"))
    units = sums.mapInArrow(add_up, "name binary, unit long, n_tokens long, known long, logs double, logp double")
    whole = units.groupBy("name", "unit").agg(*(F.sum(c).alias(c) for c in ("n_tokens", "known", "logs", "logp")))
    return whole.groupBy("name").agg(*(F.max(c).alias(c) for c in ("n_tokens", "known", "logs", "logp")))


def score(
    docs: DataFrame, text: Column, model: LanguageModel, counts: DataFrame, carry: dict[str, Column], known: Column | None = None,
) -> DataFrame:
    """``carry``'s columns, n_tokens, n_known, base_score and score of each row.

    ``known`` tells which rows are the training texts, if ``docs`` has them all; without it they are read besides.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    text = text.cast("binary")
    rows = docs.select(text.alias("__text"), *(c.alias(n) for n, c in carry.items()))
    kept = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema.fields[1:])
    texts = docs.select(
        text.alias("text"), F.lit(True).alias("scored"), (F.lit(False) if known is None else known).alias("known")
    )
    if known is None and model.texts is not None:
        texts = texts.unionByName(model.texts.select("text", F.lit(False).alias("scored"), F.lit(True).alias("known")))

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = pa.array([_name_of(x) for x in batch.column(0).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], names], names=[*batch.schema.names[1:], "__name"])

    def far(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Tokens outside the head, once per text and task."""
        from pyspark import TaskContext

        ids, task = shared.value.ids, TaskContext.get().partitionId()
        seen: set[bytes] = set()
        for batch in batches:
            held = {}
            for text in batch.column(0).to_pylist():
                held.setdefault(_name_of(text), text)
            names = [x for x in held if x not in seen]
            seen.update(names)
            texts = [held[x] for x in names]
            for group in _groups(texts):
                words, counts = split_words(texts[group])
                at = np.flatnonzero(_head_numbers(words, ids) < 0)
                found, of = words.take(pa.array(at)), np.repeat(np.arange(len(counts)), counts)[at]
                if END not in ids:
                    found = pa.concat_arrays([found, pa.array([END] * len(counts), pa.binary())])
                    of = np.append(of, np.arange(len(counts)))
                if not len(found):
                    continue
                coded = found.dictionary_encode()
                types = len(coded.dictionary)
                pairs, n = np.unique(of * types + coded.indices.to_numpy(), return_counts=True)
                own = pa.array(names[group], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [coded.dictionary.take(pa.array(pairs % types)), own.take(pa.array(pairs // types)),
                     pa.array(np.full(len(pairs), task, np.int32)), pa.array(n.astype(np.int32))],
                    names=["token", "name", "task", "n"],
                )

    leaf = F.xxhash64("token").bitwiseAND(F.lit(model.leaves - 1)).alias("leaf")
    others = counts if model.least is None else counts.filter(F.col("c") < model.least)
    leaves = others.groupBy(leaf).agg(F.sum(F.col("c") + 1).alias("mass"), F.collect_list(F.struct("token", "c")).alias("types"))
    rest = rows.select("__text").mapInArrow(far, "token binary, name binary, task int, n int")
    own = rest.select("*", leaf).join(leaves, "leaf", "left").withColumn("c", F.expr("get(filter(types, x -> x.token = token), 0).c"))
    log_count = F.log10(F.coalesce("c", F.lit(0)) + 1.0)
    met = own.groupBy("name", "task").agg(
        F.sum(F.col("n") * log_count).alias("s"), F.sum(F.when(F.col("c").isNotNull(), F.col("n")).otherwise(0)).alias("m"),
        F.sum(F.col("n") * F.log10(F.coalesce("mass", F.lit(0)) + 1.0)).alias("shared"),
    )
    per_text = met.groupBy("name").agg(F.max("s").alias("far"), F.max("m").alias("far_known"), F.max("shared").alias("shared"))
    per_text = _text_scores(texts, model).join(per_text, "name", "left").withColumnRenamed("name", "__name")
    joined = rows.mapInArrow(named, f"{kept}__name binary").join(per_text, "__name", "left")
    far_logs = F.coalesce("far", F.lit(0.0))
    return joined.select(
        *carry, "n_tokens", (F.col("known") + F.coalesce("far_known", F.lit(0))).alias("n_known"),
        (F.col("logs") + far_logs - F.col("n_tokens") * model.base_log).alias("base_score"),
        (F.col("logp") + far_logs - F.coalesce("shared", F.lit(0.0))).alias("score"),
    )
