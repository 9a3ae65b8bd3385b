"""Token stores, packing and the language model against plain Python."""

from __future__ import annotations

import itertools
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewell.llm import max_entropy, packing, token_files, tokens
from tidewell.llm.common import id_remainder, shared_folder

BYTES, WORDS = "byte_bpe_50k.json", "word_bpe_49k.json"
ODD = [
    "a  b   c \n\n d\n", "<|endoftext|> x", "foo\tbar 's it's", "", "x y z", "é ́ x", "ABC Straße İI",
    "word.\nNext  \n", "x\x1cy", "1 23 45a b6", "🙂🙂 世界 こん", " lead", "trail ", "a\x85b", "end.,", "x_.", "Ünï., 9,",
]


@pytest.mark.parametrize(("name", "spaced"), [(BYTES, True), (WORDS, False)])
@pytest.mark.parametrize("cached", [tokens.CACHED, 3])
def test_units_give_the_tokenizer_s_ids(name, spaced, cached, monkeypatch):
    own = tokens.Encoder(tokens.vocabulary_path(name), spaced, cached)
    rng = random.Random(5)
    texts = ODD + ["".join(rng.choices("aB .,\n'é9*", k=rng.randint(1, 60))) for _ in range(300)] + [None]
    for piece in (1 << 20, 7):
        monkeypatch.setattr(tokens, "PIECE", piece)
        for text, ids in zip(texts, own.encode(texts), strict=True):
            assert ids.tolist() == own.tokenizer.encode(text or "", add_special_tokens=False).ids, text


def test_store_round_trip(spark, tmp_path):
    rng = random.Random(2)
    rows = [(i * 3, " ".join(rng.choices(["the", "Cat", "é", "xyzzy"], k=rng.randint(0, 40)))) for i in range(60)]
    rows += [(9, None), (None, "no id"), (6, rows[2][1])]
    rng.shuffle(rows)
    frame = spark.createDataFrame([(*r, 1) for r in rows], "doc_id bigint, text string, start int")
    path = tokens.vocabulary_path(BYTES)
    store = token_files.write_store(frame, f"file://{tmp_path}/store", path, parts=4)
    out = token_files.read_store(spark, store).collect()
    encoder, start = tokens.encoder(path, True), 0
    want = []
    for i, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = [*encoder.encode([text])[0].tolist(), 0]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    key = lambda r: r[1]
    assert sorted(map(tuple, out), key=key) == sorted(want, key=key)
    assert store.dtype == "<u2"
    none = token_files.write_store(frame.limit(0), f"file://{tmp_path}/none", path)
    assert token_files.read_store(spark, none).count() == 0


def test_a_part_written_twice_counts_once(spark, tmp_path):
    """A lost attempt leaves files that no manifest names."""
    frame = spark.createDataFrame([(1, "one two")], "doc_id bigint, text string")
    folder = f"file://{tmp_path}/twice"
    for _ in range(2):
        store = token_files.write_store(frame, folder, tokens.vocabulary_path(BYTES))
    assert token_files.read_store(spark, store).count() == 1


# ---- packing


def check_bins(histogram, capacity):
    placement = packing.plan_bins(histogram, capacity)
    places = []
    for length, n in histogram.items():
        sequence, offset = placement.of(np.full(n, length), np.arange(n))
        places += zip(sequence.tolist(), offset.tolist(), [length] * n, strict=True)
    for _, bin_ in itertools.groupby(sorted(places), key=lambda p: p[0]):
        at = 0
        for _, offset, length in bin_:
            assert offset == at
            at += length
        assert at <= capacity
    assert len({p[0] for p in places}) == placement.sequences
    return placement.sequences


def fewest_bins(lengths, capacity):
    """Exhaustive search."""
    best = len(lengths)

    def put(k, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if k == len(lengths):
            best = len(rooms)
            return
        for i in {r: i for i, r in enumerate(rooms)}.values():
            if rooms[i] >= lengths[k]:
                put(k + 1, [*rooms[:i], rooms[i] - lengths[k], *rooms[i + 1 :]])
        put(k + 1, [*rooms, capacity - lengths[k]])

    put(0, [])
    return best


def test_packing_is_valid_and_near_the_optimum():
    rng = random.Random(4)
    over = 0
    for _ in range(60):
        capacity = rng.randint(6, 20)
        lengths = sorted((rng.randint(1, capacity) for _ in range(9)), reverse=True)
        got = check_bins(dict(Counter(lengths)), capacity)
        over += got - fewest_bins(lengths, capacity)
    assert over <= 1


def test_fixed_sets_keep_an_optimum():
    rng = random.Random(6)
    for _ in range(60):
        capacity = rng.randint(6, 16)
        lengths = [rng.randint(1, capacity) for _ in range(8)]
        counts = np.bincount(lengths, minlength=capacity + 1)
        fixed = packing.reduce_dominated(counts)
        rest = np.repeat(np.arange(capacity + 1), counts).tolist()
        bins = sum(n for _, n in fixed)
        assert bins + (fewest_bins(sorted(rest, reverse=True), capacity) if rest else 0) == fewest_bins(sorted(lengths, reverse=True), capacity)


def test_large_histograms_are_within_a_bin_of_the_bound():
    rng = np.random.default_rng(1)
    histogram = {int(k): int(n) for k, n in zip(*np.unique(rng.integers(1, 1500, 50_000), return_counts=True), strict=True)}
    bound = math.ceil(sum(k * n for k, n in histogram.items()) / 2048)
    assert check_bins(histogram, 2048) <= bound * 1.01 + 1
    assert check_bins({1: 5000, 2048: 3}, 2048) == 3 + 3
    assert packing.plan_bins({}).sequences == 0


def test_documents_are_cut_and_placed(spark):
    rows = [(1, "word " * 5000), (2, None), (3, ""), (4, "hello there"), (4, "hello there"), (None, "x")]
    frame = spark.createDataFrame([(*r, 0) for r in rows], "doc_id bigint, text string, offset int")
    path = tokens.vocabulary_path(WORDS)
    out = packing.pack_documents(frame, path).collect()
    whole = np.append(tokens.encoder(path, False).encode(["word " * 5000])[0], 0).astype("<u4")
    pieces = sorted((r for r in out if r.doc_id == 1), key=lambda r: r.piece)
    assert [(r.start, r.length) for r in pieces] == [(0, 2048), (2048, 2048), (4096, 905)]
    assert all(r.ids_crc32 == zlib.crc32(whole[r.start : r.start + r.length].tobytes()) for r in pieces)
    assert len(out) == len(rows) + 2
    for _, bin_ in itertools.groupby(sorted(out, key=lambda r: (r.sequence_id, r.offset)), key=lambda r: r.sequence_id):
        at = 0
        for r in bin_:
            assert r.offset == at
            at += r.length
        assert at <= 2048
    assert packing.pack_documents(frame.limit(0), path).count() == 0


# ---- language model


@pytest.mark.parametrize("head", [max_entropy.HEAD, 4])
def test_base_scores_and_counts_equal_plain_ones(spark, monkeypatch, head):
    monkeypatch.setattr(max_entropy, "HEAD", head)
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choices(["the", "The", "a", "é", "rare%d" % i, "b"], k=rng.randint(0, 30)))) for i in range(40)]
    rows += [(50, None), (51, ""), (7, rows[7][1]), (52, "never-seen"), (None, "the a")]
    frame = spark.createDataFrame([(*r, 0.0) for r in rows], "doc_id bigint, text string, score double")
    text, remainder = F.coalesce("text", F.lit("")), id_remainder(F.col("doc_id"), 7)
    model, counts = max_entropy.fit(frame, text, remainder, held_out=2)
    out = max_entropy.score(frame, text, model, counts, {"doc_id": F.col("doc_id"), "held_out": remainder == 2}).collect()
    words = lambda t: ["".join(c.lower() if c.isascii() else c for c in w) for w in (t or "").split()] + ["\n"]
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    c = Counter(w for i, t in rows if not held(i) for w in words(t))
    n, v = sum(c.values()), len(c)
    assert model.total == n and len(out) == len(rows)
    want = {i: words(t) for i, t in rows}
    for r in out:
        own = want[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known) == (held(r.doc_id), len(own), sum(w in c for w in own))
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in own))
        assert r.score < 0
    assert max_entropy.score(frame.limit(0), text, model, counts, {}).count() == 0
    nothing = frame.limit(0)
    model, counts = max_entropy.fit(nothing, text, remainder, held_out=2)
    assert model.total == 0 and max_entropy.score(frame, text, model, counts, {}).count() == len(rows)


def test_probabilities_of_all_tokens_sum_to_one():
    model = max_entropy.Weights.zero()
    rng = np.random.default_rng(0)
    model.classes[:] = rng.normal(size=model.classes.shape)
    model.words[:] = rng.normal(size=model.words.shape)
    everything = np.arange(max_entropy.RARE + 1)
    for last, before in ((3, 5), (max_entropy.RARE, max_entropy.START)):
        p = max_entropy.log_probability(model, everything, np.full_like(everything, last), np.full_like(everything, before))
        assert (10**p).sum() == pytest.approx(1)


def test_stretches_carry_their_context(monkeypatch):
    text = b" ".join(b"w%d" % (i % 5) for i in range(50))
    ids = {b"w%d" % i: i for i in range(5)}

    def triples():
        found = Counter()
        for _, parts, _ in max_entropy._stretches([text, None, text], ids):
            t, a, b, n, _ = max_entropy._triples(parts)
            found.update(dict(zip(zip(t.tolist(), a.tolist(), b.tolist(), strict=True), n.tolist(), strict=True)))
        return found

    whole = triples()
    monkeypatch.setattr(max_entropy, "STRETCH", 7)
    assert triples() == whole and sum(whole.values()) == 103


def test_the_model_beats_counts_on_held_out_text(spark):
    frame = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    text, remainder = F.coalesce("text", F.lit("")), id_remainder(F.col("doc_id"), 7)
    model, counts = max_entropy.fit(frame, text, remainder, held_out=2)
    held = max_entropy.score(frame.filter(remainder == 2), text, model, counts, {})
    base, score = held.agg(F.sum("base_score"), F.sum("score")).first()
    assert score > base


def test_probabilities_of_head_and_leaves_sum_to_one():
    rng = np.random.default_rng(1)
    tree = max_entropy.Classes(np.sort(rng.pareto(1, 700))[::-1] + 1, deep=2)
    weights = max_entropy.Weights.zero(tree)
    weights.classes[:] = rng.normal(size=weights.classes.shape)
    weights.words[:] = rng.normal(size=weights.words.shape)
    everything = np.arange(699 + max_entropy.WIDTH**2)
    for last, before in ((3, 5), (750, max_entropy.START)):
        p = max_entropy.log_probability(weights, everything, np.full_like(everything, last), np.full_like(everything, before))
        assert (10**p).sum() == pytest.approx(1)


@pytest.mark.parametrize("head", [max_entropy.HEAD, 50])
def test_tokens_of_any_rank_depend_on_what_stands_before(spark, monkeypatch, head):
    monkeypatch.setattr(max_entropy, "HEAD", head)
    rng = random.Random(3)
    texts = [" ".join(f"x{i} y{i}" for i in rng.choices(range(1500), k=200)) for _ in range(200)]
    rows = [(i, t, 1) for i, t in enumerate(texts)] + [(1000, "x7 y7 x1400 y1400", 2), (1001, "x7 y1400 x1400 y7", 2)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, part int")
    model, counts = max_entropy.fit(frame, F.col("text"), F.col("part"), held_out=2)
    held = max_entropy.score(frame.filter("part = 2"), F.col("text"), model, counts, {"doc_id": F.col("doc_id")}).collect()
    found = {r.doc_id: r for r in held}
    assert found[1000].base_score == pytest.approx(found[1001].base_score)
    assert found[1000].score > found[1001].score + 1


@pytest.mark.parametrize("head", [max_entropy.HEAD, 9])
def test_scores_equal_plain_ones_at_any_split(spark, monkeypatch, head):
    import xxhash

    for name, value in (("HEAD", head), ("SHELF", 300), ("PART", 40)):
        monkeypatch.setattr(max_entropy, name, value)
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choices(["the", "of", *(f"w{k}" for k in range(30))], k=rng.randint(0, 40))), i % 7) for i in range(60)]
    rows += [(60, rows[3][1], 1), (61, rows[3][1], 2), (62, None, 2), (63, "unknown the w1", 2)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, part int")
    model, counts = max_entropy.fit(frame, F.col("text"), F.col("part"), held_out=2)
    carry = {"doc_id": F.col("doc_id")}
    runs = [
        max_entropy.score(frame.repartition(1), F.col("text"), model, counts, carry, known=F.col("part") != 2),
        max_entropy.score(frame.repartition(5), F.col("text"), model, counts, carry),
        max_entropy.score(frame.filter("part = 2"), F.col("text"), model, counts, carry),
    ]
    first, *others = ({r.doc_id: r.score for r in run.collect()} for run in runs)
    assert len(first) == len(rows) and len(others[1]) < len(rows) and model.shelves > 3

    words = [(t or "").encode().split() + [max_entropy.END] for _, t, _ in rows]
    c = Counter(w for (_, _, part), own in zip(rows, words, strict=True) if part != 2 for w in own)
    number = lambda w: model.ids.get(w, len(model.ids) + (xxhash.xxh64_intdigest(w, 42) & model.leaves - 1))
    events, of, known, keys = [], [], [], []
    for k, own in enumerate(words):
        ids = [max_entropy.START] * 2 + [number(w) for w in own]
        events += zip(ids[2:], ids[1:], ids, strict=False)
        of += [k] * len(own)
        known += [rows[k][2] != 2] * len(own)
        keys += [int.from_bytes(xxhash.xxh3_128_digest((rows[k][1] or "").encode())[:8], "little")] * len(own)
    token, last, before = np.array(events).T
    shelf, logp = model.shelf(last, before, np.array(keys, np.uint64)), np.zeros(len(events))
    for s in np.unique(shelf):
        own = np.flatnonzero(shelf == s)
        logp[own] = max_entropy.fit_and_score(model.tree, token[own], last[own], before[own], np.array(known)[own].astype(int))
    want = np.bincount(of, logp)
    for k, own in enumerate(words):
        for w in own:
            if w not in model.ids:
                want[k] += math.log10((c[w] + 1) / (1 + sum(m + 1 for v, m in c.items() if v not in model.ids and number(v) == number(w))))
    for run in (first, *others):
        assert all(x == pytest.approx(want[i], rel=1e-4) for i, x in run.items())


def test_words_of_many_texts_equal_plain_ones(monkeypatch):
    monkeypatch.setattr(max_entropy, "GROUP", 100)
    rng = random.Random(5)
    alphabet = list(b" \t\n\x0b\x0c\r\x00\x1c\x1f\x85\xa0AZaz\xc3\xa9\xff")
    texts = [None, b"", b" ", b"\xff\xfeA", b"a" * 500] + [bytes(rng.choices(alphabet, k=rng.randint(0, 30))) for _ in range(300)]
    plain = [bytes(b + 32 if 65 <= b <= 90 else b for b in t or b"").split() for t in texts]
    groups = list(max_entropy._groups(texts))
    assert len(groups) > 10 and [k for g in groups for k in range(g.start, g.stop)] == list(range(len(texts)))
    for g in groups:
        words, counts = max_entropy.split_words(texts[g])
        assert counts.tolist() == [len(own) for own in plain[g]]
        assert words.to_pylist() == [w for own in plain[g] for w in own]


def test_a_word_outside_the_head_is_hashed_once_for_many_texts(monkeypatch):
    import xxhash

    hashed, digest = [], xxhash.xxh64_intdigest
    monkeypatch.setattr(xxhash, "xxh64_intdigest", lambda w, seed: hashed.append(w) or digest(w, seed))
    found = list(max_entropy._stretches([b"the Rare the", None, b"rare"] * 200, {b"the": 0, b"\n": 1}, 8))
    rare = 2 + (digest(b"rare", 42) & 7)
    assert [p.tolist() for _, parts, _ in found for p in parts] == [[-2, -2, 0, rare, 0, 1], [-2, -2, 1], [-2, -2, rare, 1]] * 200
    assert len(hashed) <= 2


@pytest.mark.parametrize("length", [1 << 9, 1 << 20])
def test_a_step_equals_a_plain_one(length):
    rng = np.random.default_rng(6)
    m, width = 300, max_entropy.WIDTH
    # Row 3 is that of all events, others are met once, and some events meet a row with two features.
    rows = np.stack([np.full(m, 3), rng.integers(0, 40, m), rng.integers(0, length, m), rng.integers(0, length, m)])
    rows[3, :20] = rows[2, :20]
    prior, right, n = rng.normal(size=(m, width)), rng.integers(0, width, m), rng.integers(1, 4, m)
    table, squares = rng.normal(size=(length, width)).astype(np.float32), rng.random((length, width)).astype(np.float32)
    p = np.exp(table[rows].astype(float).sum(axis=0) + prior)
    p /= p.sum(axis=1, keepdims=True)
    p[np.arange(m), right] -= 1
    gradient = np.zeros((length, width))
    np.add.at(gradient, rows.ravel(), np.tile(p * n[:, None], (4, 1)))
    sums = squares + gradient**2
    want = table - max_entropy.RATE * gradient / np.sqrt(sums + 1)
    max_entropy._step(table, squares, rows, prior.astype(np.float32), right, n.astype(np.float32))
    assert np.allclose(table, want, atol=1e-4) and np.allclose(squares, sums, rtol=1e-4, atol=1e-4)
