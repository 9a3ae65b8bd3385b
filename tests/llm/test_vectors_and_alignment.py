"""Lattice hashing, the multi-index and the aligner against plain Python over all pairs."""

from __future__ import annotations

import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest

from tidewell.llm import alignment, lattice, multi_index, tokens

BYTE, PIECE = (tokens.vocabulary_path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
VECTORS = "vec_id bigint, embedding array<double>, label int, ball string, row int"


# --- near-duplicate vectors ---------------------------------------------------------------------
def vectors(seed=1, families=30, dim=24):
    rng = np.random.default_rng(seed)
    out = [None, [], [0.0] * dim, [1.0, None], [float("nan")] * dim, [float("inf"), 1.0], [1e-200, 0.0], [1e200, 0.0], [3.0]]
    for f in range(families):
        base = rng.normal(size=dim)
        for k in range([1, 2, 6, 40][f % 4]):
            spread = [0.0, 0.02, 0.15, 0.4][(f // 4) % 4]
            out.append((base * (1 + k % 3) + spread * rng.normal(size=dim) * (k > 0)).tolist())
    return out


def plain_links(rows, threshold=0.95):
    """(links, smallest id reachable) by id, from all pairs."""
    usable = {
        i: np.array(v) / max(map(abs, v)) for i, v in rows
        if v and all(x is not None and math.isfinite(x) for x in v) and any(v)
    }
    reach = {i: i for i, _ in rows}
    links = Counter()

    def root(x):
        while reach[x] != x:
            x = reach[x]
        return x

    ids = sorted(usable)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            x, y = usable[a], usable[b]
            m = min(len(x), len(y))
            if x[:m] @ y[:m] / math.sqrt((x @ x) * (y @ y)) >= threshold:
                links.update((a, b))
                p, q = sorted((root(a), root(b)))
                reach[q] = p
    return {i: (links[i], root(i)) for i in reach}


def test_shortest_vectors_and_nearest_points():
    steps = lattice.shortest_vectors() / 2
    assert len({tuple(s) for s in steps.tolist()}) == 240 and ((steps**2).sum(axis=1) == 2).all()
    x = np.random.default_rng(3).normal(size=(500, 8)) * 2
    points = lattice.decode(x) / 2
    # lattice points have only integer or only half-integer coordinates, and an even sum
    assert ((points % 1 == 0).all(axis=1) | (points % 1 == 0.5).all(axis=1)).all() and (points.sum(axis=1) % 2 == 0).all()
    own = ((x - points) ** 2).sum(axis=1)
    others = ((x[:, None] - points[:, None] - steps) ** 2).sum(axis=2).min(axis=1)
    assert (own <= others + 1e-9).all()


@pytest.mark.parametrize("rows", [10_000, 100_000_000, 10**12])
def test_recall_at_the_threshold(rows):
    hashing, rng = lattice.hashing_for(rows), np.random.default_rng(7)
    u = rng.normal(size=(600, 64))
    u /= np.linalg.norm(u, axis=1)[:, None]
    e = rng.normal(size=u.shape)
    e -= (e * u).sum(axis=1)[:, None] * u
    v = 0.95 * u + math.sqrt(1 - 0.95**2) * e / np.linalg.norm(e, axis=1)[:, None]
    (a, more_a), (b, more_b) = lattice.cells(u, hashing), lattice.cells(v, hashing)
    met = [bool({*a[i]} & ({*b[i]} | {*more_b[i]}) or {*b[i]} & {*more_a[i]}) for i in range(len(u))]
    assert np.mean(met) >= 0.95


def test_links_equal_those_of_all_pairs(spark):
    rows = list(enumerate(vectors()))
    random.Random(2).shuffle(rows)
    frame = spark.createDataFrame([(i, v, 0, "x", 1) for i, v in rows], VECTORS)
    out = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in lattice.find_near_vectors(frame).collect()}
    plain = plain_links(rows)
    assert out.keys() == plain.keys()
    # nothing below the threshold is ever linked, and what is missed is less than one link in ten
    found, wanted = sum(x[0] for x in out.values()), sum(x[0] for x in plain.values())
    assert all(out[i][0] <= plain[i][0] for i in out) and found >= 0.9 * wanted
    assert sum(out[i][:2] == plain[i] for i in out) >= 0.97 * len(out)
    assert all(kept == (component == i) for i, (_, component, kept) in out.items())


def test_balls_are_compared_by_members_where_angles_do_not_decide(spark):
    rng = np.random.default_rng(4)
    rows, spread = [], math.tan(math.acos(0.95)) / 2
    for side in (-1, 1):  # two tight groups whose members are some just above, some just below the threshold apart
        for k in range(40):
            v = np.zeros(16)
            v[0], v[1] = 1.0, side * spread
            rows.append((len(rows), (v + 0.03 * rng.normal(size=16)).tolist()))
    frame = spark.createDataFrame([(i, v, 0, None, 1) for i, v in rows], VECTORS)
    wide = lattice.Hashing(tables=8, width=4.0, probes=8)
    out = {r.vec_id: (r.n_links, r.component_id) for r in lattice.find_near_vectors(frame, hashing=wide).collect()}
    plain = plain_links(rows)
    assert 0 < sum(x[0] for x in plain.values()) < 80 * 79 and out == plain


def test_copies_count_as_links_and_ids_may_repeat(spark):
    data = [(5, [1.0, 2.0]), (3, [2.0, 4.0]), (3, [1.0, 2.0]), (None, [1.0, 2.0]), (8, [2.0, -1.0]), (None, None)]
    frame = spark.createDataFrame([(i, v, 0, "", 0) for i, v in data], VECTORS)
    out = sorted(map(tuple, lattice.find_near_vectors(frame).collect()), key=repr)
    assert out == sorted([(5, 3, 3, False), (3, 3, 3, True), (3, 3, 3, True), (None, 3, 3, False), (8, 0, 8, True), (None, 0, None, True)], key=repr)
    assert lattice.find_near_vectors(frame.limit(0)).count() == 0


# --- hard negatives -----------------------------------------------------------------------------
def plain_negatives(rows):
    """All pairs, for rows (id, vector, label) with ids of their own."""
    usable = [
        (i, [math.floor(256 * x) for x in v], lab) for i, v, lab in rows
        if i is not None and lab is not None and v and all(x is not None and math.isfinite(x) for x in v)
    ]
    dot = lambda x, y: sum(a * b for a, b in zip(x, y, strict=False))
    out = []
    for i, v, lab in usable:
        if i % 50:
            continue
        ranked = sorted((-dot(v, w), j, other) for j, w, other in usable if j != i)
        for s, p, _ in [x for x in ranked if x[2] == lab][:5]:
            fit = [(-t, j) for t, j, other in ranked if other != lab and 50 * -s <= 100 * -t <= 95 * -s][:3]
            out += [(i, p, k + 1, j, -s, t) for k, (t, j) in enumerate(fit)]
    return sorted(out)


@pytest.mark.parametrize("shelf_rows", [None, 40])
@pytest.mark.parametrize("dim", [1, 7, 32])
def test_negatives_equal_those_of_all_pairs(spark, monkeypatch, shelf_rows, dim):
    monkeypatch.setattr(multi_index, "STRIDE", 16)
    rng = np.random.default_rng(dim)
    centres = rng.normal(size=(4, dim))
    rows = []
    for i in range(600):
        label = int(rng.integers(4))
        v = (centres[label] + 0.6 * rng.normal(size=dim)).tolist()
        if i % 9 == 0:
            v = rows[i // 2][1] if i else v  # copies, also across labels
        rows.append((i, v, label))
    rows += [(1000, None, 1), (1050, [], 1), (1100, [None] * dim, 1), (1150, [float("nan")] * dim, 1), (1200, [1.0] * dim, None),
             (1250, [0.0] * dim, 2), (1300, [0.5], 3), (None, [1.0] * dim, 0), (1350, [1e6] * dim, 0)]
    frame = spark.createDataFrame([(i, v, lab, "x", 4) for i, v, lab in rows], VECTORS)
    found = multi_index.mine(frame, shelf_rows=shelf_rows)
    assert sorted(map(tuple, found.collect())) == plain_negatives(rows)


def test_scores_beyond_doubles_are_exact(spark):
    big = 2.0**21
    rows = [(0, [big, 1.0, big], 0), (1, [big, 1.0, big], 0), (2, [big, 0.5, big / 2], 1), (3, [big, 0.5 + 2**-8, big / 2], 1)]
    frame = spark.createDataFrame([(*r, "", 0) for r in rows], VECTORS)
    out = sorted(map(tuple, multi_index.mine(frame).collect()))
    assert out == plain_negatives(rows) and len(out) == 2 and out[0][4] > 2**53
    assert multi_index.mine(frame.limit(0)).count() == 0


def test_the_walk_visits_cells_by_falling_bound_and_stops_early(spark):
    rng = np.random.default_rng(9)
    centres = 4 * rng.normal(size=(8, 16))
    frame = spark.createDataFrame(
        [(i, (centres[i % 8] + 0.05 * rng.normal(size=16)).tolist(), i % 8, "", 0) for i in range(800)], VECTORS
    )
    rows = multi_index.prepare(frame, "vec_id", "embedding", "label", 256.0)
    index, on_shelf = multi_index.build_index(rows, 10_000)
    shelf = multi_index.Shelf(index, on_shelf.toArrow().to_batches())
    q = shelf.rows[0]
    walk = list(shelf.visit(q))
    assert sum(b - a for _, a, b in walk) == 800
    for k, (bound, a, b) in enumerate(walk):
        assert (shelf.rows[a:b] @ q <= bound).all() and (k == 0 or bound <= walk[k - 1][0] + 1e-6)
    at, score = shelf.positives(shelf.row[0], shelf.label[0], q, 5, -math.inf)
    others = np.flatnonzero((shelf.label == shelf.label[0]) & (shelf.row != shelf.row[0]))
    assert score.tolist() == sorted((shelf.rows[others] @ q).tolist(), reverse=True)[:5]
    assert walk[len(walk) // 2][0] < score[-1]  # half of the cells could have been left out


# --- alignment ----------------------------------------------------------------------------------
TEXTS = [
    None, "", " ", "a", "Hello, world!", "  two  spaces ", "tab\tnew\nline\r\n", "naïve café — 世界 🙂🙂", "<|endoftext|> and <s> </s> <unk> <0x41>",
    "a▁b", " ​x", "don't we're I'LL", "1234567890 3.14", "x" * 3000, "ab " * 2000, "\u0000\u0001", "Ａ ﬁ ² ½", "same text", "same text",
]


def plain_alignment(texts):
    """Groups by comparing sets of ends; links by comparing ranges; counts over all."""
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a_model, b_model = Tokenizer.from_file(BYTE), SentencePieceProcessor(model_file=PIECE)
    a_model.encode_special_tokens = True
    sides = alignment.ByteTokens(BYTE), alignment.PieceTokens(PIECE)
    count, docs = Counter(), []
    for text in texts:
        ids = [a_model.encode(f" {text}", add_special_tokens=False).ids, b_model.encode(text)] if text else [[], []]
        joined = [[side.bytes[k] for k in x] for side, x in zip(sides, ids, strict=True)]
        if not text or any(b"".join(j) != f" {text}".encode() for j in joined):
            docs.append(None)
            continue
        ends = [np.cumsum([len(t) for t in j]).tolist() for j in joined]
        common = sorted(set(ends[0]) & set(ends[1]))
        groups, links = [], []
        spans = [list(zip([0, *e], e)) for e in ends]
        for low, high in zip([0, *common], common):
            inside = [[k for k, (_, e) in enumerate(s) if low < e <= high] for s in spans]
            groups.append("|".join(",".join(str(ids[x][k]) for k in inside[x]) for x in (0, 1)))
            links += [
                (ids[0][i], ids[1][j]) for i in inside[0] for j in inside[1]
                if spans[0][i][0] < spans[1][j][1] and spans[1][j][0] < spans[0][i][1]
            ]
        count.update(links)
        docs.append((len(ids[0]), len(ids[1]), groups, links))
    best = Counter()
    for (_, b), n in count.items():
        best[b] = max(best[b], n)
    return [
        (0, 0, 0, 0, 0, 0, "") if d is None else (
            d[0], d[1], len(d[2]), len(d[3]), sum(count[x] == best[x[1]] for x in d[3]), sum(count[x] for x in d[3]),
            hashlib.sha256(";".join(d[2]).encode()).hexdigest(),
        ) for d in docs
    ]


@pytest.mark.parametrize("size", [alignment.CHUNK_SIZE, 30])
def test_alignment_equals_the_plain_one(spark, monkeypatch, size):
    monkeypatch.setattr(alignment, "CHUNK_SIZE", size)
    rng = random.Random(4)
    texts = TEXTS + ["".join(rng.choice("ab cé1,.\n世<") for _ in range(rng.randrange(200))) for _ in range(40)]
    frame = spark.createDataFrame([(i, t, "y", 5) for i, t in enumerate(texts)], "doc_id bigint, text string, chunk string, n_a int").repartition(3)
    out = {r.doc_id: tuple(r)[1:] for r in alignment.align_corpus(frame, BYTE, PIECE).collect()}
    assert [out[i] for i in range(len(texts))] == plain_alignment(texts)


def test_groups_join_to_both_sequences(spark):
    frame = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id bigint, text string")
    tool = alignment.aligner(BYTE, PIECE)
    for row in alignment.align_groups(frame, BYTE, PIECE).collect():
        pair = tool.tokens([TEXTS[row.doc_id]])[0] or ([], [])
        assert [x for g in row.groups for x in g.a] == list(pair[0]) and [x for g in row.groups for x in g.b] == list(pair[1])
    assert alignment.align_corpus(frame.limit(0), BYTE, PIECE).count() == 0
    repeated = frame.filter("doc_id = 4").unionByName(frame.filter("doc_id = 4"))
    assert len({tuple(r) for r in alignment.align_corpus(repeated, BYTE, PIECE).collect()}) == 1


@pytest.mark.parametrize("seed", range(20))
def test_runs_and_groups_cut_at_common_ends(seed):
    rng = random.Random(seed)
    top = rng.choice([1, 5, 60, 400])
    ends = [sorted({top, *rng.sample(range(1, top + 1), rng.randrange(top))}) for _ in range(2)]
    runs, groups, link_a, link_b = alignment.align(*ends)
    cuts = []
    for k, (i, j, n) in enumerate(runs):
        assert ends[0][i : i + n] == ends[1][j : j + n]
        cuts += ends[0][i : i + n]
        if k < len(groups):
            cuts.append(ends[0][groups[k][1] - 1])
    assert cuts == sorted({*ends[0]} & {*ends[1]})
    assert len(link_a) + sum(r[2] for r in runs) == len({*ends[0]} | {*ends[1]})
