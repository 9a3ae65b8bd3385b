"""Signature trees, components, licences and fixity audits against plain Python."""

from __future__ import annotations

import gzip
import hashlib
import random
import textwrap

import numpy as np
import pytest

from tidewell.llm import licenses, merkle, signature_tree
from tidewell.llm.components import connected_components
from tidewell.llm.shingles import shingle_set


def near_texts(seed, families=12, copies=12):
    rng = random.Random(seed)
    texts = [None, "", "  ", "one", "ONE", "one two three", "a b c d", "a b c d"]
    for _ in range(families):
        base = [f"w{rng.randrange(400)}" for _ in range(rng.choice([6, 9, 20, 60, 200]))]
        for _ in range(copies):
            words = list(base)
            for _ in range(rng.randrange(4)):
                words[rng.randrange(len(words))] = f"x{rng.randrange(50)}"
            texts.append(" ".join(words[rng.randrange(3) :]).upper() if rng.random() < 0.1 else " ".join(words[rng.randrange(3) :]))
    return texts


def plain_components(texts):
    def shingles(text):
        w = (text or "").lower().split()
        return frozenset(tuple(w[k : k + 4]) for k in range(max(1, len(w) - 3))) if w else frozenset()

    sets = [shingles(t) for t in texts]
    name = list(range(len(texts)))

    def root(x):
        while name[x] != x:
            x = name[x]
        return x

    links = set()
    for a in range(len(sets)):
        for b in range(a):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                links.add((b, a))
                x, y = root(a), root(b)
                name[max(x, y)] = min(x, y)
    return [len(s) for s in sets], [root(i) for i in range(len(sets))], links


@pytest.mark.parametrize("leaves", [signature_tree.LEAVES, 4])
def test_components_equal_those_of_all_pairs(spark, monkeypatch, leaves):
    monkeypatch.setattr(signature_tree, "LEAVES", leaves)
    texts = near_texts(1)
    frame = spark.createDataFrame([(i, t, 7) for i, t in enumerate(texts)], "doc_id bigint, text string, sid int")
    sizes, roots, _ = plain_components(texts)
    out = {r.doc_id: (r.n_shingles, r.component_id) for r in signature_tree.join_near(frame).collect()}
    assert out == {i: (n, c) for i, (n, c) in enumerate(zip(sizes, roots, strict=True))}


def test_linked_sets_always_share_a_key_and_trees_find_them():
    for seed in range(4):
        texts = near_texts(seed, families=20)
        _, _, links = plain_components(texts)
        sets = [shingle_set((t or "").encode(), 4) for t in texts]
        for a, b in links:
            if not np.array_equal(sets[a], sets[b]):
                assert np.intersect1d(signature_tree.part_keys(sets[a]), signature_tree.part_keys(sets[b])).size
        held = [k for k, s in enumerate(sets) if len(s)]
        found = signature_tree.link_sets([sets[k] for k in held])
        for a, b in links:
            assert found[held.index(a)] == found[held.index(b)]


def test_no_rows_no_links(spark):
    frame = spark.createDataFrame([(None, "a b c d e", 1), (None, None, 1)], "doc_id bigint, text string, x int")
    assert sorted(r.n_shingles for r in signature_tree.join_near(frame).collect()) == [0, 2]
    assert signature_tree.join_near(frame.limit(0)).count() == 0


def test_components_of_long_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(60)] + [(1000, i) for i in range(1001, 1080)] + [(5, 5)]
    random.Random(0).shuffle(links)
    found = dict(connected_components(spark.createDataFrame(links, "a bigint, b bigint")).collect())
    assert found == {**{i: 0 for i in range(61)}, **{i: 1000 for i in range(1000, 1080)}}


# ---- licences


def test_no_template_is_confirmed_without_an_anchor():
    chosen = set(licenses.anchors())
    for _, text in licenses._templates():
        pairs = set(licenses._pairs(text))
        assert sum(not chosen.intersection(p.split()) for p in pairs) < licenses.CONFIRM * len(pairs)


def test_families_are_told_apart(spark):
    texts = [f"Some opening line about nothing.\n{t}\nA closing line." for _, t in licenses._templates()]
    names = [f for f, _ in licenses._templates()]
    plain = ["", None, "\n\n", *licenses.CONFUSING, "licensed permission reserved", "word " * 3000, "The public sold all licenses under the table."]
    frame = spark.createDataFrame([(i, t, "x") for i, t in enumerate([*texts, *plain])], "doc_id bigint, text string, family string")
    out = {r.doc_id: r.licences for r in licenses.licences_of(frame, licenses.train(frame)).collect()}
    assert [out[i] for i in range(len(names))] == names
    assert {out[i] for i in range(len(names), len(out))} == {"unknown"}


def test_wrapped_notices_are_found(spark):
    templates = list(licenses._templates())
    texts = []
    for width in (24, 40, 72):
        for mark in ("", " * ", "# "):
            texts += ["Some opening line.\n\n" + "\n".join(mark + x for x in textwrap.wrap(t, width)) + "\n\nA closing line." for _, t in templates]
    first, second = templates[1][1], templates[11][1]
    close = "\n".join(["An opening line.", *textwrap.wrap(first, 40), "Words between them.", *textwrap.wrap(first, 50), *textwrap.wrap(second, 30)])
    apart = "Permission is hereby granted, free of charge,\n\nto any person obtaining a copy of this software\n\nand associated documentation files."
    frame = spark.createDataFrame(list(enumerate([*texts, close, apart])), "doc_id bigint, text string")
    out = {r.doc_id: (r.licences, r.n_notices) for r in licenses.licences_of(frame, licenses.train(frame)).collect()}
    assert [out[i] for i in range(len(texts))] == [(f, 1) for f, _ in templates] * 9
    assert out[len(texts)] == (",".join(sorted({templates[1][0], templates[11][0]})), 3)
    assert out[len(texts) + 1] == ("unknown", 0)


def test_every_line_is_learnt_from(spark):
    rows = [(i, f"All of line x{i}x\nanother line of the public work x{i}x\n \nAll rights reserved.") for i in range(4500)]
    frame = spark.createDataFrame([*rows, *rows[:100], (9999, None)], "doc_id bigint, text string")
    found = licenses.unknown_lines(frame).collect()
    count = {}
    for r in found:
        count[tuple(r.grams)] = count.get(tuple(r.grams), 0) + r.lines
    assert count == {("all", "of"): 4500, ("of", "of the", "public", "the", "the public", "work"): 4500}
    assert {r.half for r in found} == {0, 1}


# ---- fixity


def records(spark, rows):
    return spark.createDataFrame(
        [(f, k, 100 * k, 100, hashlib.sha256(d).hexdigest()) for f, k, d in rows], merkle.RECORDS
    )


@pytest.mark.parametrize("fanout", [2, 16])
def test_damage_is_found_where_it_is(spark, fanout):
    rng = random.Random(2)
    left = [(f"f{f}", k, rng.randbytes(8)) for f, n in enumerate([1, 5, 40, 70]) for k in range(n)]
    right = [r for r in left if not (r[0] == "f2" and r[1] >= 37)] + [("f3", 70, b"new"), ("f9", 0, b"only here")]
    right = [(f, k, b"broken") if (f, k) in {("f3", 0), ("f3", 33), ("f1", 4)} else (f, k, d) for f, k, d in right]
    a, b = (merkle.build_tree(records(spark, x), fanout) for x in (left, right))
    found = {(r.file, r.record_no): r.status for r in merkle.find_damage(a, b, fanout).collect()}
    assert found == {
        ("f3", 0): "changed", ("f3", 33): "changed", ("f1", 4): "changed", ("f3", 70): "extra", ("f9", 0): "extra",
        **{("f2", k): "missing" for k in (37, 38, 39)},
    }
    assert merkle.find_damage(a, a, fanout).count() == 0


def sized(spark, files):
    """Records of files given as lists of bytes, at their real offsets."""
    rows = []
    for f, parts in files.items():
        at = 0
        for k, d in enumerate(parts):
            rows.append((f, k, at, len(d), hashlib.sha256(d).hexdigest()))
            at += len(d)
    return spark.createDataFrame(rows, merkle.RECORDS)


def plain_damage(left, right):
    """The same report from lists in memory, file by file."""
    out = set()
    for f in left.keys() | right.keys():
        a, b = left.get(f, []), right.get(f, [])
        at = [[sum(map(len, x[:k])) for k in range(len(x) + 1)] for x in (a, b)]
        fixed = {k for k in range(min(len(a), len(b))) if a[k] == b[k]}
        spare = {}
        for k in range(len(b)):
            if k not in fixed:
                spare.setdefault(b[k], []).append(k)
        to = {k: k for k in fixed}
        for k in range(len(a)):
            if k not in fixed and spare.get(a[k]):
                to[k] = spare[a[k]].pop(0)
        k = 0
        while k < len(a):  # runs of sound records with another number
            if k in to and to[k] != k:
                n = 1
                while k + n in to and to[k + n] - k - n == to[k] - k:
                    n += 1
                out.add((f, k, "shifted", at[0][k], at[0][k + n], at[1][to[k]] - at[0][k]))
                k += n
            else:
                k += 1
        back = {v: k for k, v in to.items()}
        gaps = {}
        for number, (x, known) in enumerate(((a, to), (b, back))):
            for k in range(len(x)):
                if k not in known:
                    s = k
                    while s and s - 1 not in known:
                        s -= 1
                    gap = s - 1 if number == 0 or s == 0 else back[s - 1]
                    gaps.setdefault((gap, k - s), [None, None])[number] = k
        for i, j in gaps.values():
            n = [0 if k is None else len(x[k]) for k, x in ((i, a), (j, b))]
            number, offsets = (j, at[1]) if i is None else (i, at[0])
            out.add((f, number, "extra" if i is None else "missing" if j is None else "changed", offsets[number], offsets[number + 1], n[1] - n[0]))
    return out


def damage(spark, left, right, fanout):
    a, b = (merkle.build_tree(sized(spark, x), fanout) for x in (left, right))
    return sorted(tuple(r) for r in merkle.find_damage(a, b, fanout).collect())


@pytest.mark.parametrize("fanout", [3, 16])
def test_damage_that_changes_lengths_or_numbers_is_placed(spark, fanout):
    rng = random.Random(7)
    base = [rng.randbytes(10) for _ in range(40)]
    edits = {
        "grown": base[:5] + [base[5] + b"x"] + base[6:],
        "inserted": base[:5] + [b"new"] + base[5:],
        "lost": base[:5] + base[6:],
        "front": [b"a", b"bc"] + base,
        "swapped": [*base[:3], base[9], *base[4:9], base[3], *base[10:]],
    }
    found = damage(spark, {f: base for f in edits}, edits, fanout)
    assert [r[1:] for r in found if r[0] == "grown"] == [(5, "changed", 50, 60, 1)]
    assert [r[1:] for r in found if r[0] == "inserted"] == [(5, "extra", 50, 53, 3), (5, "shifted", 50, 400, 3)]
    assert [r[1:] for r in found if r[0] == "lost"] == [(5, "missing", 50, 60, -10), (6, "shifted", 60, 400, -10)]
    assert [r[1:] for r in found if r[0] == "front"] == [(0, "extra", 0, 1, 1), (0, "shifted", 0, 400, 3), (1, "extra", 1, 3, 2)]
    assert [r[1:] for r in found if r[0] == "swapped"] == [(3, "shifted", 30, 40, 60), (9, "shifted", 90, 100, -60)]
    left, right = {}, {}
    for f in range(12):  # edits of all kinds at once, records that repeat among them
        left[f"r{f}"] = [rng.choice(base[:3]) if rng.random() < 0.1 else rng.randbytes(rng.randint(0, 12)) for _ in range(rng.randint(0, 60))]
        copy = []
        for d in left[f"r{f}"]:
            what = rng.random()
            copy += [] if what < 0.04 else [d + b"!"] if what < 0.1 else [d, b"%d" % len(copy)] if what < 0.14 else [d]
        right[f"r{f}"] = copy
    assert damage(spark, left, right, fanout) == sorted(plain_damage(left, right))


def test_files_hold_the_records_of_the_pages(spark, tmp_path):
    rows = [(i, f"http://h/{i}", "<p>é%d</p>" % i * (i % 5)) for i in range(30)] + [(7, None, None), (None, "u", "x")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    made = merkle.page_records(pages).filter("page_id is not null").orderBy("file", "record_no").collect()
    bodies = pages.filter("page_id is not null").select(
        "page_id", merkle.page_record(pages.page_id, pages.url, pages.html).alias("r")).collect()
    by_digest = {hashlib.sha256(r.r.encode()).hexdigest(): r.r.encode() for r in bodies}
    data = b"".join(by_digest[r.digest] for r in made)
    (tmp_path / "a.warc").write_bytes(data)
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(data))
    for name in ("a.warc", "b.warc.gz"):
        got = merkle.read_warc(spark, [str(tmp_path / name)]).orderBy("record_no").collect()
        assert [(r.offset, r.length, r.digest) for r in got] == [(r.offset, r.length, r.digest) for r in made]
    assert merkle.page_records(pages).count() == len(rows)
    assert merkle.find_damage(*[merkle.build_tree(merkle.page_records(pages.limit(0)))] * 2).count() == 0
