"""The pipeline's stages, one after the other, against plain Python."""

from __future__ import annotations

from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidewell.llm import stages, wu_manber

SF = "/root/testdata/sf0.001"


def test_stages_run_in_the_agreed_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "exact_dedup", "near_dedup", "decontamination", "packing"]


def test_each_stage_keeps_what_it_should(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("text", F.when(F.col("doc_id") % 50 == 3, "12 !").otherwise(F.col("text")))
    docs = docs.cache()
    kept = stages.language_stage(spark, docs, SF)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in docs.collect() if r.text != "12 !"}
    rows = docs.collect()
    last = {}
    for r in rows:
        last[r.text.lower()] = max(r.doc_id, last.get(r.text.lower(), -1))
    deduped = stages.dedup_stage(spark, docs, SF)
    assert {r.doc_id for r in deduped.collect()} == set(last.values()) and deduped.columns == docs.columns

    def shingles(text):
        w = text.lower().split()
        return frozenset(tuple(w[k : k + 4]) for k in range(max(1, len(w) - 3))) if w else frozenset()

    sets = {r.doc_id: shingles(r.text) for r in rows}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                parent[max(root(a), root(b))] = min(root(a), root(b))
    near = stages.near_dedup_stage(spark, docs, SF)
    assert {r.doc_id for r in near.collect()} == {i for i in ids if root(i) == i}
    assert near.columns == docs.columns
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    found = wu_manber.find_contamination(docs, bench, carry={"doc_id": F.col("doc_id")})
    bad = {r.doc_id for r in wu_manber.verdicts(found).collect() if r.contaminated}
    clean = stages.decontamination_stage(spark, docs, SF)
    assert {r.doc_id for r in clean.collect()} == set(ids) - bad and clean.columns == docs.columns


def test_rows_that_share_an_id_are_judged_apart(spark):
    base = " ".join(f"word{k}" for k in range(60))
    rows = [(1, base), (2, base + " more"), (2, "a clean text under the id of a copy " + " ".join("xyzuvw")),
            (3, base.replace("word0 ", "")), (None, base + " end"), (4, ""), (4, None), (5, "short text"), (5, "short  text"),
            (7, " ".join(f"long{k % 9973}x{k % 7}" for k in range(200_000))), (6, " ".join(f"long{k % 9973}x{k % 7}" for k in range(199_990)))]
    docs = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "doc_id bigint, text string, row int")
    kept = sorted(r["row"] for r in stages.near_dedup_stage(spark, docs, SF).collect())
    assert kept[:4] == [0, 2, 5, 6] and len(kept) == 6 and len({7, 8} & set(kept)) == 1 and kept[-1] == 10


def test_pipeline_packs_every_kept_document_whole(spark):
    packed = corpus_pipeline.run(spark, SF).collect()
    pieces = Counter(r.doc_id for r in packed)
    assert 0 < len(pieces) < 200
    assert all({r.piece for r in packed if r.doc_id == i} == set(range(n)) for i, n in pieces.items())
    held = Counter()
    for r in packed:
        held[r.sequence_id] += r.length
    assert max(held.values()) <= 2048


@pytest.mark.parametrize("stage", [s for _, s in corpus_pipeline.STAGES[:-1]])
def test_empty_tables_and_extra_columns_pass(spark, stage):
    rows = [(1, "some words of a text", "en", "s", 5, 1, b"x"), (None, None, None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, score int, sha binary")
    out = stage(spark, docs, SF)
    assert out.columns == docs.columns and 1 in {r.doc_id for r in out.collect()}
    assert stage(spark, docs.limit(0), SF).count() == 0
