"""The stages of the corpus pipeline: each takes (spark, docs, sf_dir) and returns what it keeps.

All but the last return the columns of ``docs`` unchanged. The near-duplicate stage names a row by its id and a hash of
its text, so that rows which share an id but not their text are judged apart; ids that are missing come last among
linked rows, rows equal in id and text stay or go together. It takes the four words and 0.85 of the operator's query.
Every other case is defined by the operator a stage calls: ties, repeated rows, empty tables, very long texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidewell.llm import exact_dedup, language, packing, signature_tree, tokens, wu_manber
from tidewell.llm.common import id_remainder, staged, table


def _numbered(docs: DataFrame) -> dict[str, Column]:
    """All columns under names of their own, so that they clash with nothing an operator adds."""
    return {f"d{i}": F.col(f"`{c}`") for i, c in enumerate(docs.columns)}


def _text_of(docs: DataFrame) -> str:
    return f"d{docs.columns.index('text')}"


def _restored(rows: DataFrame, docs: DataFrame) -> DataFrame:
    return rows.select(*(F.col(f"d{i}").alias(c) for i, c in enumerate(docs.columns)))


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents whose language cannot be told: no letters, or no n-gram known to any profile."""
    profiles = language.collect_profiles(language.learn_profiles(docs.filter(id_remainder(F.col("doc_id"), 3) != 1)))
    found = language.identify(docs, profiles, _text_of(docs), _numbered(docs))
    return _restored(found.filter((F.col("lang_pred") != language.UNDETERMINED) & (F.col("score") > 0)), docs)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, keep the row with the largest id."""
    return exact_dedup.drop_copies(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that are connected by links, keep the one with the smallest id."""
    key = F.xxhash64(F.col("doc_id"), F.col("text"))
    rows = docs.select(key.alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    joined = signature_tree.join_near(rows, "row", "text").withColumnRenamed("doc_id", "row")
    others = joined.filter(F.col("row") != F.col("component_id")).select("row", "component_id")
    heads = others.select(F.col("component_id").alias("row"), "component_id")
    linked = staged(others.unionByName(heads).distinct().join(rows.select("row", "doc_id").distinct(), "row"), "near-rows")
    first = linked.groupBy("component_id").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row")).alias("first")
    ).select("first.row", F.col("first.doc_id").alias("id"))
    dropped = linked.join(
        first, (linked["row"] == first["row"]) & linked["doc_id"].eqNullSafe(first["id"]), "left_anti"
    ).select(F.col("row").alias("__row"), F.col("doc_id").alias("__id"))
    return docs.join(
        dropped, (key == F.col("__row")) & F.col("doc_id").cast("long").eqNullSafe(F.col("__id")), "left_anti"
    ).select(*docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents with benchmark passages in one word of twenty or more."""
    benchmark = table(spark, sf_dir, "benchmark")
    found = wu_manber.find_contamination(docs, benchmark, _text_of(docs), _numbered(docs))
    return _restored(wu_manber.verdicts(found).filter(~F.col("contaminated")), docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces with their place in the training sequences."""
    return packing.pack_documents(docs, tokens.vocabulary_path("word_bpe_49k.json"))
