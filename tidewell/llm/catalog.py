"""The registered query of each training-data operator; every one runs over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidewell.llm import (
    alignment, exact_dedup, html_paths, language, lattice, licenses, max_entropy, merkle, multi_index, packing, signature_tree, token_files,
    tokens, wu_manber,
)
from tidewell.llm.common import id_remainder, shared_folder, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


@query
def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = html_paths.extract_pages(table(spark, sf_dir, "pages"))
    return texts.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


@query
def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, benchmark = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    found = wu_manber.find_contamination(docs, benchmark, carry={"doc_id": F.col("doc_id")})
    return wu_manber.verdicts(found).select(
        "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"
    )


@query
def op3_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Damage in a second replica of the pages: another first character in one page of 23, one more byte in one of 29, lost file ends."""
    pages = table(spark, sf_dir, "pages")
    records = merkle.page_records(pages)
    hit = (F.col("page_id") % 23 == 7) & (F.length("html") > 0)
    broken = pages.withColumn(
        "html", F.when(hit, F.concat(F.lit("~"), F.substring("html", 2, 2_000_000_000))).otherwise(F.col("html"))
    ).withColumn(
        "html", F.when(F.col("page_id") % 29 == 3, F.concat(F.coalesce("html", F.lit("")), F.lit("~"))).otherwise(F.col("html"))
    )
    copy = merkle.page_records(broken).filter((F.floor(F.col("page_id") / merkle.FILE_PAGES) % 3 != 1) | (F.col("page_id") % merkle.FILE_PAGES < 990))
    return merkle.find_damage(merkle.build_tree(records), merkle.build_tree(copy))


@query
def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return licenses.licences_of(docs, licenses.train(docs))


@query
def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.find_copies(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"))


@query
def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    text, remainder = F.coalesce(F.col("text"), F.lit("")), id_remainder(F.col("doc_id"), 7)
    model, counts = max_entropy.fit(docs, text, remainder, held_out=2)
    carry = {"doc_id": F.col("doc_id"), "held_out": remainder == 2}
    scored = max_entropy.score(docs, text, model, counts, carry, known=remainder != 2)
    return scored.withColumn("train_tokens", F.lit(model.total).cast("long"))


@query
def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokens.vocabulary_path("byte_bpe_50k.json")
    folder = shared_folder(spark, "token-store")
    return token_files.read_store(spark, token_files.write_store(table(spark, sf_dir, "documents"), folder, path))


@query
def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokens.vocabulary_path("word_bpe_49k.json"))


@query
def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    remainder = id_remainder(F.col("doc_id"), 3)
    profiles = language.collect_profiles(language.learn_profiles(docs.filter(remainder != 1)))
    return language.identify(docs, profiles, carry={"doc_id": F.col("doc_id"), "held_out": remainder == 1})


@query
def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signature_tree.join_near(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


@query
def op11_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.find_near_vectors(table(spark, sf_dir, "embeddings"))


@query
def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = (tokens.vocabulary_path(name) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
    return alignment.align_corpus(table(spark, sf_dir, "documents"), *paths)


@query
def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of ids divisible by 7 are moved on by one first, so that some rows near an anchor have another label."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return multi_index.mine(table(spark, sf_dir, "embeddings").withColumn("label", moved))
