"""Documents to packed training sequences, one written table after the other."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidewell.llm import stages
from tidewell.llm.common import staged, table

#: Each function takes (spark, docs, sf_dir); all but the last return the columns of ``documents``.
STAGES = [
    ("language", stages.language_stage),
    ("exact_dedup", stages.dedup_stage),
    ("near_dedup", stages.near_dedup_stage),
    ("decontamination", stages.decontamination_stage),
    ("packing", stages.packing_stage),
]

#: SQL cannot express the tokenizer and the learned profiles; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = staged(docs, name)
    return docs
