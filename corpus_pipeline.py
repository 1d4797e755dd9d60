"""A corpus from raw documents: quality rules, quality selection, near duplicates out, packed sequences.

Each stage is a function of (spark, docs, sf_dir); its rows are written and read again as the next one's
documents.  All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from twinmark.llm import importance, near_dedup, packing, quality_rules, registry
from twinmark.llm.common import store, table


def quality_rule_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the current policy of the rule ledger keeps."""
    return quality_rules.keep_documents(docs)


def quality_selection_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn by importance; the models come from the raw documents and their labels."""
    return importance.keep_documents(docs, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return near_dedup.drop_near_duplicates(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of tokens: one row per piece with its place."""
    return packing.pack_documents(docs, registry.tokenizer_file("byte_bpe_50k.json"), registry.pattern())


STAGES = [
    ("quality_rules", quality_rule_stage),
    ("quality_classifier", quality_selection_stage),
    ("near_dedup", near_dedup_stage),
    ("packing", packing_stage),
]

#: Tokenizing and sampling are beyond SQL; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = store(docs, name)
    return docs
