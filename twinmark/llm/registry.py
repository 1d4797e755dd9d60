"""Queries of the training-data operators over the given tables, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import embedding_dedup, importance, language, licenses, near_dedup, packing, quality_rules, token_scan, tokens, toxicity
from .common import table


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def op1_separator_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return token_scan.count_document_tokens(docs, tokenizer_file("byte_bpe_50k.tiktoken"), pattern(), end_id=50256)


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"), pattern())


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return tokens.encode_documents(docs, tokenizer_file("byte_bpe_50k.tiktoken"), pattern(), keep_ids=False)


def op2_setsketch_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.link_documents(table(spark, sf_dir, "documents"), words=4)


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality_rules.apply_policy(quality_rules.ledger(table(spark, sf_dir, "documents")))
    older = [(~quality_rules.rejects(quality_rules.POLICIES[version])).alias(name) for version, name in (("v1-base", "kept_v1"), ("v3-lenient", "kept_v3"))]
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "fail_bits", *older)


def op6_byte_cnn_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


def op7_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.select(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_pruned_graph_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.link_vectors(table(spark, sf_dir, "embeddings"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_separator_token_counts, op2_setsketch_near_dedup, op3_best_fit_packing, op4_byte_bpe, op5_quality_rules, op6_byte_cnn_language, op7_importance_resampling, op8_pruned_graph_dedup, op9_license_scan, op10_toxicity)}


def oracle_sql() -> dict[str, str]:
    return {
        "op2_setsketch_near_dedup": near_dedup.ORACLE_SQL,
        "op5_quality_rules": quality_rules.ORACLE_SQL,
        "op8_pruned_graph_dedup": embedding_dedup.ORACLE_SQL,
        "op9_license_scan": licenses.oracle(),
    }
