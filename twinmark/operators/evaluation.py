"""Precision, recall and F1 of the classic score on labelled description pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.attributes import enrich
from . import classic


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """(pair_id, description_a, description_b, expected_label) of CSV files of labelled pairs."""
    rows = spark.read.option("header", True).option("escape", '"').csv(path)
    return rows.select(F.col("pair_id").cast("long"), "description_a", "description_b", F.col("expected_label").cast("int"))


def score_pairs(pairs: DataFrame, cut: float = 60.0) -> DataFrame:
    """(pair_id, description_a, description_b, expected_label, score, guess) of labelled pairs."""
    fixed = pairs.select("pair_id", "description_a", "description_b", "expected_label")
    side = lambda k, s: fixed.select((F.col("pair_id") * 2 + k).alias("rec_idx"), F.col(f"description_{s}").alias("DESCRIPTION"), F.lit(s.upper()).alias("PART_NO"))
    records = enrich(side(0, "a").unionByName(side(1, "b")))
    decided = classic.decide(fixed.select((F.col("pair_id") * 2).alias("idx_a"), (F.col("pair_id") * 2 + 1).alias("idx_b")), records)
    scored = decided.select((F.col("idx_a") / 2).cast("long").alias("pair_id"), F.col("final_score").alias("score"))
    return fixed.join(scored, "pair_id").withColumn("guess", (F.col("score") >= cut).cast("int"))


def metrics(scored: DataFrame) -> DataFrame:
    """One row: precision, recall, f1_score (3 decimals, 0 where undefined) and the counts behind them."""
    count = lambda guess, label: F.coalesce(F.sum(((F.col("guess") == guess) & (F.col("expected_label") == label)).cast("long")), F.lit(0))
    counts = scored.agg(count(1, 1).alias("tp"), count(1, 0).alias("fp"), count(0, 1).alias("fn"), count(0, 0).alias("tn"))
    share = lambda a, b: F.when(b > 0, F.floor(a / b * 1000 + 0.5) / 1000).otherwise(0.0)
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return counts.select("tp", "fp", "fn", "tn", share(tp, tp + fp).alias("precision"), share(tp, tp + fn).alias("recall"), share(2 * tp, 2 * tp + fp + fn).alias("f1_score"))


def errors(scored: DataFrame) -> DataFrame:
    """The pairs that were judged wrongly, with the kind of error."""
    kind = F.when(F.col("guess") == 1, "FALSE_POSITIVE").otherwise("FALSE_NEGATIVE")
    return scored.where(F.col("guess") != F.col("expected_label")).withColumn("error", kind)
