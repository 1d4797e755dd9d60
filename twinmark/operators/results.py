"""From decided pairs to stored candidates: projection, filters, counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vocab
from ..functions.text import strip


def shown_attributes(side: str) -> Column:
    return F.struct(*[F.col(f"{side}.attrs.{n}").alias(n) for n in vocab.SHOWN_ATTRIBUTES])


def warned() -> dict[str, Column]:
    """Whether the warnings say that a description is generic or that contexts differ."""
    contains = lambda word: F.exists("warnings", lambda w: F.lower(w).contains(word))
    return {"generic_description_warning": contains("generic") | contains("sparse"), "application_context_warning": contains("application context")}


def decision_columns() -> list:
    """What a stored candidate says of a decision, without its records."""
    return [
        F.col("final_score").alias("similarity_score"),
        F.col("final_score").alias("confidence_score"),
        "confidence_level",
        "description_similarity",
        "tfidf_score",
        "fuzzy_score",
        "part_no_similarity",
        "technical_token_score",
        F.col("status").alias("business_status"),
        "rule_decision",
        "rejection_reason",
        "scan_mode",
        "explanation",
        "recommended_action",
        "matched_fields",
        "mismatched_fields",
        "matched_evidence",
        "differences",
        "warnings",
        F.filter("differences", lambda d: d["type"].isNotNull()).alias("critical_mismatches"),
        *[c.alias(n) for n, c in warned().items()],
    ]


def decisions(decided: DataFrame, keys) -> DataFrame:
    """The columns ``keys`` and what a stored candidate says of a decision."""
    return decided.select(*keys, *decision_columns())


def candidates(decided: DataFrame) -> DataFrame:
    """The stored shape of a candidate: both records, scores, status, evidence, normalised texts, attributes."""
    names = set(decided.select("a.*").columns)
    record = lambda s, f: strip(f"{s}.{f}") if f in names else F.lit("")
    both = [record(s, f).alias(f"{f.lower()}_{s}") for s in "ab" for f in ("CONTRACT", "PART_NO", "DESCRIPTION")]
    return decided.select(
        "idx_a",
        "idx_b",
        *both,
        *decision_columns(),
        *[F.col(f"{s}.attrs.application_context").alias(f"application_context_{s}") for s in "ab"],
        *[F.col(f"{s}.{n}").alias(f"{n}_{s}") for n in ("normalized_part_no", "normalized_description") for s in "ab"],
        *[shown_attributes(s).alias(f"extracted_attributes_{s}") for s in "ab"],
        *[F.col(f"{s}.variants").alias(f"variant_attributes_{s}") for s in "ab"],
        F.lit("UNREVIEWED").alias("review_status"),
    )


def allowed_statuses(mode: str | None = "review", statuses: str | None = None) -> list[str]:
    """Statuses to keep: an explicit comma list of known ones, else those of the mode (all or review)."""
    listed = [s for s in (x.strip().upper() for x in (statuses or "").split(",")) if s in vocab.STATUSES]
    if listed:
        return listed
    return list(vocab.STATUSES if (mode or "").strip().lower() == "all" else vocab.REVIEW_STATUSES)


def kept(found: DataFrame, threshold: float = 75.0, statuses=None) -> DataFrame:
    """Candidates at or above the threshold, on the rounded score, with one of the statuses."""
    if not 0 <= threshold <= 100:
        raise ValueError("threshold must lie between 0 and 100")
    found = found.where(F.col("similarity_score") >= threshold)
    return found if statuses is None else found.where(F.col("business_status").isin(*statuses))


def status_counts(found: DataFrame, status: str = "business_status", weight: str | None = None) -> DataFrame:
    """(status, n) with a row TOTAL, in one pass; a row stands for as many candidates as the column ``weight`` says."""
    n = F.count(F.lit(1)) if weight is None else F.coalesce(F.sum(weight), F.lit(0))
    counts = found.rollup(status).agg(n.alias("n"))
    return counts.select(F.coalesce(F.col(status), F.lit("TOTAL")).alias("status"), "n")


def produced_and_kept(found: DataFrame, threshold: float = 75.0, statuses=None, weight: str | None = None) -> DataFrame:
    """(status, produced, kept): how many candidates each status has, and how many of them a scan stores.

    A row stands for as many candidates as the column ``weight`` says.
    """
    one = F.lit(1) if weight is None else F.col(weight)
    stored = F.col("similarity_score") >= threshold
    if statuses is not None:
        stored = stored & F.col("business_status").isin(*statuses)
    return found.groupBy(F.col("business_status").alias("status")).agg(F.sum(one).alias("produced"), F.sum(F.when(stored, one).otherwise(0)).alias("kept"))
