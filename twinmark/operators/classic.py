"""The classic engine: guards stop a pair before it is scored, soft guards cap the score afterwards."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vocab
from ..functions.text import clean
from . import similarity
from .blocking import Alike, dealt, field_matches, join_records
from .decisions import DIFFERENCE, chosen, confidence_level, difference, differs, score_status, side_value
from .reuse import reused
from .similarity import same_set

GUARD = f"struct<status:string,rule_decision:string,rejection_reason:string,score:double,explanation:string,differences:array<{DIFFERENCE}>>"


def variant_mismatches() -> Column:
    """Variant groups, in order of precedence, that both sides have with different values."""
    items = []
    for group, label in vocab.VARIANT_LABELS.items():
        a, b = F.col(f"a.variants.{group}"), F.col(f"b.variants.{group}")
        items.append(F.when((F.size(a) > 0) & (F.size(b) > 0) & ~same_set(a, b), difference(kind=group, label=label, a=a, b=b)))
    return chosen(items, DIFFERENCE)


def guard_conditions(value: Callable[[str, str], Column], mode: str, unequal: Column) -> list[tuple[Column, str, float]]:
    """Condition, status and score of each hard guard, the first that holds first.

    ``value`` gives the cleaned value of a field of one side; ``unequal`` says whether variants differ.
    """
    site = (vocab.UNIQUE, 55.0) if mode == vocab.SCAN_MODES[0] else (vocab.CROSS_SITE, 78.0)
    return [
        ((value("a", "PART_NO") != "") & (F.lower(value("a", "PART_NO")) == F.lower(value("b", "PART_NO"))), vocab.UNIQUE, 0.0),
        *[(differs(value("a", field), value("b", field)), vocab.CONFLICT, score) for field, _, _, score in vocab.HARD_FIELDS],
        (differs(value("a", "CONTRACT"), value("b", "CONTRACT")), *site),
        (unequal, vocab.RELATED, 55.0),
    ]


def guard_score(pairs: DataFrame, mode: str) -> Column:
    """Status and score of the first guard that stops a pair of different part numbers, or null, from ``guard_values``."""
    columns = set(pairs.select("a.*").columns)
    value = lambda side, f: F.col(f"{side}.{f}") if f in columns else F.lit("")
    unequal = reduce(lambda x, y: x | y, [F.coalesce(F.col(f"a.{n}") != F.col(f"b.{n}"), F.lit(False)) for n in vocab.VARIANT_LABELS])
    return F.coalesce(*[F.when(c, F.struct(F.lit(status).alias("status"), F.lit(score).alias("score"))) for c, status, score in guard_conditions(value, mode, unequal)])


def guard_values(records: DataFrame) -> list[Column]:
    """All that ``guard_score`` looks at but part numbers, as short texts: each set of variants as one, null if it is empty."""
    fields = [f for f in ("CONTRACT", *dict.fromkeys(f for f, *_ in vocab.HARD_FIELDS)) if f in records.columns]
    text = lambda n: F.when(F.size(f"variants.{n}") > 0, F.array_join(F.array_sort(F.array_distinct(f"variants.{n}")), "\x1f"))
    return [*[F.lower(clean(f)).alias(f) for f in fields], *[text(n).alias(n) for n in vocab.VARIANT_LABELS]]


def hard_guard(pairs: DataFrame, mode: str) -> Column:
    """The first guard that stops a pair, or null."""
    columns = set(pairs.select("a.*").columns)
    value = lambda side, f: side_value(columns, side, f)
    conditions = iter(guard_conditions(value, mode, F.size("variant_mismatches") > 0))

    def guard(rule: str, reason, text: Column, told: Column) -> Column:
        """Null unless the next condition holds."""
        condition, status, score = next(conditions)
        said = F.struct(
            F.lit(status).alias("status"), F.lit(rule).alias("rule_decision"), (F.lit(reason) if isinstance(reason, str) else reason).alias("rejection_reason"), F.lit(score).alias("score"), text.alias("explanation"), told.alias("differences")
        )
        return F.when(condition, said.cast(GUARD))

    nothing = F.array().cast(f"array<{DIFFERENCE}>")
    rules = [guard("REJECT", "SAME_PART_NO", F.lit("Same PART_NO detected. This is the same part reference, not a duplicate candidate."), nothing)]
    for field, label, rule, _ in vocab.HARD_FIELDS:
        a, b = value("a", field), value("b", field)
        text = F.concat(F.lit(f"{label} differs ({field} differs: "), a, F.lit(" vs "), b, F.lit("), so this cannot be treated as a confirmed duplicate."))
        rules.append(guard(rule, f"{field}_MISMATCH", text, F.array(difference(kind=field, label=label, a=F.array(a), b=F.array(b)))))
    a, b = value("a", "CONTRACT"), value("b", "CONTRACT")
    site = F.array(difference(kind="CONTRACT", label="Site", a=F.array(a), b=F.array(b)))
    if mode == vocab.SCAN_MODES[0]:
        rules.append(guard("REJECT", "CONTRACT_MISMATCH_IN_SAME_SITE_MODE", F.lit("Different site detected in same-site duplicate mode. This is not a normal same-site duplicate."), site))
    else:
        rules.append(guard("CROSS_SITE", "CONTRACT_MISMATCH", F.lit("Same or similar item appears across different sites and should be reviewed for standardization."), site))
    found = F.col("variant_mismatches")
    first = F.element_at(found, 1)
    family = F.when(F.col("a.family") == F.col("b.family"), F.col("a.family")).otherwise("items")
    text = F.concat(F.lit("Both are "), family, F.lit(", but "), first["label"], F.lit(" differs: "), F.array_join(first["values_a"], ", "), F.lit(" vs "), F.array_join(first["values_b"], ", "), F.lit("."))
    rules.append(guard("DOWNGRADE", F.concat(first["type"], F.lit("_MISMATCH")), text, found))
    return F.coalesce(*rules)


def duplicate_text() -> Column:
    text, part, n = F.col("description_similarity"), F.col("part_no_similarity"), F.size("matched_fields")
    return (
        F.when((text >= 80) & (part >= 90), "Descriptions and part numbers match after business synonym normalization.")
        .when((text >= 85) & (n > 0), "Descriptions are highly similar and selected business fields match.")
        .when(n > 0, F.concat(F.lit("Descriptions show meaningful similarity and "), n.cast("string"), F.lit(" selected business field(s) match.")))
        .otherwise("Candidate is based mainly on description, part number, and technical token similarity.")
    )


def guarded(ready: DataFrame, keys, fields, mode: str, technical: Column) -> DataFrame:
    """What the rules need of both records a and b, beside the columns ``keys``, and the hard guard that stops a pair."""
    matched, mismatched = field_matches(fields)
    ready = ready.withColumn("matched_fields", matched).withColumn("mismatched_fields", mismatched).withColumn("variant_mismatches", variant_mismatches())
    left, right = F.col("a.raw_context"), F.col("b.raw_context")
    return ready.select(
        *keys,
        "matched_fields",
        "mismatched_fields",
        hard_guard(ready, mode).alias("guard"),
        technical.alias("technical_token_score"),
        (F.col("a.is_generic") != F.col("b.is_generic")).alias("generic"),
        F.when((F.size(left) > 0) & (F.size(right) > 0) & ~same_set(left, right), F.struct(F.array_sort(left).alias("a"), F.array_sort(right).alias("b"))).alias("context"),
    )


def stopped(ready: DataFrame) -> DataFrame:
    """Decisions of the guarded rows that a hard guard stops."""
    zero = F.lit(0.0)
    return (
        ready.where(F.col("guard").isNotNull())
        .withColumns({n: zero for n in ("tfidf_score", "fuzzy_score", "description_similarity", "part_no_similarity", "technical_token_score")})
        .withColumn("final_score", F.col("guard.score"))
        .withColumns({n: F.col(f"guard.{n}") for n in ("status", "rule_decision", "rejection_reason", "explanation", "differences")})
        .withColumn("warnings", F.array().cast("array<string>"))
    )


def softened(scored: DataFrame) -> DataFrame:
    """Decisions of the guarded rows that no hard guard stops, with their string scores."""
    scored = similarity.classic_scores(scored)
    generic, context = F.col("generic"), F.col("context").isNotNull()
    context_text = F.concat(F.lit("Application context appears different: "), F.array_join("context.a", ", "), F.lit(" vs "), F.array_join("context.b", ", "), F.lit("."))
    cap = F.least(F.when(generic, F.lit(65.0)).otherwise(F.lit(100.0)), F.when(context, F.lit(78.0)).otherwise(F.lit(100.0)))
    return (
        scored.withColumn("status", F.when(context, vocab.POSSIBLE).when(generic, vocab.INSUFFICIENT).otherwise(score_status(F.col("final_score"))))
        .withColumn("rule_decision", F.when(context | generic, "DOWNGRADE").otherwise("ALLOW"))
        .withColumn("rejection_reason", F.when(context, "APPLICATION_CONTEXT_MISMATCH").when(generic, "GENERIC_DESCRIPTION").otherwise(""))
        .withColumn("warnings", chosen([F.when(generic, F.lit("One description is too generic to confirm duplicate identity.")), F.when(context, context_text)], "string"))
        .withColumn("explanation", F.concat_ws(" ", duplicate_text(), "warnings"))
        .withColumn("final_score", F.least(F.col("final_score"), cap))
        .withColumn("differences", chosen([F.when(context, difference(kind="APPLICATION_CONTEXT", label="Application context", a=F.col("context.a"), b=F.col("context.b")))], DIFFERENCE))
    )


def finished(both: DataFrame, mode: str) -> DataFrame:
    """Adds to decisions what their scores and fields say."""
    both = both.drop("guard", "generic", "context")
    action = F.create_map(*[F.lit(v) for pair in vocab.LEVEL_ACTIONS.items() for v in pair])
    return (
        both.withColumn("confidence_level", confidence_level(F.col("final_score")))
        .withColumn("recommended_action", action[F.col("confidence_level")])
        .withColumn("scan_mode", F.lit(mode))
        .withColumn("matched_evidence", F.col("matched_fields"))
    )


def decide(pairs: DataFrame, enriched: DataFrame, fields=(), mode: str = vocab.SCAN_MODES[0]) -> DataFrame:
    """Decides pairs (idx_a, idx_b) of enriched records; the result carries both records as structs a and b.

    What the rules need is taken from the records first, so that only narrow rows go on: pairs that a hard guard stops
    never reach the string metrics, the others are scored, then softened.
    """
    ready = reused(guarded(join_records(pairs, enriched), pairs.columns, fields, mode, similarity.technical_score()), "guarded-pairs")
    scored = similarity.string_scores(ready.where(F.col("guard").isNull()), enriched, {"text_description": ""})
    return join_records(finished(stopped(ready).unionByName(softened(scored)), mode), enriched)


#: What ``decide_classes`` looks at, of the records of a class, beside the selected fields.
READS = ("CONTRACT", *dict.fromkeys(f for f, *_ in vocab.HARD_FIELDS), "variants", "family", "is_generic", "raw_context", "shared_technical", "text_description")


def decide_classes(pairs: DataFrame, found: Alike, enriched: DataFrame, fields, shown, mode: str = vocab.SCAN_MODES[0]) -> DataFrame:
    """What ``shown`` makes of the decisions of all pairs of records, for ordered pairs of classes with records a and b.

    Only part numbers set the pairs of two classes apart: what a hard guard stops is decided and shown before it is
    opened, the rest is opened with the scores of its part numbers.  ``shown`` must keep cls_a and cls_b where it gets them.
    """
    ready = reused(guarded(pairs, ("cls_a", "cls_b", "idx_a", "idx_b"), fields, mode, similarity.shared_technical_score()), "guarded-classes")
    sure = found.all_pairs(reused(shown(finished(stopped(ready), mode)), "stopped-classes"), ordered=True)
    texts = similarity.string_scores(ready.where(F.col("guard").isNull()), enriched, {"text_description": ""}, parts=False)
    scored = found.scored_pairs(dealt(reused(texts, "scored-classes")), enriched.select("rec_idx", similarity.bare_part_no()))
    return sure.unionByName(shown(finished(softened(scored), mode)))
