"""Attributes of an item, read from its normalised texts, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import vocab
from .text import clean, col, domain_text, lookup, similarity_text, strip, tokens


def words_of(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def sorted_set(x: Column) -> Column:
    return F.array_sort(F.array_distinct(x))


def not_null(items: list[Column], kind: str = "string") -> Column:
    return F.filter(F.array(*items), lambda v: v.isNotNull()) if items else F.array().cast(f"array<{kind}>")


def terms(words: Column, text: Column, vocabulary) -> Column:
    """Sorted terms of a vocabulary: single words by token, phrases by word boundaries."""
    phrases = [F.when(text.rlike(rf"\b{v}\b"), F.lit(v)) for v in vocabulary if " " in v]
    single = F.array_intersect(words_of([v for v in vocabulary if " " not in v]), words)
    return sorted_set(F.concat(single, not_null(phrases)) if phrases else single)


def all_matches(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def technical_tokens(normalized) -> Column:
    """Struct of numbers, measurements, dimensions, modifiers, units of a normalised text."""
    text = col(normalized)
    words = tokens(text)
    measured = F.filter(words, lambda w: w.rlike(r"^\d+(mm|cm|kg|g|l|ml|v|ph|a|amp)$"))
    number = lambda w: F.regexp_extract(w, r"^(\d+)", 1)
    unit = lambda w: F.regexp_extract(w, r"^\d+([a-z]+)$", 1)
    plain = F.filter(words, lambda w: w.rlike(r"^\d+$"))
    suffixes = F.transform(F.filter(words, lambda w: w.rlike(r"^\d+[a-z]+$")), unit)
    return F.struct(
        sorted_set(F.concat(F.transform(measured, number), plain)).alias("numbers"),
        sorted_set(F.transform(measured, lambda w: F.concat(number(w), F.when(unit(w).isin("a", "amp"), F.lit("amp")).otherwise(unit(w))))).alias("measurements"),
        all_matches(text, r"\b\d+\s*x\s*\d+(?:\s*x\s*\d+)?\b").alias("dimensions"),
        F.array_sort(F.array_intersect(words_of(vocab.MODIFIERS), words)).alias("modifiers"),
        sorted_set(F.concat(suffixes, F.array_intersect(words_of(vocab.UNITS), words))).alias("units"),
    )


def sizes(text: Column) -> Column:
    rest = F.regexp_replace(F.regexp_replace(text, r"\bextra small\b", " "), r"\bextra large\b", " ")
    found = [F.when(text.rlike(rf"\b{p}\b"), F.lit(p)) for p in ("extra small", "extra large")]
    return sorted_set(not_null(found + [F.when(rest.rlike(rf"\b{w}\b"), F.lit(v)) for w, v in vocab.VARIANT_SIZES.items()]))


def electrical(raw: Column, text: Column) -> Column:
    def values(source: Column, word: str, unit: str) -> Column:
        return F.transform(all_matches(source, rf"\b(\d+(?:\.\d+)?)\s*{word}\b", 1), lambda m: F.concat(m, F.lit(unit)))

    both = [values(source, unit.lower(), unit) for source in (raw, text) for unit in "AV"]
    return sorted_set(F.concat(*both, values(text, "amp", "A"), values(text, "volt", "V")))


def variants(raw, normalized) -> Column:
    """Struct of the variant groups, from a lowered text and its normalised form."""
    raw, text = F.lower(F.coalesce(col(raw), F.lit(""))), col(normalized)
    words = tokens(text)
    some = lambda values: F.array_sort(F.array_intersect(words_of(values), words))
    lengths = F.concat(*[F.transform(all_matches(s, r"\b(\d+(?:\.\d+)?)\s*mm\b", 1), lambda m: F.concat(m, F.lit("MM"))) for s in (raw, text)])
    return F.struct(
        some(vocab.VARIANT_FUNCTIONS).alias("FILTER_FUNCTION"),
        some(vocab.VARIANT_COLORS).alias("COLOR"),
        sizes(text).alias("SIZE"),
        sorted_set(all_matches(text, r"\b(?:type|grade)\s+[a-z0-9]+\b")).alias("TYPE_OR_GRADE"),
        electrical(raw, text).alias("ELECTRICAL_RATING"),
        sorted_set(lengths).alias("DIMENSION"),
        some(vocab.SENSOR_TYPES).alias("SENSOR_TYPE"),
        some(vocab.SIDES).alias("SIDE"),
    )


def application_context(part_no, description) -> Column:
    """Contexts that raw words name, in order of their first mention."""
    joined = F.concat_ws(" ", F.lower(F.coalesce(col(part_no), F.lit(""))), F.lower(F.coalesce(col(description), F.lit(""))))
    known = lookup(vocab.CONTEXT_WORDS)
    found = F.transform(F.split(F.regexp_replace(joined, "[^a-z0-9]+", " "), " "), lambda t: known[t])
    return F.array_distinct(F.filter(found, lambda t: t.isNotNull()))


def is_generic(normalized_description) -> Column:
    """One or two words, all of them generic."""
    words = tokens(normalized_description)
    return F.size(words).between(1, 2) & F.forall(words, lambda w: w.isin(*vocab.GENERIC_TERMS))


def item_family(normalized) -> Column:
    words = tokens(normalized)
    has = lambda w: F.array_contains(words, w)
    return (
        F.when(has("filter"), "filters")
        .when(has("paint"), "paint items")
        .when(has("coconut"), "coconut items")
        .when(has("sensor"), "sensors")
        .when(has("mcb") | (has("miniature") & has("circuit") & has("breaker")), "MCB items")
        .when(has("pipe"), "pipe items")
        .otherwise("items")
    )


def with_field(df: DataFrame, name: str) -> Column:
    return F.col(name).cast("string") if name in df.columns else F.lit(None).cast("string")


def enrich(records: DataFrame) -> DataFrame:
    """Adds to each record what pairs need: normalised texts, attributes, technical tokens, variants, flags.

    Done once a record, before any pair exists.  Columns that are absent count as null.
    """
    master = with_field(records, "MASTER_PART_DESCRIPTION")
    step = records.select(
        "*",
        domain_text("PART_NO").alias("normalized_part_no"),
        domain_text("DESCRIPTION").alias("description_norm"),
        domain_text(master).alias("master_norm"),
    )
    step = step.withColumn("normalized_description", F.array_join(F.filter(F.array("description_norm", "master_norm"), lambda x: x != ""), " "))
    step = step.withColumn("normalized_text", F.array_join(F.filter(F.array("normalized_part_no", "normalized_description"), lambda x: x != ""), " "))
    step = step.withColumn("words", tokens("normalized_text")).withColumn("again", domain_text("normalized_text"))
    text, words = F.col("normalized_text"), F.col("words")
    generic = terms(words, text, vocab.GENERIC_TERMS)
    rating = F.filter(words, lambda t: t.rlike(r"^\d+(a|v|mm|kg|g)$"))
    volume = F.filter(words, lambda t: t.rlike(r"^\d+(l|ml)$"))
    attrs = F.struct(
        terms(words, text, vocab.PRODUCT_CLASSES).alias("product_class"),
        F.array_sort(F.array_union(application_context("PART_NO", "DESCRIPTION"), terms(words, text, vocab.CONTEXTS))).alias("application_context"),
        terms(words, text, vocab.FUNCTIONS_OR_MEDIA).alias("function_or_media"),
        terms(words, text, vocab.COLORS).alias("color"),
        sorted_set(rating).alias("rating"),
        terms(words, text, vocab.SIZES).alias("size"),
        sorted_set(volume).alias("volume"),
        sorted_set(all_matches(text, r"\btype\s+[a-z0-9]+\b")).alias("type_code"),
        terms(words, text, vocab.MATERIALS).alias("material"),
        terms(words, text, vocab.PACKAGING).alias("packaging"),
        F.array_sort(F.when(F.array_contains(generic, "labels"), F.array_union(generic, words_of(["label"]))).otherwise(generic)).alias("generic_terms"),
    )
    return step.select(
        "*",
        attrs.alias("attrs"),
        technical_tokens("again").alias("technical"),
        variants("normalized_text", "again").alias("variants"),
        application_context("PART_NO", "DESCRIPTION").alias("raw_context"),
        is_generic("description_norm").alias("is_generic"),
        item_family("description_norm").alias("family"),
        similarity_text("description_norm").alias("text_description"),
        similarity_text(domain_text("normalized_description")).alias("text_full"),
        similarity_text("master_norm").alias("text_master"),
    ).drop("again", "words")


def present(x) -> Column:
    return clean(x) != ""


__all__ = ["enrich", "present", "strip"]
