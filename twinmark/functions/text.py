"""Normalisation of part numbers and descriptions, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocab
from .vocab import ABBREVIATIONS


def col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip(x) -> Column:
    """Null as empty; white space off both ends."""
    return F.regexp_replace(F.coalesce(col(x).cast("string"), F.lit("")), r"^\s+|\s+$", "")


def clean(x) -> Column:
    """Stripped; null, blank and the words nan and none in any case give the empty text.

    No branch here is a constant: the optimizer would push lower() of the result to it and fold it.  The first lower() of a
    JVM fills tables of all characters, at 3 GB of garbage, and would do so in the driver.
    """
    return F.regexp_replace(strip(x), r"(?i)\A(?:nan|none)\z", "")


def round2(x) -> Column:
    """Two decimals, halves up, by the same floating-point steps everywhere."""
    return F.floor(col(x) * 100 + 0.5) / 100


def normalize(x) -> Column:
    """Lower case, letters and digits only, measured numbers apart from the letters before them, amperes glued."""
    value = F.regexp_replace(F.lower(clean(x)), r"\bm\s*[.]\s*c\s*[.]\s*b\b", "mcb")
    value = F.regexp_replace(value, r"[^a-z0-9]+", " ")
    value = F.regexp_replace(value, r"\b([a-z]+)(\d+(?:a|v|mm|cm|kg|g|l|ml|ph))\b", "$1 $2")
    value = F.regexp_replace(value, r"\b(\d+)\s+(a)\b", "$1a")
    return F.trim(F.regexp_replace(value, r"\s+", " "))


def tokens(x) -> Column:
    """Words of a normalised text."""
    return F.filter(F.split(col(x), " "), lambda t: t != "")


def lookup(mapping: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(v) for pair in mapping.items() for v in pair])


def expand(x) -> Column:
    """Replaces the abbreviations of a normalised text; a number behind ``coconut`` is its type."""
    known = lookup(ABBREVIATIONS)
    words = F.array_join(F.transform(tokens(x), lambda t: F.coalesce(known[t], t)), " ")
    return F.regexp_replace(words, r"\bcoconut (\d+)\b", "coconut type $1")


def domain_text(x) -> Column:
    """Normalised and expanded."""
    return expand(normalize(x))


def similarity_text(normalized) -> Column:
    """A normalised, expanded text with the breaker spelled out and amperes written in both ways."""
    words = F.transform(
        tokens(normalized),
        lambda t: F.when(t == "mcb", F.lit("mcb miniature circuit breaker")).when(t.rlike(r"^\d+a$"), F.concat(t, F.lit(" "), F.regexp_replace(t, "a$", ""), F.lit(" amp"))).otherwise(t),
    )
    return F.array_join(words, " ")


def expand_apart(x) -> Column:
    """Another normal form: words outside the abbreviations are parted where letters and digits meet, then all are expanded."""
    known = lookup({k: v for k, v in vocab.ABBREVIATIONS.items() if k not in vocab.LATER_ABBREVIATIONS})
    words = tokens(F.trim(F.regexp_replace(F.lower(clean(x)), "[^a-z0-9]+", " ")))
    parted = lambda t: F.regexp_replace(F.regexp_replace(t, "([a-z])([0-9])", "$1 $2"), "([0-9])([a-z])", "$1 $2")
    pieces = F.flatten(F.transform(words, lambda t: F.when(known[t].isNotNull(), F.array(t)).otherwise(F.split(parted(t), " "))))
    return F.regexp_replace(F.array_join(F.transform(pieces, lambda t: F.coalesce(known[t], t)), " "), r"\bcoconut (\d+)\b", "coconut type $1")
