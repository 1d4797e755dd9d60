"""What both engines share in deciding: modes, levels, record fields of a pair, evidence structs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import vocab
from ..functions.text import clean

DIFFERENCE = "struct<type:string,feature:string,label:string,severity:string,values_a:array<string>,values_b:array<string>,message:string>"


def scan_mode(value: str | None) -> str:
    """A known mode in upper case, or the default."""
    mode = (value or "").strip().upper()
    return mode if mode in vocab.SCAN_MODES else vocab.SCAN_MODES[0]


def confidence_level(score: Column) -> Column:
    return reduce(lambda c, x: c.when(score >= x[1], x[0]), vocab.LEVELS[1:], F.when(score >= vocab.LEVELS[0][1], vocab.LEVELS[0][0])).otherwise("IGNORE")


def score_status(score: Column) -> Column:
    return F.when(score >= 85, vocab.DUPLICATE).when(score >= 60, vocab.POSSIBLE).otherwise(vocab.UNIQUE)


def side_value(columns: set[str], side: str, field: str) -> Column:
    """Cleaned value of a record field of one side; empty where the column is absent."""
    return clean(f"{side}.{field}") if field in columns else F.lit("")


def differs(a: Column, b: Column) -> Column:
    """Both present and unequal apart from case."""
    return (a != "") & (b != "") & (F.lower(a) != F.lower(b))


def difference(*, kind=None, feature=None, label=None, severity=None, a=None, b=None, message=None) -> Column:
    text = lambda x: F.lit(x).cast("string") if x is None or isinstance(x, str) else x
    many = lambda x: F.array().cast("array<string>") if x is None else x
    return F.struct(
        text(kind).alias("type"), text(feature).alias("feature"), text(label).alias("label"), text(severity).alias("severity"), many(a).alias("values_a"), many(b).alias("values_b"), text(message).alias("message")
    )


def chosen(items: list[Column], kind: str) -> Column:
    """Array of the items that are not null, in order."""
    return F.filter(F.array(*[i.cast(kind) for i in items]), lambda x: x.isNotNull())


def joined(values: Column) -> Column:
    return F.array_join(F.filter(values, lambda v: v != ""), ", ")
