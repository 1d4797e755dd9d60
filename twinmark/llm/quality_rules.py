"""Quality rules as a bitmask ledger.

Every rule is evaluated once for every document.  The ledger keeps the measurements and one failure bit a rule.
Policies are versioned masks over those bits: applying another policy, or asking what each rule of it costs,
reads the ledger and never the texts again.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_slices, store, texts

SPACES = b" \t\n\r\x0b\x0c"
SYMBOLS = b"#*$%&|<>"

#: Measurements, in ledger order.
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_letters", "n_upper", "n_shout_words", "n_top_word")

#: The bits, in order: (name, SQL condition of failure over the measurements).
RULES = (
    ("too_few_words", "n_words < 50"),
    ("repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    ("symbol_heavy", "10 * n_symbols > 3 * n_words"),
    ("duplicate_lines", "n_lines >= 4 and 100 * n_dup_lines > 50 * n_lines"),
    ("shouting", "n_letters > 0 and 100 * n_upper > 60 * n_letters"),
    ("exclaimed_words", "100 * n_shout_words > 30 * n_words"),
    ("few_letters", "100 * n_letters < 50 * word_chars"),
    ("word_length", "word_chars > 20 * n_words or 2 * word_chars < 3 * n_words"),
    ("one_word", "n_words >= 20 and 100 * n_top_word > 40 * n_words"),
)
BIT = {name: 1 << k for k, (name, _) in enumerate(RULES)}
BASE_MASK = BIT["too_few_words"] | BIT["repeated_windows"]


@dataclass(frozen=True)
class Policy:
    """A version of the rules that count: a document is rejected if any bit of ``mask`` is set in its ledger row."""

    version: str
    mask: int


POLICIES = {
    "v1-base": Policy("v1-base", BASE_MASK),
    "v2-full": Policy("v2-full", (1 << len(RULES)) - 1),
    "v3-lenient": Policy("v3-lenient", BASE_MASK | BIT["symbol_heavy"] | BIT["shouting"] | BIT["one_word"]),
}
CURRENT = POLICIES["v2-full"]


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a 3-word window found twice or more, its first place included."""
    if len(words) < 4:
        return 0
    windows = list(zip(words, words[1:], words[2:], strict=False))
    if len(set(windows)) == len(windows):
        return 0
    often = {w for w, n in Counter(windows).items() if n > 1}
    total = until = 0
    for i, w in enumerate(windows):
        if w in often:
            total += i + 3 - max(i, until)
            until = i + 3
    return total


def measure(text: str | None) -> tuple[int, ...]:
    """The measurements of one whole text; null counts as empty."""
    if not text:
        return (0,) * len(MEASURES)
    raw = text.encode()
    words = raw.split()  # splits at the six ASCII white-space bytes only
    lines = [x for x in raw.split(b"\n") if x.strip(SPACES)]
    stripped = raw.translate(None, SPACES)
    word_chars = len(stripped) if text.isascii() else len(stripped.decode())
    letters = sum(map(str.isalpha, text)) if not text.isascii() else len(re.findall(rb"[A-Za-z]", stripped))
    upper = sum(map(str.isupper, text)) if not text.isascii() else len(re.findall(rb"[A-Z]", stripped))
    return (
        len(words),
        word_chars,
        len(raw) - len(raw.translate(None, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
        len(lines),
        letters,
        upper,
        sum(w.endswith((b"!!", b"!!\"")) for w in words) if b"!!" in raw else 0,
        max(Counter(words).values()) if words else 0,
    )


def measurements(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and MEASURES of every whole text, in one narrow pass without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = list(zip(*(measure(text.as_py()) for text in batch.column(1)), strict=True)) or [()] * len(MEASURES)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in columns)], names=["doc_id", *MEASURES])

    return map_slices(texts(docs, id_col, text_col), run, "doc_id long, " + ", ".join(f"{m} long" for m in MEASURES))


def fail_bits(rows: DataFrame) -> DataFrame:
    """Adds fail_bits to rows with the MEASURES: one bit a rule, see RULES."""
    bits = [F.when(F.expr(condition), F.lit(BIT[name]).cast("long")).otherwise(F.lit(0).cast("long")) for name, condition in RULES]
    return rows.withColumn("fail_bits", reduce(lambda x, y: x.bitwiseOR(y), bits))


def ledger(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, MEASURES and fail_bits, one row per input row, stored in the shared folder.

    Policies and ablations read it as often as they like; the texts are not read again.  Null and empty texts have no
    words and fail ``too_few_words``; repeated rows are judged each; a null doc_id is kept; other columns are ignored;
    an empty table gives no rows.
    """
    return store(fail_bits(measurements(docs, id_col=id_col, text_col=text_col)), "ledger")


def rejects(policy: Policy = CURRENT):
    """Whether a ledger row is rejected under a policy."""
    return F.col("fail_bits").bitwiseAND(F.lit(policy.mask).cast("long")) != 0


def apply_policy(rows: DataFrame, policy: Policy = CURRENT) -> DataFrame:
    """Adds base_failed, kept and the policy's version to ledger rows."""
    return rows.select("*", (F.col("fail_bits").bitwiseAND(F.lit(BASE_MASK).cast("long")) != 0).alias("base_failed"), (~rejects(policy)).alias("kept"), F.lit(policy.version).alias("policy"))


def ablation(rows: DataFrame, policy: Policy = CURRENT) -> DataFrame:
    """What each rule of a policy rejects: rule, n_failed, n_alone (kept again if this rule alone were dropped).

    Ledger rows are first counted by their bits (as many rows as there are combinations, whatever the corpus);
    each rule then reads those counts by bit operations.
    """
    masked = F.col("fail_bits").bitwiseAND(F.lit(policy.mask).cast("long"))
    counts = rows.select(masked.alias("bits")).groupBy("bits").agg(F.count(F.lit(1)).alias("n"))
    rules = F.explode(F.array(*[F.struct(F.lit(name).alias("rule"), F.lit(BIT[name]).cast("long").alias("bit")) for name, _ in RULES if policy.mask & BIT[name]])).alias("r")
    return (
        counts.select("bits", "n", rules)
        .groupBy(F.col("r.rule").alias("rule"))
        .agg(
            F.coalesce(F.sum(F.when(F.col("bits").bitwiseAND(F.col("r.bit")) != 0, F.col("n"))), F.lit(0)).alias("n_failed"),
            F.coalesce(F.sum(F.when(F.col("bits") == F.col("r.bit"), F.col("n"))), F.lit(0)).alias("n_alone"),
        )
    )


def keep_documents(docs: DataFrame, policy: Policy = CURRENT) -> DataFrame:
    """The rows of ``docs`` that the policy keeps, with all their columns, whatever their names.

    Measurements and failure bits travel with the row through one Arrow pass, and the policy's mask reads the bits, so
    nothing is joined and no id need be unique.  Null and empty texts fail ``too_few_words``; repeated rows are judged
    each; rows without an id are judged like others; an empty table gives no rows.
    """
    at, names = docs.columns.index("text"), docs.columns
    own = docs.toDF(*[f"__c{k}" for k in range(len(names))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = list(zip(*(measure(text.as_py()) for text in batch.column(at)), strict=True)) or [()] * len(MEASURES)
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, pa.int64()) for c in columns)], names=[*batch.schema.names, *MEASURES])

    schema = T.StructType([*own.schema.fields, *(T.StructField(name, T.LongType()) for name in MEASURES)])
    judged = fail_bits(map_slices(own, run, schema))
    return judged.where(~rejects(policy)).select(*[F.col(f"__c{k}").alias(name) for k, name in enumerate(names)])


def failing(policy: Policy) -> str:
    return " or ".join(f"({condition})" for name, condition in RULES if policy.mask & BIT[name])


ORACLE_SQL = r"""
with d as (select row_number() over () as rid, doc_id, coalesce(text, '') as text from documents),
w as (select rid, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as ws from d),
win as (select rid, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] as g
        from (select rid, ws, unnest(range(1, len(ws) - 1)) as i from w)),
often as (select rid, g from win group by rid, g having count(*) > 1),
hit as (select distinct rid, i + unnest([0, 1, 2]) as p from win join often using (rid, g)),
rep as (select rid, count(*) as n_repeat_words from hit group by rid),
ln as (select rid, unnest(string_split(text, chr(10))) as l from d),
dup as (select rid, count(*) as n_lines, count(*) - count(distinct l) as n_dup_lines
        from ln where regexp_matches(l, '[^\x20\x09-\x0D]') group by rid),
tw as (select rid, max(c) as n_top_word from
        (select rid, x, count(*) as c from (select rid, unnest(ws) as x from w) group by rid, x) group by rid),
m as (
 select doc_id, len(ws) as n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) as word_chars,
  length(text) - length(regexp_replace(text, '[#*$%%&|<>]', '', 'g')) as n_symbols,
  coalesce(n_dup_lines, 0) as n_dup_lines, coalesce(n_repeat_words, 0) as n_repeat_words,
  coalesce(n_lines, 0) as n_lines,
  length(text) - length(regexp_replace(text, '\p{L}', '', 'g')) as n_letters,
  length(text) - length(regexp_replace(text, '\p{Lu}', '', 'g')) as n_upper,
  len(list_filter(ws, lambda x: ends_with(x, '!!') or ends_with(x, '!!"'))) as n_shout_words,
  coalesce(n_top_word, 0) as n_top_word
 from w left join rep using (rid) left join dup using (rid) left join tw using (rid))
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
 (n_words < 50 or 100 * n_repeat_words > 50 * n_words) as base_failed,
 not (%s) as kept,
 (%s)::bigint as fail_bits, not (%s) as kept_v1, not (%s) as kept_v3
from m
""" % (
    failing(CURRENT),
    " + ".join(f"(case when {condition} then {BIT[name]} else 0 end)" for name, condition in RULES),
    failing(POLICIES["v1-base"]),
    failing(POLICIES["v3-lenient"]),
)
