"""License scan by diagonal voting.

Every rolling word k-gram of a text is joined by its hash to the positions it has in license templates.  A hit
votes for the diagonal of its offset (position in the text less position in the template); votes on
neighbouring diagonals, which insertions and deletions cause, are merged, spans that a longer insertion parts are
chained, and a span counts if the words that its hits confirm make up enough of the template.  All of it runs as DataFrame operations.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


K = 3
#: Diagonals this close are one span; spans this many words apart are one if the template goes on in the later one; the
#: share of a template's words that a span must confirm.
NEAR, GAP, COVERAGE = 2, 20, 0.8
#: What separates words: all ASCII but letters and digits (upper case is lowered first).
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Phrases that count wherever their words stand consecutively, with their labels.
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

#: Public license wording, with the labels it stands for.
TEMPLATES = (
    ("cc-by", "licensed under cc by 4 0"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("agpl", "under the terms of the gnu affero general public license as published by the free software foundation"),
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("reserved", "copyright all rights reserved"),
)


def word_list(text: Column) -> Column:
    """Words of a text, A-Z lowered.  ``lower`` also changes other letters, which no phrase or template holds, except
    for two signs that it turns into ASCII letters; texts with those are lowered letter by letter."""
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    text = F.coalesce(text.cast("string"), F.lit(""))
    lowered = F.when(text.contains("K") | text.contains("İ"), F.translate(text, letters, letters.lower())).otherwise(F.lower(text))
    return F.filter(F.split(lowered, SEPARATORS), lambda w: w != "")


def phrase_places(words: Column, phrases) -> Column:
    """Structs (i, code): the word at which a phrase starts and the number of the phrase.

    Phrases with the same first word are looked for one after the other, so that none hides another.
    """
    rounds: list[dict[str, tuple[int, str]]] = []
    for number, (phrase, _) in enumerate(phrases):
        first = phrase.split()[0]
        free = next((r for r in rounds if first not in r), None)
        if free is None:
            rounds.append(free := {})
        free[first] = (number, phrase)
    found = [F.filter(F.transform(phrase_at(words, list(r.values())), lambda code, i: F.when(code.isNotNull(), F.struct(i.alias("i"), code.alias("code")))), lambda s: s.isNotNull()) for r in rounds]
    return F.concat(*found)


def phrase_at(words: Column, phrases) -> Column:
    """For each word the number of the phrase (number, text) that starts there, else null."""

    def at(word: Column, i: Column) -> Column:
        value = F.lit(None).cast("int")
        for number, phrase in reversed(phrases):
            first, *rest = phrase.split()
            same = reduce(lambda c, x: c & F.coalesce(F.get(words, i + x[0]) == x[1], F.lit(False)), enumerate(rest, 1), word == first)
            value = F.when(same, F.lit(number)).otherwise(value)
        return value

    return F.transform(words, at)


def template_grams(spark: SparkSession, templates=TEMPLATES, k: int = K) -> DataFrame:
    """(gram, h, template, label, t_pos, t_words): as many rows as the templates have words, so it may be broadcast."""
    rows = []
    for number, (label, phrase) in enumerate(templates):
        words = phrase.split()
        rows += [(" ".join(words[i : i + k]), number, label, i, len(words)) for i in range(len(words) - k + 1)]
    grams = spark.createDataFrame(rows, "gram string, template int, label string, t_pos int, t_words int")
    return grams.withColumn("h", F.xxhash64(*[F.get(F.split("gram", " "), F.lit(j)) for j in range(k)]))


def spans(docs: DataFrame, templates=TEMPLATES, *, k: int = K, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Verified spans: key1, key2 (of id and text), template, label, first_word, end_word, coverage.

    All k-grams of all texts are joined; the hits alone, whose words are compared with the template's, are shuffled.
    """
    keyed = docs.select(*row_keys(id_col, text_col), word_list(F.col(text_col)).alias("words"))
    grams = F.transform("words", lambda w, i: F.xxhash64(w, *[F.get("words", i + j) for j in range(1, k)]))
    rolled = keyed.select("key1", "key2", "words", F.posexplode(F.slice(grams, F.lit(1), F.greatest(F.size("words") - (k - 1), F.lit(0)))).alias("pos", "h"))
    hits = (
        rolled.join(F.broadcast(template_grams(docs.sparkSession, templates, k)), "h")
        .where(F.array_join(F.slice("words", F.col("pos") + 1, k), " ") == F.col("gram"))
        .select("key1", "key2", "template", "label", "t_words", "t_pos", "pos", (F.col("pos") - F.col("t_pos")).alias("diagonal"))
    )
    votes = hits.groupBy("key1", "key2", "template", "label", "t_words", "diagonal").agg(F.collect_set("t_pos").alias("places"), F.min("pos").alias("low"), F.max("pos").alias("high"))
    along = Window.partitionBy("key1", "key2", "template").orderBy("diagonal")
    merged = (
        votes.withColumn("step", F.when(F.col("diagonal") - F.lag("diagonal").over(along) <= NEAR, 0).otherwise(1))
        .withColumn("span", F.sum("step").over(along))
        .groupBy("key1", "key2", "template", "label", "t_words", "span")
        .agg(F.array_distinct(F.flatten(F.collect_list("places"))).alias("places"), F.min("low").alias("first_word"), (F.max("high") + k).alias("end_word"))
    )
    # a longer insertion leaves two spans on far diagonals: they are chained if the second goes on where the first ended
    down = Window.partitionBy("key1", "key2", "template").orderBy("first_word", "span")
    goes_on = (F.col("first_word") - F.lag("end_word").over(down) <= GAP) & (F.array_min("places") > F.lag(F.array_max("places")).over(down))
    merged = (
        merged.withColumn("step", F.when(goes_on, 0).otherwise(1))
        .withColumn("chain", F.sum("step").over(down))
        .groupBy("key1", "key2", "template", "label", "t_words", "chain")
        .agg(F.array_distinct(F.flatten(F.collect_list("places"))).alias("places"), F.min("first_word").alias("first_word"), F.max("end_word").alias("end_word"))
    )
    covered = F.size(F.array_distinct(F.flatten(F.transform("places", lambda p: F.array(*[p + j for j in range(k)])))))
    return merged.withColumn("coverage", covered / F.col("t_words")).where(F.col("coverage") >= COVERAGE).drop("places", "chain", "t_words")


def row_keys(id_col: str, text_col: str) -> list[Column]:
    """128 bits that tell rows of different id or text apart; equal rows have equal hits."""
    doc_id, text = F.col(id_col).cast("long"), F.col(text_col).cast("string")
    return [F.xxhash64(doc_id, text).alias("key1"), F.xxhash64(text, F.lit(1), doc_id).alias("key2")]


def scan(docs: DataFrame, templates=TEMPLATES, phrases=PHRASES, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, one row per input row.

    The phrases count wherever they stand; ``labels`` adds those of verified template spans; ``score`` is the largest
    share of a template that a span confirms, and 1 where a phrase stands.  Null and empty texts have no words,
    no labels and score 0.  Repeated rows get equal results; a null doc_id is kept; other columns are ignored; an
    empty table gives no rows.
    """
    found = phrase_places(F.col("words"), phrases)
    names = F.array(*[F.lit(label) for _, label in phrases])
    base = (
        docs.select(F.col(id_col).cast("long").alias("doc_id"), *row_keys(id_col, text_col), word_list(F.col(text_col)).alias("words"))
        .select("doc_id", "key1", "key2", F.size("words").cast("long").alias("n_words"), found.alias("found"))
        .select(
            "doc_id",
            "key1",
            "key2",
            "n_words",
            F.size("found").cast("long").alias("n_base"),
            F.array_min("found.i").cast("long").alias("first_word"),
            F.array_max("found.i").cast("long").alias("last_word"),
            F.array_distinct(F.transform("found.code", lambda c: F.get(names, c))).alias("own"),
        )
    )
    spanned = spans(docs, templates, id_col=id_col, text_col=text_col).groupBy("key1", "key2").agg(F.collect_set("label").alias("more"), F.max("coverage").alias("best"))
    none = F.array().cast("array<string>")
    return base.join(spanned, ["key1", "key2"], "left").select(
        "doc_id",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join(F.array_sort("own"), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("own", F.coalesce("more", none))), ",").alias("labels"),
        F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
    )


def oracle(templates=TEMPLATES, k: int = K) -> str:
    values = ", ".join(f"({n}, '{label}', '{phrase}')" for n, (label, phrase) in enumerate(templates))
    return rf"""
with d as (select row_number() over () as rid, doc_id, list_filter(string_split_regex(
  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{SEPARATORS}'), lambda w: w <> '') as ws from documents),
p as (select rid, ws, unnest(range(1, len(ws) + 1)) as i from d),
b as (select rid, i - 1 as i, case when ws[i] = 'cc' and ws[i + 1] = 'by' then 'cc-by'
   when ws[i] = 'general' and ws[i + 1] = 'public' and ws[i + 2] = 'license' then 'gpl'
   when ws[i] = 'all' and ws[i + 1] = 'rights' and ws[i + 2] = 'reserved' then 'reserved' end as label
  from p where ws[i] in ('cc', 'general', 'all')),
base as (select rid, count(*) as n_base, min(i) as first_word, max(i) as last_word, list_distinct(list(label)) as own
  from b where label is not null group by rid),
t as (select n, label, string_split(phrase, ' ') as tw from (values {values}) v(n, label, phrase)),
tg as (select n, label, len(tw) as t_words, j - 1 as t_pos, array_to_string(tw[j:j + {k - 1}], ' ') as g
  from (select *, unnest(range(1, len(tw) - {k - 2})) as j from t)),
g as (select rid, i - 1 as pos, array_to_string(ws[i:i + {k - 1}], ' ') as g from p where i <= len(ws) - {k - 1}
  and ws[i] in (select distinct split_part(g, ' ', 1) from tg)),
h as (select rid, n, label, t_words, t_pos, pos, pos - t_pos as diagonal from g join tg using (g)),
s as (select *, case when diagonal - lag(diagonal) over (partition by rid, n order by diagonal) <= {NEAR} then 0 else 1 end as step
  from (select distinct rid, n, label, t_words, diagonal from h)),
c as (select *, sum(step) over (partition by rid, n order by diagonal) as span from s),
hs as (select rid, n, label, t_words, t_pos, pos, span from h join c using (rid, n, label, t_words, diagonal)),
sp as (select rid, n, span, min(pos) as first_word, max(pos) + {k} as end_word, min(t_pos) as t_low, max(t_pos) as t_high from hs group by all),
ln as (select *, case when first_word - lag(end_word) over w <= {GAP} and t_low > lag(t_high) over w then 0 else 1 end as step
  from sp window w as (partition by rid, n order by first_word, span)),
ch as (select rid, n, span, sum(step) over (partition by rid, n order by first_word, span) as chain from ln),
cov as (select rid, n, label, t_words, chain, count(distinct t_pos + o) as covered
  from hs join ch using (rid, n, span), (select unnest(range({k})) as o) group by all),
best as (select rid, list_distinct(list(label)) as more, max(covered / t_words) as best from cov
  where covered / t_words >= {COVERAGE} group by rid)
select doc_id, len(ws) as n_words, coalesce(n_base, 0) as n_base, first_word, last_word,
 coalesce(array_to_string(list_sort(own), ','), '') as base_labels,
 array_to_string(list_sort(list_distinct(list_concat(coalesce(own, []), coalesce(more, [])))), ',') as labels,
 case when coalesce(n_base, 0) > 0 then 1.0::double else coalesce(best, 0.0)::double end as score
from d left join base using (rid) left join best using (rid)
"""
