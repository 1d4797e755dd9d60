import math
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from twinmark.llm import importance, language, licenses, quality_rules, toxicity

from .conftest import ODD


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("aB1 \n\t\x0b#%é! ")), max_size=80))
def test_measurements_by_their_definition(text):
    m = dict(zip(quality_rules.MEASURES, quality_rules.measure(text), strict=True))
    words = re.findall("[^\x20\x09-\x0d]+", text)
    assert m["n_words"] == len(words) and m["word_chars"] == sum(map(len, words))
    assert m["n_symbols"] == len(re.findall(r"[#*$%&|<>]", text))
    lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    assert m["n_dup_lines"] == sum(x in lines[:i] for i, x in enumerate(lines))
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    inside = {i + j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(3)}
    assert m["n_repeat_words"] == len(inside)


def test_ledger_policies_and_ablation(spark, odd, nothing):
    rows = quality_rules.ledger(odd)
    judged = quality_rules.apply_policy(rows)
    assert judged.count() == len(ODD) and judged.where("doc_id = 1").first().base_failed
    assert judged.where("doc_id = 6").first().base_failed and judged.where("doc_id = 5").first().fail_bits & quality_rules.BIT["repeated_windows"]
    lines = {r.rule: r for r in quality_rules.ablation(rows).collect()}
    assert lines["too_few_words"].n_failed == judged.where("n_words < 50").count() and set(lines) == {n for n, _ in quality_rules.RULES}
    assert lines["too_few_words"].n_alone == rows.where(f"fail_bits = {quality_rules.BIT['too_few_words']}").count()
    good = spark.createDataFrame([(9, " ".join(f"word{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(60)), "x")], "doc_id long, text string, n_words string")
    kept = quality_rules.keep_documents(odd.select("doc_id", "text", "source").unionByName(good.selectExpr("doc_id", "text", "n_words as source")))
    assert [tuple(r) for r in kept.collect()] == [tuple(good.first())]
    assert quality_rules.keep_documents(good).columns == good.columns
    assert quality_rules.ledger(nothing).count() == 0 and quality_rules.keep_documents(nothing).count() == 0


def test_importance(spark, odd, nothing, labels):
    assert importance.select(odd, labels).count() == len(ODD)
    assert importance.select(nothing, labels).count() == 0
    assert importance.select(odd, labels.where("false")).where("kept").count() == len(ODD)
    random.seed(1)
    word = lambda: "".join(random.choices("abcdefgh", k=5))
    rows = [(i, " ".join(word() for _ in range(80)) if i % 4 else " ".join(word() + "%%%" for _ in range(80))) for i in range(400)]
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, int(i % 4 > 0)) for i in range(0, 400, 3)], "doc_id long, quality int")
    got = {r.doc_id: r.kept for r in importance.select(docs, marks).collect()}
    assert got == {i: i % 4 > 0 for i in range(400)}
    assert importance.select(docs, marks, k=10).where("kept").count() == 10
    assert {r.doc_id for r in importance.keep_documents(docs, docs, marks).collect()} == {i for i, k in got.items() if k}


def test_kth_largest(spark):
    random.seed(3)
    values = [random.choice([random.random(), 0.5, random.gauss(0, 1e6)]) for _ in range(3000)]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    for k in (1, 2, 700, 1500, 2999, 3000):
        assert importance.kth_largest(df, "x", k, bins=16, few=5) == sorted(values, reverse=True)[k - 1]


@settings(max_examples=50, deadline=None)
@given(st.binary(max_size=40))
def test_gram_chunks_lose_nothing(raw):
    whole = importance.gram_counts(raw)
    old, importance.CHUNK = importance.CHUNK, 7
    try:
        assert (importance.gram_counts(raw) == whole).all()
    finally:
        importance.CHUNK = old
    assert whole.sum() == sum(max(len(raw) - n + 1, 0) for n in importance.ORDERS)


def language_rows(n=240):
    random.seed(5)
    parts = {"aa": ["ba", "lo", "mi", "ta"], "bb": ["sch", "ung", "keit", "ß"], "cc": ["çé", "eau", "oi", "que"]}
    return [(i, "" if i == 1 else " ".join("".join(random.choices(parts[lang], k=3)) for _ in range(random.randint(3, 200))), lang) for i in range(n) for lang in [list(parts)[i % 3]]]


def test_language(spark, odd, nothing):
    rows = language_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in language.identify(docs).collect()}
    tested = [(got[i], lang) for i, text, lang in rows if text and got[i].held_out]
    assert len(tested) > 30 and np.mean([r.lang_pred == lang for r, lang in tested]) > 0.95
    assert got[1].lang_pred == "und" and all(0 <= r.score <= 1 for r in got.values())
    strange = language.identify(odd).collect()
    assert len(strange) == len(ODD) and all(r.lang_pred == "und" and r.score == 0 for r in strange if r.doc_id in (1, 2, 3))
    assert language.identify(nothing).count() == 0
    assert {r.lang_pred for r in language.identify(docs.selectExpr("doc_id", "text", "cast(null as string) as lang")).collect()} == {"und"}


def test_language_reads_whole_texts():
    rows = [r for r in language_rows() if r[1]]
    classes = ["aa", "bb", "cc"]
    windows = np.concatenate([language.cut_windows(t.encode()) for _, t, _ in rows])
    answers = np.concatenate([np.full(len(language.cut_windows(t.encode())), classes.index(lang)) for _, t, lang in rows])
    net = language.train(windows, answers, classes)
    one, other = "balomi " * 40, "schungkeit " * 4000
    names, _ = language.predict_batch(net, [one + other, other + one, None, "12 3"])
    assert names == ["bb", "bb", "und", "und"]


def test_licenses(spark, odd, nothing):
    rows = [
        (1, "Intro. Licensed under the Apache License, Version 2.0. more"),
        (2, "ALL rights\nreserved; all rights reserved"),
        (3, "This work is licensed under the GNU General Public License, version 3."),
        (4, "this work is freely licensed under the GNU General Public License version 3"),
        (5, "licensed under nothing at all"),
        (6, "Licensed under CC BY-NC 4.0."),
        (7, "K cc by"),
        (8, "Redistribution and use in source and binary forms, with or without modification, are permitted (subject to the limitations in the disclaimer below) provided that the following conditions are met"),
        (9, "Redistribution and use in source and binary forms " + "far away " * 30 + "are permitted provided that the following conditions are met"),
    ]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert (got[1].labels, got[1].base_labels, got[1].n_base, got[1].first_word) == ("apache", "", 0, None) and got[1].score == 1.0
    assert (got[2].n_base, got[2].first_word, got[2].last_word, got[2].labels) == (2, 0, 3, "reserved")
    assert got[3].labels == "gpl" and got[4].labels == "gpl" and got[5].labels == "" and got[5].score == 0
    assert got[6].base_labels == "cc-by" and got[6].labels == "cc-by,cc-by-nc"
    assert got[7].first_word == 1
    assert got[8].labels == "bsd" and got[9].labels == ""
    both = licenses.scan(spark.createDataFrame([(1, "all rights waived, all rights reserved")], "doc_id long, text string"), phrases=(*licenses.PHRASES, ("all rights", "rights"))).first()
    assert (both.n_base, both.base_labels, both.first_word, both.last_word) == (3, "reserved,rights", 0, 3)
    spans = licenses.spans(spark.createDataFrame(rows[3:4], "doc_id long, text string")).first()
    assert (spans.first_word, spans.end_word) == (4, 13) and math.isclose(spans.coverage, 9 / 12) or spans.coverage >= licenses.COVERAGE
    assert licenses.scan(odd).count() == len(ODD) and licenses.scan(nothing).count() == 0
    plan = licenses.scan(odd)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(row[-1] + 1, old[j] + 1, old[j - 1] + (x != y)))
    return row[-1]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="abc", min_size=1, max_size=8))
def test_automaton_equals_edit_distance(word):
    terms = [("abcab", False), ("bb", False), ("caccab", False), ("abba", True), ("aaaaa", True)]
    found = toxicity.Automaton(terms).search(word)
    want = []
    for k, (term, stem) in enumerate(terms):
        d = min(edits(word[:n], term) for n in range(1, len(word) + 1)) if stem else edits(word, term)
        if d == 0 or d == 1 and len(term) >= toxicity.EDITABLE:
            want.append((d, k))
    assert (found is None) == (not want) and (found is None or found[1] == min(want)[0])


def test_toxicity(spark, odd, nothing, labels):
    random.seed(8)
    word = lambda: "".join(random.choices("abdefhklmnoprstuvw", k=random.randint(3, 8)))
    bad = ["moronx", "idiotic", "scumbag"]
    rows = []
    for i in range(600):
        words = [word() for _ in range(60)]
        if i % 4 == 0:
            for _ in range(3):
                words[random.randrange(60)] = random.choice(bad)
        rows.append((i, " ".join(words), int(i % 4 == 0)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit(docs, docs)
    assert {t for t, _ in model.terms} == set(bad)
    got = {r.doc_id: r for r in toxicity.score(docs, docs).collect()}
    held = [(got[i].predicted, t) for i, _, t in rows if got[i].held_out]
    assert len(held) > 60 and all(p == t for p, t in held)
    probes = spark.createDataFrame([(1, "you " + "idi0tic scumbagg moronnx " * 2), (2, 'he said "idiotic" once ' + "fine words " * 30), (3, None)], "doc_id long, text string")
    seen = {r.doc_id: r for r in toxicity.score(probes, model=model).collect()}
    assert seen[1].n_edited == 6 and seen[1].predicted == 1 and seen[2].n_quoted == 1 and seen[2].predicted == 0 and seen[3].predicted == 0
    assert toxicity.score(odd, labels).count() == len(ODD) and toxicity.score(nothing, labels).count() == 0
    assert toxicity.score(odd, labels.where("false")).select("score").distinct().count() == 1


def test_quotation():
    assert toxicity.context(["he", "called", "me", "idiot"], 3)[0]
    assert not toxicity.context(["what", "an", "idiot", "this", "is"], 2)[0]
    assert toxicity.context(["the", "“idiot”", "again"], 1)[0]
    assert pytest.importorskip("numpy") is not None


@pytest.mark.parametrize("term", ["zug", "z" * 45])
def test_short_and_long_words_can_be_terms(spark, term):
    rng = np.random.default_rng(8)
    words = ["".join(rng.choice(list("abcdefghij"), 6)) for _ in range(300)]
    rows = []
    for i in range(200):
        text, toxic = rng.choice(words, 12).tolist(), int(i % 4 == 0)
        rows.append((i, " ".join([*text[:6], *[term] * toxic, *text[6:]]), toxic))
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    got = {r.doc_id: r for r in toxicity.score(docs, docs).collect()}
    assert all(got[i].predicted == toxic for i, _, toxic in rows)
    assert all((got[i].n_hits > 0) >= toxic for i, _, toxic in rows)
