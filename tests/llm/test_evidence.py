"""Results recomputed in plain Python: no numpy tricks, no batches, no Spark."""

import math
import os
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

import corpus_pipeline
from twinmark.llm import importance, language, packing, quality_rules, registry, tokens, toxicity
from twinmark.llm.common import table

from .conftest import CLASH, ODD
from .test_filters import edits, language_rows
from .test_near_dedup import brute
from .test_tokens import check_packing

SF = "/root/testdata/sf0.001"
given = pytest.mark.skipif(not os.path.isdir(SF), reason="the given tables are not here")


def plain_log_probabilities(net, window):
    """The network on one window of bytes, one number at a time."""
    hidden = []
    for f in range(net.filters.shape[1]):
        width, best = language.WIDTHS[f // language.FILTERS], -math.inf
        for at in range(language.WINDOW):
            total = 0.0
            for j in range(width):
                code = net.embedding[window[at + j] if at + j < language.WINDOW else 0]
                total += sum(float(code[e]) * float(net.filters[j * language.EMBEDDING + e, f]) for e in range(language.EMBEDDING))
            best = max(best, total)
        hidden.append(max(0.0, best + float(net.bias[f])))
    logits = [sum(h * float(net.output[f, c]) for f, h in enumerate(hidden)) + float(net.output_bias[c]) for c in range(len(net.classes))]
    return [x - math.log(sum(map(math.exp, logits))) for x in logits]


def test_network_forward_and_gradients():
    rng = np.random.default_rng(1)
    net = language.start_network(["a", "b", "c"], np.float64)
    net.bias += rng.normal(size=net.bias.shape) * 0.1
    windows = np.stack([language.cut_windows(bytes(rng.integers(0, 256, n, dtype=np.uint8)))[0] for n in (256, 100, 3)])
    got = net.log_probabilities(windows)
    for k in (0, 2):
        assert np.allclose(got[k], plain_log_probabilities(net, windows[k].tolist()), atol=1e-9)
    answers = np.array([0, 2, 1])
    loss = lambda: -net.log_probabilities(windows)[np.arange(3), answers].mean()
    for value, gradient in zip([net.embedding, net.filters, net.bias, net.output, net.output_bias], language.gradients(net, windows, answers), strict=True):
        for place in [tuple(rng.integers(0, n) for n in value.shape) for _ in range(6)] + [np.unravel_index(np.abs(gradient).argmax(), value.shape)]:
            if value is net.filters and not language.reach()[place]:
                continue
            old = value[place]
            value[place] = old + 1e-6
            up = loss()
            value[place] = old - 1e-6
            down = loss()
            value[place] = old
            assert math.isclose((up - down) / 2e-6, gradient[place], rel_tol=1e-3, abs_tol=1e-7)


def test_language_repeated_ids_are_bounded(spark):
    rows = language_rows(60)
    docs = spark.createDataFrame(rows + [(4, f"balo mita {k}", "aa") for k in range(300)] + [rows[6]] * 50, "doc_id long, text string, lang string")
    windows = language.training_windows(docs, 20)
    assert windows.count() <= 20 * language.WINDOWS_EACH


def plain_grams(raw):
    found = []
    for n in importance.ORDERS:
        for i in range(len(raw) - n + 1):
            code = raw[i]
            for c in raw[i + 1 : i + n]:
                code = (code * 0x01000193 & 0xFFFFFFFF) ^ c
            found.append(((code * 2654435769 + n) & 0xFFFFFFFF) >> (32 - importance.BITS))
    return found


def plain_selection(docs, corpus, quality):
    """{row number: (log weight, key)} and the cut, from the definitions."""
    target, everything = Counter(), Counter()
    for doc_id, text in corpus:
        grams = plain_grams((text or "").encode())
        everything.update(grams)
        if quality.get(doc_id) == 1:
            target.update(grams)
    size, t_all, e_all = 1 << importance.BITS, sum(target.values()), sum(everything.values())
    ratio = lambda g: math.log((target[g] + 0.5) / (t_all + 0.5 * size)) - math.log((everything[g] + 0.5) / (e_all + 0.5 * size))

    def weight(text):
        grams = plain_grams((text or "").encode())
        return importance.LENGTH * sum(map(ratio, grams)) / len(grams) if grams else 0.0

    def key(doc_id, text):
        bits = xxhash.xxh3_64_intdigest((text or "").encode(), seed=importance.SEED + 31 * (doc_id or 0))
        return weight(text) - math.log(-math.log(((bits >> 11) + 0.5) / 2.0**53))

    of = defaultdict(list)
    for doc_id, text in corpus:
        if doc_id in quality:
            of[doc_id].append(weight(text))
    good = sorted(min(w) for d, w in of.items() if quality[d] == 1)
    bad = sorted(min(w) for d, w in of.items() if quality[d] != 1)
    low, middle = float(np.quantile(good, importance.LOWEST)), float(np.median(bad))
    cut = low - importance.TOWARDS_BAD * max(low - middle, 0.0)
    found = [(weight(text), key(doc_id, text)) for doc_id, text in docs]
    drawn = sorted((k for _, k in found), reverse=True)[: sum(w >= cut for w, _ in found)]
    return found, [bool(drawn) and k >= drawn[-1] for _, k in found]


@given
def test_weights_and_drawn_documents(spark):
    docs, labels = table(spark, SF, "documents").orderBy("doc_id").limit(120), table(spark, SF, "labels")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    quality = {r.doc_id: r.quality for r in labels.collect() if r.quality is not None}
    found, kept = plain_selection(rows, rows, quality)
    got = {r.doc_id: r for r in importance.select(docs, labels).collect()}
    for (doc_id, _), (weight, key), keep in zip(rows, found, kept, strict=True):
        assert math.isclose(got[doc_id].log_weight, weight, abs_tol=1e-6) and math.isclose(got[doc_id].sample_key, key, abs_tol=1e-6) and got[doc_id].kept == keep
    order = sorted(range(len(rows)), key=lambda k: -found[k][1])
    assert {r.doc_id for r in importance.select(docs, labels, k=25).where("kept").collect()} == {rows[k][0] for k in order[:25]}
    # the noise matters: the drawn set is not simply that of the largest weights
    assert {rows[k][0] for k in order[:25]} != {rows[k][0] for k in sorted(range(len(rows)), key=lambda k: -found[k][0])[:25]}


def plain_score(text, model):
    """The score of one text, with a plain edit distance against every term."""

    def best(word):
        found = None
        for number, (term, stem) in enumerate(model.terms):
            d = min((edits(word[:n], term) for n in range(1, len(word) + 1)), default=9) if stem else edits(word, term)
            if d == 0 or d == 1 and len(term) >= toxicity.EDITABLE:
                found = min(found or (9, 0), (d, number))
        return found

    words = (text or "").split()
    abuse = quoted = addressed = 0.0
    kinds = set()
    for place, token in enumerate(words):
        word = toxicity.plain(token)
        hit = best(word) if word else None
        if not (hit and hit[0] == 0) and word and not word.isalpha() and word.translate(toxicity.SIGNS) != word:
            other = best(word.translate(toxicity.SIGNS))
            if other and (hit is None or other[0] < hit[0]):
                hit = (max(other[0], 1), other[1])
        if hit is None:
            continue
        value = 1.0 if hit[0] == 0 else float(model.trust[hit[1]])
        near = {toxicity.plain(w) for w in words[max(0, place - 3) : place] + words[place + 1 : place + 4]}
        inside = toxicity.context(words, place)[0]
        abuse, quoted, addressed = abuse + value * (not inside), quoted + value * inside, addressed + value * bool(near & toxicity.ADDRESSING)
        if value > 0.5:
            kinds.add(hit[1])
    if not text:
        x = [0.0] * 5
    else:
        x = [math.log1p(abuse), math.log1p(quoted), math.log1p(addressed), math.log1p(1000 * abuse / len(text)), math.log1p(max(len(kinds) - 1, 0))]
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, sum(a * float(b) for a, b in zip(x, model.weights, strict=True)) + model.bias))))


def test_scores_recomputed(spark):
    rng = np.random.default_rng(6)
    clean = ["".join(rng.choice(list("abdefhklmnop"), int(rng.integers(3, 8)))) for _ in range(200)]
    bad = ["scumbag", "moronix", "vileton"]
    rows = []
    for i in range(240):
        words = rng.choice(clean, 30).tolist()
        if i % 4 == 0:
            words[int(rng.integers(2, 28))] = str(rng.choice(bad + ["scumbqg", "m0ronix", '"vileton"', "vileto"]))
            words[int(rng.integers(2, 28))] = str(rng.choice(["you", "said", bad[i % 3]]))
        rows.append((i, " ".join(words), int(i % 4 == 0)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit(docs, docs)
    assert {t for t, _ in model.terms} >= set(bad)
    own = [*rows, (1000, None, 0), (1001, "", 0), (1002, 'he said "scumbag" to you', 0)]
    for r in toxicity.score(spark.createDataFrame(own, "doc_id long, text string, toxic int"), model=model).collect():
        text = next(t for i, t, _ in own if i == r.doc_id)
        assert math.isclose(r.score, plain_score(text, model), abs_tol=1e-9) and r.predicted == int(r.score >= 0.5)


def test_lexicon_has_no_caps():
    assert toxicity.least_support({1: 10**6, 40: 10**5}, 0.2) == 8
    n = toxicity.least_support({5000: 1000}, 0.99)
    assert n > 64 and 1000 * 0.99**n <= toxicity.BY_CHANCE < 1000 * 0.99 ** (n - 1)
    terms = [(f"w{k:04d}x", False) for k in range(3000)] + [("ab", False), ("zz" * 30, False)]
    automaton = toxicity.Automaton(terms)
    assert automaton.search("w2999x") == (2999, 0) and automaton.look_up("ab") == (3000, 0) and automaton.look_up("zz" * 30) == (3001, 0) and automaton.look_up("ac") is None


@given
def test_run_against_a_plain_pipeline(spark):
    documents = [(r.doc_id, r.text) for r in table(spark, SF, "documents").collect()]
    quality = {r.doc_id: r.quality for r in table(spark, SF, "labels").collect() if r.doc_id is not None and r.quality is not None}

    def fine(text):
        measured = dict(zip(quality_rules.MEASURES, quality_rules.measure(text), strict=True))
        return not any(eval(c, measured) for _, c in quality_rules.RULES)  # noqa: S307

    ruled = [(d, t) for d, t in documents if fine(t)]
    _, drawn = plain_selection(ruled, documents, quality)
    chosen = [row for row, keep in zip(ruled, drawn, strict=True) if keep]
    single = {d for d, _, c in brute(chosen, 5) if d == c}
    library = tokens.vocabulary_tokenizer(registry.tokenizer_file("byte_bpe_50k.json"))
    want = Counter()
    for doc_id, text in chosen:
        if doc_id in single:
            ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
            want.update((doc_id, k, start, length, zlib.crc32(ids[start : start + length].tobytes())) for k, (start, length) in enumerate(packing.cut(len(ids), 1024)))
    rows = corpus_pipeline.run(spark, SF).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    check_packing(rows, 1024)


@given
def test_stages_take_odd_rows(spark, odd, nothing):
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, nothing, SF).count() == 0
        found = stage(spark, odd, SF)
        if name == "packing":
            assert found.count() >= len(ODD)
        else:
            assert found.columns == odd.columns and found.count() <= len(ODD) and found.schema == odd.schema


def test_keep_documents_of_odd_rows(spark, odd, nothing, labels):
    assert importance.keep_documents(odd, odd, labels.where("false")).count() == len(ODD)
    assert importance.keep_documents(nothing, odd, labels).count() == 0 and importance.keep_documents(odd, odd, labels).columns == odd.columns
    names = [c.split()[0] for c in CLASH.split(", ")]
    good = " ".join(f"word{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(60))
    rows = spark.createDataFrame([(9, good, *[None] * 11), (None, good, *[None] * 11), (9, good, *[None] * 11), (3, None, *[None] * 11)], CLASH)
    kept = quality_rules.keep_documents(rows)
    assert kept.columns == names and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 9, 9]


@given
@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_queries_leave_the_session_as_it_was(spark, name):
    before = dict(spark.conf.getAll)
    df = registry.queries()[name](spark, SF)
    table_name = "embeddings" if name.startswith("op8") else "documents"
    assert df.count() >= table(spark, SF, table_name).count()
    assert dict(spark.conf.getAll) == before
