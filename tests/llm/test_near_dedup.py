import random
from itertools import combinations

import numpy as np
import pytest

from twinmark.llm import near_dedup as nd
from twinmark.llm.components import connected_components

from .conftest import ODD


def word_set(text, k):
    words = (text or "").encode().lower().split()
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1)) if len(words) >= k else frozenset([tuple(words)])


def brute(rows, k, percent=80):
    """Components by comparing all pairs of rows."""
    sets = [word_set(text, k) for _, text in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(range(len(rows)), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            parent[find(a)] = find(b)
    least = {}
    for k_, (doc_id, _) in enumerate(rows):
        least[find(k_)] = min(least.get(find(k_), doc_id), doc_id)
    return {(doc_id, len(sets[k_]), least[find(k_)]) for k_, (doc_id, _) in enumerate(rows)}


def family(seed):
    """Groups around hubs with edits of all strengths, exact copies, shared passages, short texts."""
    random.seed(seed)
    word = lambda: random.choice("abcdefghij") + str(random.randint(0, 400))
    texts = []
    for size, edits in ((60, (0, 9)), (25, (3, 6)), (3, (0, 2)), (1, (0, 0))):
        base = [word() for _ in range(120)]
        for _ in range(size):
            own = list(base)
            for _ in range(random.randint(*edits)):
                own[random.randrange(len(own))] = word()
            texts.append(" ".join(own))
    passage = " ".join(word() for _ in range(60))
    texts += [passage + " " + " ".join(word() for _ in range(random.randint(5, 80))) for _ in range(30)]
    texts += ["one two three", "ONE  two\nthree", "one", "", "x y z w v", "x y z w v"]
    random.shuffle(texts)
    return [(3 * i + 7, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("seed, k", [(1, 4), (2, 5), (3, 4)])
def test_links_equal_brute_force(spark, seed, k):
    rows = family(seed)
    got = nd.link_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), words=k).collect()
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in got} == brute(rows, k)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got) and len(got) == len(rows)


def test_odd_rows(odd, nothing):
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in nd.link_documents(odd, words=4).collect()), key=repr)
    want = [(1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 1, 4, True), (4, 1, 4, True), (5, 4, 5, True), (None, 2, None, False), (6, 1, 6, True), (7, 1, 7, True)]
    assert got == sorted(want, key=repr) and len(want) == len(ODD)
    assert nd.link_documents(nothing).count() == 0


def test_drop(spark, odd):
    kept = nd.drop_near_duplicates(odd)
    assert kept.columns == odd.columns
    assert sorted(map(repr, (r.doc_id for r in kept.collect()))) == sorted(map(repr, [1, 2, 3, 4, 5, 6, 7, None]))
    rows = family(4)
    left = {r.doc_id for r in nd.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert left == {c for d, _, c in brute(rows, 5) if d == c}


def test_registers_merge_and_estimate():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 1 << 63, 4000, dtype=np.uint64)
    b = np.concatenate([a[:3600], rng.integers(0, 1 << 63, 400, dtype=np.uint64)])
    assert (nd.merge(nd.registers(a), nd.registers(b)) == nd.registers(np.union1d(a, b))).all()
    same = (nd.registers(a) == nd.registers(b)).mean()
    assert abs(same - 3600 / 4400) < 0.15
    share = np.linspace(0, 1, 101)
    ra, rb = nd.registers(a)[None], nd.registers(b)[None]
    more, less = (ra > rb).sum(1), (ra < rb).sum(1)
    values = [nd.likelihood(np.array([j]), np.array([0.5]), more, less, nd.REGISTERS - more - less)[0] for j in share]
    assert abs(share[int(np.argmax(values))] - 3600 / 4400) < 0.15


def test_filter_keeps_what_is_similar():
    rng = np.random.default_rng(2)
    for n in (1, 2, 5, 40, 500):
        base = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        for _ in range(40):
            cut = int(rng.integers(0, n // 9 + 1))
            other = np.concatenate([base[: n - cut], rng.integers(0, 1 << 63, cut, dtype=np.uint64)])
            if 100 * (n - cut) >= 80 * (n + cut):
                assert nd.possible(nd.registers(base)[None], nd.registers(other)[None], np.array([n]), np.array([n]), 80)[0]


def test_the_map_of_bits_misses_no_id(spark, monkeypatch):
    from pyspark.sql import functions as F

    from twinmark.llm import common

    rows = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("x").alias("__x")).union(spark.sql("select cast(null as long), 'y'"))
    ids = spark.range(0, 3000, 7).withColumnRenamed("id", "i")
    for bits in (1 << 25, 1 << 10):
        monkeypatch.setattr(common, "MAP_BITS", bits)
        found = common.perhaps_among(rows, "doc_id", ids)
        assert found.count() == 3001 and found.columns == ["doc_id", "__x", "__perhaps"]
        assert found.where("doc_id % 7 = 0 and not __perhaps").count() == 0
        said_no = found.where("not __perhaps").count()
        assert (said_no >= 2565) if bits > 1 << 20 else (1500 < said_no < 2572)
    assert common.perhaps_among(rows, "doc_id", ids.where("false")).where("__perhaps").count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, k) for k in range(101, 150)] + [(7, 7), (200, 201), (201, 200)]
    got = {r.id: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(51), 0), **dict.fromkeys(range(100, 150), 100), 200: 200, 201: 200}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
