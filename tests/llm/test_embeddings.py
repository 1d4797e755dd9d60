import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from twinmark.llm import embedding_dedup as ed


def make(seed=0, clusters=40, dim=16):
    """Tight and loose groups in two labels, copies, and a large dense group."""
    rng, rows = np.random.default_rng(seed), []
    for k in range(clusters):
        center = rng.normal(size=dim)
        for _ in range(int(rng.integers(1, 9)) if k else 150):
            rows.append((k % 2, (center + rng.normal(size=dim) * rng.choice([0.0, 0.05, 0.25])).astype(np.float32).tolist()))
    rows += [(k % 2, rng.normal(size=dim).astype(np.float32).tolist()) for k in range(150)]
    order = rng.permutation(len(rows))
    return [(int(5 * i + 2), rows[j][1], rows[j][0]) for i, j in enumerate(order)]


def brute(rows, threshold=0.93):
    n = len(rows)
    x = np.array([r[1] for r in rows], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    label = np.array([r[2] for r in rows])
    linked = (x @ x.T >= threshold) & (label[:, None] == label[None]) & ~np.eye(n, dtype=bool)
    component = np.arange(n)
    while True:
        new = np.array([min(component[i], *component[linked[i]]) if linked[i].any() else component[i] for i in range(n)])
        if (new == component).all():
            return {r[0]: (int(linked[i].sum()), rows[component[i]][0]) for i, r in enumerate(rows)}
        component = new


SHAPE = "vec_id long, embedding array<float>, label int"


@pytest.mark.parametrize("cluster, piece", [(2000, 4096), (60, 50)])
def test_links_against_brute_force(spark, monkeypatch, cluster, piece):
    monkeypatch.setattr(ed, "CLUSTER", cluster)
    monkeypatch.setattr(ed, "PIECE", piece)
    monkeypatch.setattr(ed, "ASKED", 2 * piece)
    rows = make()
    got = {r.vec_id: (r.n_links, r.component_id) for r in ed.link_vectors(spark.createDataFrame(rows, SHAPE)).collect()}
    want = brute(rows)
    found, true = sum(v[0] for v in got.values()), sum(v[0] for v in want.values())
    assert all(got[i][0] <= want[i][0] for i in want)
    assert found >= 0.98 * true
    if cluster == 2000:
        assert got == want


def test_large_clusters_are_dealt_by_centroids_of_their_own(spark, monkeypatch):
    for name, value in {"CLUSTER": 25, "SAMPLE": 160, "SPLIT": 60, "SUBSAMPLE": 80, "DEALT": 64, "PIECE": 50, "ASKED": 90}.items():
        monkeypatch.setattr(ed, name, value)
    rows = make(6)
    ready = ed.prepare(spark.createDataFrame(rows, SHAPE), "vec_id", "embedding", "label")
    classes = ready.groupBy("digest", "label").agg(F.min("vec_id").alias("id"), F.countDistinct("vec_id").alias("mult"), F.first("vec").alias("vec")).cache()
    centroids = ed.fit_centroids(classes, classes.count())
    second = ed.fit_second_level(classes, centroids)
    assert second is not None and second.where("n > 60").count() == second.count()
    first, dealt = ed.deal(classes, centroids, 3), ed.refine(ed.deal(classes, centroids, 3), second, 3).cache()
    assert dealt.where("rank = 0").count() == classes.count() == dealt.where("rank = 0").select("id").distinct().count()
    assert dealt.select("id", "cluster").distinct().count() == dealt.count() and dealt.agg(F.max("rank")).first()[0] == 2
    largest = lambda df: df.where("rank = 0").groupBy("label", "cluster").count().agg(F.max("count")).first()[0]
    assert largest(dealt) < largest(first)
    got = {r.vec_id: (r.n_links, r.component_id) for r in ed.link_vectors(spark.createDataFrame(rows, SHAPE)).collect()}
    want = brute(rows)
    assert all(got[i][0] <= want[i][0] for i in want) and sum(v[0] for v in got.values()) >= 0.98 * sum(v[0] for v in want.values())


def test_odd_vectors(spark):
    v, w = [1.0, 2.0, 0.0], [0.0, 0.0, 3.0]
    rows = [(1, v, 0), (2, v, 0), (2, v, 0), (3, v, 1), (4, v, None), (5, None, 0), (6, [0.0] * 3, 0), (7, [1.0, None, 2.0], 0), (8, [1.0, math.inf, 0.0], 0), (9, w, 0), (None, v, 0), (10, [], 0), (11, [1.0, 2.0], 0), (12, [2.0, 4.0, 0.001], 0)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SHAPE + ", digest string, n_links int")
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in ed.link_vectors(df).collect()), key=repr)
    want = [(1, 2, 1, True), (2, 2, 1, False), (2, 2, 1, False), (12, 2, 1, False)] + [(i, 0, i, True) for i in (3, 4, 5, 6, 7, 8, 9, 10, 11)] + [(None, 0, None, False)]
    assert got == sorted(want, key=repr)
    assert ed.link_vectors(df.where("false")).count() == 0


def test_pruning_and_search():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 12))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    lists = ed.build_graph(x)
    assert ((lists >= -1) & (lists < 400)).all() and (lists != np.arange(400)[:, None]).all()
    q, p = ed.range_search(x, lists, x[:50], np.arange(50), 0.6)
    want = {(i, j) for i in range(50) for j in np.flatnonzero(x[i] @ x.T >= 0.6)}
    assert set(zip(q.tolist(), p.tolist(), strict=True)) <= want and len(q) >= 0.9 * len(want)
    q, _ = ed.range_search(x, lists, x[:5], np.full(5, -1), 0.999)
    assert set(q.tolist()) <= set(range(5))


def test_audit_sees_what_is_missing(spark):
    rows = make(3)
    ready = ed.prepare(spark.createDataFrame(rows, SHAPE), "vec_id", "embedding", "label")
    classes = ready.groupBy("digest", "label").agg(F.min("vec_id").alias("id"), F.countDistinct("vec_id").alias("mult"), F.first("vec").alias("vec")).cache()
    assert ed.audit(classes, spark.createDataFrame([], "id long, found long"), 0.93) == 0.0


def test_every_link_inside_a_component_counts_once_for_both_ends(spark, monkeypatch):
    monkeypatch.setattr(ed, "CLUSTER", 60)
    monkeypatch.setattr(ed, "PIECE", 50)
    monkeypatch.setattr(ed, "VISITED", 2)
    monkeypatch.setattr(ed, "BLOCK", 40, raising=False)
    rows = make(5)
    got = {r.vec_id: r for r in ed.link_vectors(spark.createDataFrame(rows, SHAPE)).collect()}
    x = np.array([r[1] for r in rows], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    component = np.array([got[r[0]].component_id for r in rows])
    linked = (x @ x.T >= 0.93) & (component[:, None] == component[None]) & ~np.eye(len(rows), dtype=bool)
    assert {r[0]: got[r[0]].n_links for r in rows} == {r[0]: int(n) for r, n in zip(rows, linked.sum(axis=1), strict=True)}


def pairs_across_clusters(n=1200, dim=48):
    """Unit vectors without structure; every twelfth has one near vector."""
    rng = np.random.default_rng(7)
    x = rng.normal(size=(n, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    noise = rng.normal(size=(n // 12, dim))
    near = x[: n // 12] + 0.33 * noise / np.linalg.norm(noise, axis=1, keepdims=True)
    return [(3 * i + 1, v.tolist(), 0) for i, v in enumerate(np.vstack([x, near]).astype(np.float32))]


@pytest.mark.parametrize("sample", [20_000, 900])
def test_low_recall_is_never_accepted(spark, monkeypatch, sample):
    """A search that stays in the nearest of many clusters misses links; with too little to judge on, it is not trusted."""
    monkeypatch.setattr(ed, "CLUSTER", 8)
    monkeypatch.setattr(ed, "VISITED", 1)
    monkeypatch.setattr(ed, "HELD", 1)
    monkeypatch.setattr(ed, "WIDENINGS", 0)
    monkeypatch.setattr(ed, "SAMPLE", sample)
    monkeypatch.setattr(ed, "RECALL", 0.999)
    rows = pairs_across_clusters()
    got = {r.vec_id: (r.n_links, r.component_id) for r in ed.link_vectors(spark.createDataFrame(rows, SHAPE)).collect()}
    assert got == brute(rows)


def test_recall_is_that_of_the_sparse_queries_too(spark):
    truth = {1: 1000, 2: 1, 3: 1, 4: 1, 5: 0}
    assert ed.recall(truth, spark.createDataFrame([(1, 1000)], "id long, found long")) == 0.25
    assert ed.recall(truth, spark.createDataFrame([(2, 1), (3, 1), (4, 1)], "id long, found long")) == 3 / 1003
    assert ed.recall({5: 0}, spark.createDataFrame([(5, 0)], "id long, found long")) == 1.0


def test_exact_comparison_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(ed, "BLOCK", 40)
    rows = make(2)
    ready = ed.prepare(spark.createDataFrame(rows, SHAPE), "vec_id", "embedding", "label")
    groups = ready.select(F.col("label").alias("key"), F.col("vec_id").alias("id"), F.lit(1).cast("long").alias("mult"), "vec")
    got = ed.compare(groups, 0.93, roots=True).groupBy("id").agg(F.sum("found").alias("n")).collect()
    assert {r.id: r.n for r in got} == {i: n for i, (n, _) in brute(rows).items()}


def test_rows_without_links_are_known_from_their_lists():
    rng = np.random.default_rng(8)
    x = rng.normal(size=(300, 24))
    x[:40] = x[40:80] + rng.normal(size=(40, 24)) * 0.2
    x[80:150] = x[150] + rng.normal(size=(70, 24)) * 0.1
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    lists = ed.build_graph(x)
    assert (ed.without_links(x, lists, 0.93) == ((x @ x.T >= 0.93).sum(axis=1) == 1)).all()
    assert ed.without_links(x[:1], ed.build_graph(x[:1]), 0.93).tolist() == [True]


def test_a_search_from_outside_sees_its_entry_points():
    """The first entry point stands in for the own row that a query from outside lacks; it may be the one in range."""
    rng = np.random.default_rng(9)
    x = rng.normal(size=(50, 12))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    entries = ed.entry_points(x)
    q, p = ed.range_search(x, ed.build_graph(x), x[entries], np.full(len(entries), -1), 0.999, entries=entries)
    assert list(zip(q.tolist(), p.tolist(), strict=True)) == list(enumerate(entries.tolist()))


def test_only_what_may_find_links_is_searched(spark, monkeypatch):
    """Of vectors in three clusters that each hold two thirds, those with links search the clusters that hold them."""
    monkeypatch.setattr(ed, "CLUSTER", 140)
    rows = [r for r in make(11) if r[2] == 0]
    rng = np.random.default_rng(12)
    rows += [(10_000 + i, rng.normal(size=16).astype(np.float32).tolist(), 0) for i in range(400 - len(rows))]
    ready = ed.prepare(spark.createDataFrame(rows, SHAPE), "vec_id", "embedding", "label")
    classes = ready.groupBy("digest", "label").agg(F.min("vec_id").alias("id"), F.countDistinct("vec_id").alias("mult"), F.first("vec").alias("vec")).cache()
    centroids = ed.fit_centroids(classes, classes.count())
    assert [len(c) for c in centroids.values()] == [3]
    few = ed.held_together(centroids, None)
    assert few == {("0", 16)} and ed.deal(classes, centroids, 3, few).count() == 2 * classes.count()
    assert ed.held_together(centroids, spark.createDataFrame([("0", 16)], "label string, dim int")) == frozenset()
    searched = ed.search(ed.shard(ed.deal(classes, centroids, 3, few)), ed.build(ed.shard(ed.deal(classes, centroids, 3, few))), 0.93, ed.BEAM)
    assert searched.count() == 2 * classes.count()
    got = {r.vec_id: (r.n_links, r.component_id) for r in ed.link_vectors(spark.createDataFrame(rows, SHAPE)).collect()}
    assert got == brute(rows)
