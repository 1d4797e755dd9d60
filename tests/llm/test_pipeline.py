import os

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from twinmark.llm import importance, near_dedup, packing, quality_rules, registry
from twinmark.llm.common import table

from .test_near_dedup import brute

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the given tables are not here")


def comparable(columns, values):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted((tuple(r[k] for k in order) for r in values), key=repr)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    df = registry.queries()[name](spark, SF)
    want = con.execute(registry.oracle_sql()[name])
    assert comparable(df.columns, [tuple(r) for r in df.collect()]) == comparable([d[0] for d in want.description], want.fetchall())


def test_stages_against_brute_force(spark):
    docs = table(spark, SF, "documents")
    columns = docs.columns
    ruled = corpus_pipeline.quality_rule_stage(spark, docs, SF).cache()
    env = lambda text: dict(zip(quality_rules.MEASURES, quality_rules.measure(text), strict=True))
    fine = lambda text: not any(eval(c, env(text)) for _, c in quality_rules.RULES)  # noqa: E731, S307
    assert ruled.columns == columns and {r.doc_id for r in ruled.collect()} == {r.doc_id for r in docs.collect() if fine(r.text)}
    drawn = corpus_pipeline.quality_selection_stage(spark, ruled, SF).cache()
    good = {r.doc_id for r in table(spark, SF, "labels").where("quality = 1").collect()}
    before, after = {r.doc_id for r in ruled.collect()}, {r.doc_id for r in drawn.collect()}
    assert drawn.columns == columns and after <= before and len(before & good - after) <= 0.02 * len(before & good)
    single = corpus_pipeline.near_dedup_stage(spark, drawn, SF).cache()
    rows = [(r.doc_id, r.text) for r in drawn.collect()]
    assert single.columns == columns and {r.doc_id for r in single.collect()} == {d for d, _, c in brute(rows, 5) if d == c}
    packed = corpus_pipeline.packing_stage(spark, single, SF)
    assert {r.doc_id for r in packed.collect()} == {r.doc_id for r in single.collect()}


def test_run_applies_all_stages(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "quality_classifier", "near_dedup", "packing"]
    found = corpus_pipeline.run(spark, SF)
    assert {"doc_id", "piece", "sequence_id", "offset"} <= set(found.columns)
    assert found.select("doc_id").distinct().count() < table(spark, SF, "documents").count()
    assert near_dedup.WORDS == 5 and near_dedup.PERCENT == 80 and packing.CAPACITY == 1024


@pytest.mark.parametrize("kind", ["int", "double", "decimal(20,0)", "string"])
def test_selection_takes_ids_of_other_types(spark, kind):
    """Keys that were shifted outside may come as decimals or doubles; the same documents are drawn, with their ids as they came."""
    docs, labels = (table(spark, SF, name) for name in ("documents", "labels"))
    docs = docs.where("doc_id < 60").unionByName(docs.where("doc_id < 60").selectExpr("doc_id + 1000 as doc_id", "reverse(text) as text", "lang", "source", "n_chars"))
    other = docs.withColumn("doc_id", F.col("doc_id").cast(kind))
    found = importance.keep_documents(other, other, labels)
    assert found.schema == other.schema
    want = sorted((r.doc_id, r.text) for r in importance.keep_documents(docs, docs, labels).collect())
    assert 0 < len(want) < docs.count() and sorted((int(r.doc_id), r.text) for r in found.collect()) == want
