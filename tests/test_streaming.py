from twinmark.plans.scan import run_scan
from twinmark.sources.ingest import synthetic
from twinmark.streaming.incremental import link_batch, link_stream


def test_stream_finds_what_a_scan_finds(spark, tmp_path):
    records = synthetic(spark, 60, seed=5)
    for k in range(3):
        records.where(f"rec_idx % 3 = {k}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(records.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = str(tmp_path / "out")
    query = link_stream(stream, out, str(tmp_path / "checkpoint"), ["UNIT_MEAS"], threshold=70)
    query.awaitTermination()
    assert spark.read.parquet(f"{out}/records").count() == 60
    want = {(r.idx_a, r.idx_b, r.similarity_score) for r in run_scan(records, ["UNIT_MEAS"], threshold=70).candidates.collect()}
    seen = lambda: sorted((r.idx_a, r.idx_b, r.similarity_score) for r in spark.read.parquet(f"{out}/candidates").collect())
    assert want and seen() == sorted(want)
    last = spark.read.parquet(f"{out}/records").where("batch_id = 2").drop("batch_id")
    link_batch(last.select(*records.columns).cache(), 2, out, ["UNIT_MEAS"], threshold=70)  # a second try changes nothing
    assert seen() == sorted(want)
