"""Linking a stream of new records with those that came before, batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import vocab
from ..functions.attributes import enrich
from ..operators import blocking, classic, evidence, results
from ..operators.decisions import scan_mode
from ..operators.reuse import reused
from ..sources.ingest import with_description


def earlier_records(spark: SparkSession, path: str, batch_id: int) -> DataFrame | None:
    """Enriched records of the batches before this one; None if there are none yet."""
    try:
        return spark.read.option("mergeSchema", True).parquet(f"{path}/records").where(F.col("batch_id") < batch_id).drop("batch_id")
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return None


def link_batch(batch: DataFrame, batch_id: int, path: str, fields=(), *, engine: str = "classic", mode: str | None = None, threshold: float = 75.0) -> None:
    """Stores the records of a batch and the candidates that hold at least one of them.

    Records are enriched once, when they come, and stored so.  Earlier ones take part only if they share a block key
    with the batch.  The output of a batch replaces what an
    earlier try of the same batch wrote, so a restarted stream leaves every candidate once.
    """
    spark, mode = batch.sparkSession, scan_mode(mode)
    cross_site = mode != vocab.SCAN_MODES[0]
    fresh = reused(with_description(batch), "batch")
    enrich(fresh).write.mode("overwrite").parquet(f"{path}/records/batch_id={batch_id}")
    own = spark.read.parquet(f"{path}/records/batch_id={batch_id}").withColumn("is_new", F.lit(True))
    old = earlier_records(spark, path, batch_id)
    if old is not None:
        keys = blocking.blocks(own, fields).select("key").distinct()
        near = blocking.blocks(old, fields).join(keys, "key", "left_semi").select("rec_idx").distinct()
        own = own.unionByName(old.join(near, "rec_idx", "left_semi").withColumn("is_new", F.lit(False)), allowMissingColumns=True)
    own = reused(own, "batch-records")
    flags = own.select("rec_idx", "is_new")
    pairs = blocking.limited_pairs(own, fields, cross_site=cross_site)[0]
    pairs = pairs.join(flags.toDF("idx_a", "new_a"), "idx_a").join(flags.toDF("idx_b", "new_b"), "idx_b").where("new_a or new_b").select("idx_a", "idx_b")
    decided = classic.decide(pairs, own, fields, mode) if engine == "classic" else evidence.decide(pairs, own, fields, cross_site, mode)
    results.kept(results.candidates(decided), threshold).write.mode("overwrite").parquet(f"{path}/candidates/batch_id={batch_id}")


def link_stream(records: DataFrame, path: str, checkpoint: str, fields=(), *, trigger: dict | None = None, **options) -> StreamingQuery:
    """Starts a stream that links every batch of ``records`` (with a unique rec_idx) into the tables under ``path``."""
    step = lambda batch, batch_id: link_batch(batch, batch_id, path, fields, **options)
    writer = records.writeStream.option("checkpointLocation", checkpoint).foreachBatch(step)
    return writer.trigger(**(trigger or {"availableNow": True})).start()
