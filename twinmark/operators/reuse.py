"""Intermediate rows that several branches of a plan read."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Records that may be broadcast to the pairs: so many rows, and so many characters of all that is sent, at most.
BROADCAST_ROWS, BROADCAST_CHARS = 100_000, 32_000_000


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share; a session on a single machine may do without one."""
    sc = spark.sparkContext
    folder = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if sc.master.split("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="twinmark-")
    return f"{folder}/{name}-{uuid.uuid4().hex}"


def reused(df: DataFrame, name: str = "reused") -> DataFrame:
    """Computes ``df`` once.

    Where the cluster names a shared folder in spark.checkpoint.dir the rows are written there as a table, which
    also cuts the lineage and survives lost executors; elsewhere they are cached and can be computed again.
    """
    spark = df.sparkSession
    folder = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        return df.persist()
    path = f"{folder}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def few_records(enriched: DataFrame) -> bool:
    """Whether enriched records are counted to be few enough for a broadcast join; else they are joined by shuffles.

    Measured once a DataFrame, over all columns, on rows that ``reused`` has computed anyway.
    """
    known = getattr(enriched, "_few_records", None)
    if known is None:
        row = enriched.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length(F.to_json(F.struct("*")))), F.lit(0))).first()
        known = enriched._few_records = row[0] <= BROADCAST_ROWS and row[1] <= BROADCAST_CHARS
    return known


def shuffled(df: DataFrame) -> DataFrame:
    """A side of a join that must not be broadcast.

    Spark judges a table by its files.  Those of ``reused`` are small where rows repeat much, whatever the rows take when
    they are sent, so by itself it broadcasts tables that the driver's memory cannot hold.
    """
    return df.hint("merge")


def hinted(measured: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """How rows of a table are joined: broadcast if it has ``few_records``, else by shuffles, never by a guess."""
    return F.broadcast if few_records(measured) else shuffled
