"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..workers import ship

#: Rows that a function of ``map_slices`` gets at a time: bounds what it makes of them.
SLICE_ROWS = 500


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Reads one input table through Spark's own reader, whatever store it lies in."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def map_slices(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema, rows: int = SLICE_ROWS) -> DataFrame:
    """``mapInArrow`` with a function that gets slices of at most ``rows`` rows, in workers that get this package.

    Spark bounds the batches that it sends by bytes (64 MB, or one row that is longer) and by rows; the slices are views
    of them.  No setting of the session is touched.
    """
    ship(df.sparkSession)

    def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batch.slice(k, rows) for batch in batches for k in range(0, batch.num_rows, rows))
        give_back_memory()

    return df.mapInArrow(sliced, schema)


def give_back_memory() -> None:
    """Returns freed memory to the system, so that workers that wait for their next task stay small."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)


def shared_dir(spark: SparkSession) -> str:
    """The folder for intermediate tables that the driver and all executors share.

    It is the one that the cluster names in ``spark.checkpoint.dir``.  Only a session
    on a single machine may do without; it gets a temporary folder.
    """
    sc = spark.sparkContext
    found = sc.getCheckpointDir()
    if found is None:
        named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
        if not named:
            if not sc.master.split("[")[0] == "local":
                raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
            named = tempfile.mkdtemp(prefix="twinmark-checkpoint-")
        sc.setCheckpointDir(named)
        found = sc.getCheckpointDir()
    return found


def store(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` as a table into the shared folder and reads it back.

    This cuts the lineage: the rows survive lost executors and are computed once.
    The files stay until the shared folder is cleaned, as files of ``checkpoint()`` do.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id and the text, under names of our own, so other columns cannot clash."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def fold(id_col: str, parts: int):
    """crc32 of the id written as text, modulo ``parts``: the fold of a row; a null id has a null fold."""
    return F.crc32(F.col(id_col).cast("string")) % parts


def sampled_ids(df: DataFrame, id_col: str, most: int, *carry: str) -> DataFrame:
    """At most ``most`` rows of (id, carry...), picked by hash order of the id; used to fit models only."""
    return (
        df.select(F.col(id_col), *[F.col(c) for c in carry])
        .orderBy(F.xxhash64(F.col(id_col)), F.col(id_col), *[F.col(c) for c in carry])
        .limit(most)
    )


#: Bits of the map of ``perhaps_among``: 4 MB, whatever the corpus.
MAP_BITS = 1 << 25


def perhaps_among(df: DataFrame, col: str, ids: DataFrame, flag: str = "__perhaps") -> DataFrame:
    """Adds a flag that is false only where a long column is surely not among the ids (first column of ``ids``).

    A map of hashed bits, of one fixed size, is made of all ids and broadcast.  Where it says no, a row need not be
    shuffled to be joined with them; the more ids there are, the less it saves, and it never decides alone.
    """
    slot = lambda c: F.pmod(F.xxhash64(F.col(c).cast("long"), F.lit(5)), F.lit(MAP_BITS))
    name = ids.columns[0]
    bits = ids.select(slot(name).alias("s")).groupBy(F.bitmap_bucket_number("s").alias("__bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("s")).alias("__bits"))
    place = F.bitmap_bit_position(slot(col))
    byte = F.conv(F.hex(F.substring(F.col("__bits"), (F.shiftright(place, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    hit = F.call_function("shiftright", byte, place.bitwiseAND(F.lit(7)).cast("int")).bitwiseAND(F.lit(1)) == 1
    joined = df.withColumn("__bucket", F.bitmap_bucket_number(slot(col))).join(F.broadcast(bits), "__bucket", "left")
    return joined.select(*[F.col(f"`{c}`") for c in df.columns], F.coalesce(hit, F.lit(False)).alias(flag))
