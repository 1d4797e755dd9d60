"""Token counts from flat token files.

A flat token file is nothing but ids, one document after the other, each closed by an end-of-document id:
no index, no lengths.  The scan cuts such files into blocks that ignore document boundaries, finds the
separators of every block by one vectorised search, and stitches the documents that cross blocks with a
prefix scan over the small summaries of the blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import map_slices, store, texts
from .tokens import encode, rank_encoder

#: Ids in a block.
BLOCK_IDS = 1 << 19
#: doc_ids in one row of the order list.
ORDER_ROWS = 4096

BLOCK_SCHEMA = "file_id string, block_no long, payload binary, doc_ids array<long>"


def write_flat(docs: DataFrame, rank_path: str, pattern: str, end_id: int, *, dtype: str = "<u2", block_ids: int = BLOCK_IDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes every whole text into flat token files, one a partition, kept in the shared folder.

    Rows with a ``payload`` are fixed-size cuts of the stream (the last one of a file may be shorter), taken
    without regard to documents.  Rows with ``doc_ids`` tell only the order in which documents were written,
    not where they lie.  A null text is an empty document: its separator alone.
    """
    if end_id > np.iinfo(dtype).max:
        raise ValueError(f"the end id {end_id} does not fit {dtype}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = rank_encoder(rank_path, pattern)
        name, width = f"{TaskContext.get().partitionId():08d}", np.dtype(dtype).itemsize
        waiting, order = bytearray(), []
        block_no = order_no = 0

        def row(no, payload, ids) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([no], pa.int64()), pa.array([payload], pa.binary()), pa.array([ids], pa.list_(pa.int64()))], names=["file_id", "block_no", "payload", "doc_ids"])

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                order.append(doc_id)
                waiting += np.asarray([*encode(encoder, text.as_py()), end_id], dtype=dtype).tobytes()
                while len(waiting) >= block_ids * width:
                    yield row(block_no, bytes(waiting[: block_ids * width]), None)
                    del waiting[: block_ids * width]
                    block_no += 1
                if len(order) == ORDER_ROWS:
                    yield row(order_no, None, order)
                    order, order_no = [], order_no + 1
        if waiting:
            yield row(block_no, bytes(waiting), None)
        if order:
            yield row(order_no, None, order)

    return store(map_slices(texts(docs, id_col, text_col), run, BLOCK_SCHEMA), "flat-tokens")


def read_flat(spark: SparkSession, path: str, *, dtype: str = "<u2", block_ids: int = BLOCK_IDS) -> DataFrame:
    """Blocks of raw token files (bytes and nothing else) under ``path``, which Spark's own reader opens.

    A file is read by one task; its length must be a whole number of ids.
    """
    size = np.dtype(dtype).itemsize * block_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = content.as_buffer()
                if len(data) % np.dtype(dtype).itemsize:
                    raise ValueError(f"{path}: {len(data)} bytes are no whole number of {dtype} ids")
                for no, start in enumerate(range(0, len(data), size)):
                    yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([no], pa.int64()), pa.array([data[start : start + size].to_pybytes()], pa.binary()), pa.array([None], pa.list_(pa.int64()))], names=["file_id", "block_no", "payload", "doc_ids"])

    return map_slices(spark.read.format("binaryFile").load(path).select("path", "content"), run, BLOCK_SCHEMA)


def scan_separators(blocks: DataFrame, end_id: int, *, dtype: str = "<u2") -> DataFrame:
    """One summary a block: n_ids, ends (positions of separators inside the block)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, ends = [], []
            for payload in batch.column(2):
                ids = np.frombuffer(payload.as_buffer(), dtype=dtype)
                sizes.append(len(ids))
                ends.append(np.flatnonzero(ids == end_id))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(ends, pa.list_(pa.int64()))], names=["file_id", "block_no", "n_ids", "ends"])

    return map_slices(blocks.where("payload is not null").select("file_id", "block_no", "payload"), run, "file_id string, block_no long, n_ids long, ends array<long>", 16)


def count_tokens(blocks: DataFrame, end_id: int, *, dtype: str = "<u2") -> DataFrame:
    """Documents of flat token files: file_id, ordinal (from 0), start, n_tokens (without the separator), ended.

    The prefix scan runs over one row a block: running sums give each block its first position and its first
    ordinal, a running maximum gives the last separator before it.  Ids behind a file's last separator form one
    open document (``ended`` false); empty documents count zero tokens; an empty file gives no row.
    """
    scanned = scan_separators(blocks, end_id, dtype=dtype)
    before = Window.partitionBy("file_id").orderBy("block_no").rowsBetween(Window.unboundedPreceding, -1)
    placed = (
        scanned.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))
        .withColumn("first_ordinal", F.coalesce(F.sum(F.size("ends")).over(before), F.lit(0)))
        .withColumn("last_end", F.when(F.size("ends") > 0, F.col("base") + F.element_at("ends", -1)))
        .withColumn("previous_end", F.coalesce(F.max("last_end").over(before), F.lit(-1)))
        .withColumn("is_last", F.row_number().over(Window.partitionBy("file_id").orderBy(F.desc("block_no"))) == 1)
    )
    closed = (
        placed.select("file_id", "base", "first_ordinal", "previous_end", "ends", F.posexplode("ends").alias("k", "at"))
        .select(
            "file_id",
            (F.col("first_ordinal") + F.col("k")).alias("ordinal"),
            (F.when(F.col("k") == 0, F.col("previous_end")).otherwise(F.col("base") + F.get("ends", F.col("k") - 1)) + 1).alias("start"),
            (F.col("base") + F.col("at")).alias("end"),
        )
        .select("file_id", "ordinal", "start", (F.col("end") - F.col("start")).alias("n_tokens"), F.lit(True).alias("ended"))
    )
    rest = placed.where("is_last").select(
        "file_id",
        (F.col("first_ordinal") + F.size("ends")).alias("ordinal"),
        (F.coalesce("last_end", "previous_end") + 1).alias("start"),
        (F.col("base") + F.col("n_ids") - F.coalesce("last_end", "previous_end") - 1).alias("n_tokens"),
        F.lit(False).alias("ended"),
    )
    return closed.unionByName(rest.where("n_tokens > 0"))


def count_document_tokens(docs: DataFrame, rank_path: str, pattern: str, end_id: int, *, dtype: str = "<u2", block_ids: int = BLOCK_IDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes ``docs`` as flat token files, scans them and names the documents: doc_id, n_tokens, file_id, start.

    One row per input row.  Null and empty texts count zero; repeated rows are counted one by one; a null doc_id
    is kept; an empty table gives no rows.
    """
    flat = write_flat(docs, rank_path, pattern, end_id, dtype=dtype, block_ids=block_ids, id_col=id_col, text_col=text_col)
    counted = count_tokens(flat, end_id, dtype=dtype)
    order = (
        flat.where("doc_ids is not null")
        .select("file_id", (F.col("block_no") * ORDER_ROWS).alias("first"), F.posexplode("doc_ids").alias("k", "doc_id"))
        .select("file_id", (F.col("first") + F.col("k")).alias("ordinal"), "doc_id")
    )
    return order.join(counted, ["file_id", "ordinal"]).select("doc_id", "n_tokens", "file_id", "start")
