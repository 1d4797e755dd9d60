"""Quality selection by importance resampling.

Two bags of hashed byte n-grams model the wanted text (documents labelled good) and the raw corpus.  The ratio of
both models is a document's importance weight; adding Gumbel noise to the logarithm and taking the k largest keys
draws k documents without replacement in proportion to their weights.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_slices, sampled_ids, store

BITS = 14
ORDERS = (2, 3)
#: Labelled documents that the target model and the threshold are fitted on, at most.
LABELLED = 20_000
#: Weights are those of a document of this many n-grams, so that long texts do not outweigh short ones.
LENGTH = 200.0
#: Bytes of a text that are turned into n-grams at a time.
CHUNK = 1 << 20
#: The cut: this share of the way from the lowest good documents to the middle of the bad ones.
LOWEST, TOWARDS_BAD, WITHOUT_BAD = 0.001, 0.1, 20.0
SEED = 7


def grams(raw: bytes) -> Iterator[np.ndarray]:
    """Buckets of all byte n-grams of a text, in chunks that overlap so that none is lost or counted twice."""
    longest = max(ORDERS)
    for start in range(0, max(len(raw), 1), CHUNK):
        block = np.frombuffer(raw, np.uint8, min(CHUNK + longest - 1, len(raw) - start), start).astype(np.uint32)
        code = block
        for n in range(2, longest + 1):
            if len(block) < n:
                break
            code = (code[:-1] * np.uint32(0x01000193)) ^ block[n - 1 :]
            if n in ORDERS:
                found = (code * np.uint32(2654435769) + np.uint32(n)) >> np.uint32(32 - BITS)
                yield found[:CHUNK]


def gram_counts(raw: bytes) -> np.ndarray:
    total = np.zeros(1 << BITS, np.int64)
    for found in grams(raw):
        total += np.bincount(found, minlength=1 << BITS)
    return total


@dataclass
class Model:
    """Log ratio of target and raw probability by bucket, and the log weight from which a document counts as wanted."""

    ratio: np.ndarray
    cut: float

    def weigh(self, raw: bytes) -> tuple[int, float]:
        """(n-grams, log weight); a text without n-grams has the weight 1."""
        n, total = 0, 0.0
        for found in grams(raw):
            n += len(found)
            total += float(self.ratio[found].sum())
        return n, LENGTH * total / n if n else 0.0


def noise(doc_id: int | None, raw: bytes) -> float:
    """Standard Gumbel noise, fixed by seed, id and text."""
    bits = xxhash.xxh3_64_intdigest(raw, seed=(SEED + 31 * (doc_id or 0)) & 0xFFFFFFFFFFFFFFFF)
    return -float(np.log(-np.log(((bits >> 11) + 0.5) / 2.0**53)))


def count_grams(docs: DataFrame, sample: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Bucket counts of the good sample and of all documents; one row a bucket reaches the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target, everything = np.zeros(1 << BITS, np.int64), np.zeros(1 << BITS, np.int64)
        for batch in batches:
            for text, good in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                counts = gram_counts((text.as_py() or "").encode())
                everything += counts
                if good == 1:
                    target += counts
        at = np.flatnonzero(everything)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(target[at]), pa.array(everything[at])], names=["bucket", "target", "everything"])

    marked = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id", "left").select("text", "quality")
    rows = map_slices(marked, run, "bucket int, target long, everything long").groupBy("bucket").agg(F.sum("target").alias("t"), F.sum("everything").alias("e")).toPandas()
    target, everything = np.zeros(1 << BITS), np.zeros(1 << BITS)
    target[rows["bucket"]], everything[rows["bucket"]] = rows["t"], rows["e"]
    return target, everything


def fit(docs: DataFrame, labels: DataFrame, most: int = LABELLED) -> Model:
    """Fits both models: the target on at most ``most`` labelled documents, the raw one on all of ``docs``.

    Labels without an id or a quality are ignored, of several for one id the largest counts.  Without good labels
    every weight is 1 and every document is wanted.
    """
    spark = docs.sparkSession
    clean = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").cast("int").alias("quality"))
    sample = store(sampled_ids(clean, "doc_id", most, "quality"), "labelled")  # bounded by ``most``, so it may be broadcast
    target, everything = count_grams(docs, sample)
    if not target.sum():
        return Model(np.zeros(1 << BITS), 0.0)
    log = lambda counts: np.log((counts + 0.5) / (counts.sum() + 0.5 * len(counts)))
    model = Model(log(target) - log(everything), 0.0)
    shared = spark.sparkContext.broadcast(model.ratio)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(shared.value, 0.0)
        for batch in batches:
            weights = [own.weigh((text.as_py() or "").encode())[1] for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(weights, pa.float64()), batch.column(2)], names=["doc_id", "weight", "quality"])

    # one row for each sampled id, of rows that repeat it the least weight, so that the cut is fixed and what is collected bounded
    weighed = map_slices(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(sample), "doc_id"), run, "doc_id long, weight double, quality int")
    seen = weighed.groupBy("doc_id").agg(F.min("weight").alias("weight"), F.max("quality").alias("quality")).toPandas()
    good, bad = seen["weight"][seen["quality"] == 1], seen["weight"][seen["quality"] != 1]
    low = float(np.quantile(good, LOWEST)) if len(good) else 0.0
    middle = float(np.median(bad)) if len(bad) else low - WITHOUT_BAD / TOWARDS_BAD
    model.cut = low - TOWARDS_BAD * max(low - middle, 0.0)
    return model


def weigh(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_grams, log_weight and sample_key (log weight plus Gumbel noise) of every whole text; narrow."""
    shared = docs.sparkSession.sparkContext.broadcast(model.ratio)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(shared.value, 0.0)
        for batch in batches:
            sizes, weights, keys = [], [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = (text.as_py() or "").encode()
                n, weight = own.weigh(raw)
                sizes.append(n)
                weights.append(weight)
                keys.append(weight + noise(doc_id, raw))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(weights, pa.float64()), pa.array(keys, pa.float64())], names=["doc_id", "n_grams", "log_weight", "sample_key"])

    return map_slices(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), run, "doc_id long, n_grams long, log_weight double, sample_key double")


def kth_largest(rows: DataFrame, column: str, k: int, bins: int = 4096, few: int = 1000) -> float:
    """The k-th largest value of a column, exactly, by narrowing histograms; at most ``bins`` rows a pass are collected."""
    low, high = rows.agg(F.min(column), F.max(column)).first()
    inside = rows.select(F.col(column).alias("x"))
    while True:
        if low == high:
            return high
        width = (high - low) / bins
        bucket = F.least(F.floor((F.col("x") - F.lit(low)) / F.lit(width)), F.lit(bins - 1)) if width > 0 else F.lit(0)
        counts = inside.groupBy(bucket.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("low"), F.max("x").alias("high")).collect()
        for row in sorted(counts, key=lambda r: -r["bin"]):
            if k <= row["n"]:
                break
            k -= row["n"]
        low, high = row["low"], row["high"]
        inside = inside.where((F.col("x") >= F.lit(low)) & (F.col("x") <= F.lit(high)))
        if row["n"] <= few:
            return sorted((r["x"] for r in inside.collect()), reverse=True)[k - 1]


def least_key(weighed: DataFrame, model: Model, k: int | None = None) -> float:
    """The key from which documents are drawn: that of the k-th largest.

    Without ``k``, as many are drawn as have a log weight of at least the model's cut.  Equal keys at the end are
    all drawn.
    """
    if k is None:
        k = weighed.where(F.col("log_weight") >= F.lit(model.cut)).count()
    return kth_largest(weighed, "sample_key", k) if k else float("inf")


def select(docs: DataFrame, labels: DataFrame, k: int | None = None) -> DataFrame:
    """doc_id, n_grams, log_weight, sample_key, kept: one row per input row.

    Null and empty texts have no n-grams and the weight 1.  Repeated rows get equal keys and stand or fall
    together; a null doc_id is kept; columns other than doc_id and text are ignored; an empty table gives no rows.
    """
    model = fit(docs, labels)
    weighed = store(weigh(docs, model), "weights")
    edge = least_key(weighed, model, k) if not weighed.isEmpty() else float("inf")
    return weighed.withColumn("kept", F.col("sample_key") >= F.lit(edge))


def keep_documents(docs: DataFrame, corpus: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are drawn, with all columns; the models come from the whole ``corpus``.

    As in ``select``: null and empty texts have the weight 1, repeated rows stand or fall together, rows without an id
    are drawn like others, ids of other types than long count as the same numbers and come back as they were, columns
    other than doc_id and text travel along whatever their names, empty ``docs`` give no rows, and without good labels
    every row stays.
    """
    model = fit(corpus, labels)
    weighed = store(weigh(docs, model), "weights")
    edge = least_key(weighed, model) if not weighed.isEmpty() else float("inf")
    shared = docs.sparkSession.sparkContext.broadcast(model.ratio)
    text_at, last = docs.columns.index("text"), len(docs.columns)
    # the id as a long, as ``weigh`` takes it; ids may be of any type that casts, and its name is longer than any other
    numbered = docs.withColumn("_" * (1 + max(map(len, docs.columns))), F.col("doc_id").cast("long"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(shared.value, 0.0)
        for batch in batches:
            ok = []
            for doc_id, text in zip(batch.column(last).to_pylist(), batch.column(text_at), strict=True):
                raw = (text.as_py() or "").encode()
                ok.append(own.weigh(raw)[1] + noise(doc_id, raw) >= edge)
            yield batch.select(list(range(last))).filter(pa.array(ok, pa.bool_()))

    return map_slices(numbered, run, docs.schema)
