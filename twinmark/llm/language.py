"""Language identification by a byte convolutional network, trained and run in numpy.

Bytes are embedded, filters of several widths slide over fixed-length windows, each filter keeps its maximum
over the window, and a softmax layer reads the maxima.  A text is cut into windows from end to end; its
prediction is the mean of its windows' log-probabilities, weighted by their bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, map_slices, sampled_ids, store, texts

WIDTHS, FILTERS, EMBEDDING = (2, 3, 4), 12, 8
WINDOW = 256
#: Windows of one matrix product: bounds memory whatever the length of a text.
BLOCK = 128
#: Labelled documents that the network is trained on at most, and windows taken of each.
LABELLED, WINDOWS_EACH, EPOCHS, RATE = 4000, 4, 8, 0.01
FOLDS, HELD_OUT = 4, 2
UNKNOWN = "und"


@dataclass
class Network:
    classes: list[str]
    embedding: np.ndarray
    filters: np.ndarray
    bias: np.ndarray
    output: np.ndarray
    output_bias: np.ndarray

    def pooled(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Columns (n, WINDOW, widest * EMBEDDING) and filter responses of windows of bytes."""
        widest = max(WIDTHS)
        padded = np.zeros((len(windows), WINDOW + widest - 1), np.uint8)
        padded[:, :WINDOW] = windows
        codes = self.embedding[padded]
        columns = np.concatenate([codes[:, j : j + WINDOW] for j in range(widest)], axis=2)
        return columns, columns.reshape(-1, widest * EMBEDDING) @ self.filters

    def log_probabilities(self, windows: np.ndarray) -> np.ndarray:
        _, response = self.pooled(windows)
        top = np.maximum(response.reshape(len(windows), WINDOW, -1).max(axis=1) + self.bias, 0)
        logits = top @ self.output + self.output_bias
        logits -= logits.max(axis=1, keepdims=True)
        return logits - np.log(np.exp(logits).sum(axis=1, keepdims=True))


def cut_windows(raw: bytes) -> np.ndarray:
    """All of a text in windows of WINDOW bytes, the last one padded with zeros."""
    n = -(-len(raw) // WINDOW)
    windows = np.zeros(n * WINDOW, np.uint8)
    windows[: len(raw)] = np.frombuffer(raw, np.uint8)
    return windows.reshape(n, WINDOW)


def start_network(classes: list[str], dtype=np.float32) -> Network:
    random, widest, n = np.random.default_rng(3), max(WIDTHS), len(WIDTHS) * FILTERS
    return Network(
        classes,
        random.normal(0, 0.5, (256, EMBEDDING)).astype(dtype),
        (random.normal(0, 0.3, (widest * EMBEDDING, n)) * reach()).astype(dtype),
        np.zeros(n, dtype),
        random.normal(0, 0.2, (n, len(classes))).astype(dtype),
        np.zeros(len(classes), dtype),
    )


def reach() -> np.ndarray:
    """Which rows of a column each filter reads: those of as many bytes as it is wide."""
    return (np.repeat(np.arange(max(WIDTHS)), EMBEDDING)[:, None] < np.repeat(WIDTHS, FILTERS)[None, :]).astype(np.float32)


def gradients(net: Network, x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
    """Gradients of the mean cross entropy of labelled windows, for embedding, filters, bias, output and output bias."""
    widest, rows = max(WIDTHS), np.arange(len(x))
    columns, response = net.pooled(x)
    response = response.reshape(len(x), WINDOW, -1)
    place = response.argmax(axis=1)
    top = np.take_along_axis(response, place[:, None, :], axis=1)[:, 0] + net.bias
    hidden = np.maximum(top, 0)
    logits = hidden @ net.output + net.output_bias
    logits -= logits.max(axis=1, keepdims=True)
    share = np.exp(logits)
    share /= share.sum(axis=1, keepdims=True)
    share[rows, y] -= 1
    share /= len(x)
    back = (share @ net.output.T) * (top > 0)
    seen = columns[rows[:, None], place]  # (n, filters, widest * EMBEDDING)
    d_filters = np.einsum("nf,nfc->cf", back, seen) * reach()
    d_columns = (back[:, :, None] * (net.filters * reach()).T[None]).reshape(len(x), top.shape[1], widest, EMBEDDING)
    d_embedding = np.zeros_like(net.embedding)
    padded = np.zeros((len(x), WINDOW + widest - 1), np.uint8)
    padded[:, :WINDOW] = x
    for j in range(widest):
        np.add.at(d_embedding, padded[rows[:, None], place + j], d_columns[:, :, j])
    return [d_embedding, d_filters, back.sum(axis=0), hidden.T @ share, share.sum(axis=0)]


def train(windows: np.ndarray, answers: np.ndarray, classes: list[str], epochs: int = EPOCHS) -> Network:
    """Fits the network by Adam on labelled windows."""
    random, net = np.random.default_rng(4), start_network(classes)
    values = [net.embedding, net.filters, net.bias, net.output, net.output_bias]
    first, second, step = [np.zeros_like(v) for v in values], [np.zeros_like(v) for v in values], 0
    for _ in range(epochs):
        order = random.permutation(len(windows))
        for start in range(0, len(order), BLOCK):
            batch = order[start : start + BLOCK]
            step += 1
            for k, gradient in enumerate(gradients(net, windows[batch], answers[batch])):
                first[k] += 0.1 * (gradient - first[k])
                second[k] += 0.001 * (gradient**2 - second[k])
                values[k] -= RATE * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-7)
    return net


def training_windows(docs: DataFrame, most: int) -> DataFrame:
    """(lang, window) of at most ``most`` labelled documents outside the held-out fold, from random places of each text.

    Half of the windows are shortened, so that the network also learns short texts.  Of rows that repeat an id with
    other texts one is taken, and copies of a row give its windows once, so that the rows are bounded.
    """
    labelled = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & (fold("doc_id", FOLDS) != HELD_OUT)).withColumn("own", F.xxhash64("lang", "text"))
    ids = labelled.groupBy("doc_id").agg(F.min("own").alias("own"))
    sample = store(sampled_ids(ids, "doc_id", most, "own"), "language-sample")  # bounded by ``most``, so it may be broadcast

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, windows = [], []
            for doc_id, lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                raw, random = (text.as_py() or "").encode(), np.random.default_rng(doc_id & 0xFFFFFFFF)
                for k in range(WINDOWS_EACH if raw else 0):
                    size = WINDOW if k % 2 else int(random.integers(24, WINDOW))
                    start = int(random.integers(0, max(1, len(raw) - size + 1)))
                    langs.append(lang)
                    windows.append(raw[start : start + size].ljust(WINDOW, b"\0"))
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(windows, pa.binary())], names=["lang", "window"])

    return map_slices(labelled.join(F.broadcast(sample), ["doc_id", "own"], "left_semi").select("doc_id", "lang", "text"), run, "lang string, window binary").distinct()


def fit(docs: DataFrame, most: int = LABELLED) -> Network | None:
    """Trains on text and non-null ``lang`` outside the held-out fold; None if nothing is labelled."""
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    rows = training_windows(named, most).toPandas().sort_values(["lang", "window"], kind="stable")
    if rows.empty:
        return None
    classes = sorted(rows["lang"].unique())
    windows = np.frombuffer(b"".join(rows["window"]), np.uint8).reshape(-1, WINDOW)
    return train(windows, np.searchsorted(classes, rows["lang"].to_numpy(dtype=str)), list(classes))


def predict_batch(net: Network, values: list[str | None]) -> tuple[list[str], list[float]]:
    """Language and score of each text.  Windows of all texts are run through the network in blocks."""
    names, scores = [UNKNOWN] * len(values), [0.0] * len(values)
    sums, sizes = np.zeros((len(values), len(net.classes))), np.zeros(len(values))
    waiting: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    count = 0

    def flush() -> None:
        nonlocal count
        if not waiting:
            return
        windows, owner, weight = (np.concatenate(part) for part in zip(*waiting, strict=True))
        for start in range(0, len(windows), BLOCK):
            part = slice(start, start + BLOCK)
            np.add.at(sums, owner[part], net.log_probabilities(windows[part]) * weight[part, None])
        waiting.clear()
        count = 0

    for k, text in enumerate(values):
        if not text or not any(map(str.isalpha, text)):
            continue
        raw = text.encode()
        sizes[k] = len(raw)
        for start in range(0, len(raw), WINDOW * 4096):
            windows = cut_windows(raw[start : start + WINDOW * 4096])
            weight = np.full(len(windows), WINDOW, float)
            weight[-1] = min(len(raw) - start, WINDOW * 4096) - WINDOW * (len(windows) - 1)
            waiting.append((windows, np.full(len(windows), k), weight))
            count += len(windows)
            if count >= 4096:
                flush()
    flush()
    known = np.flatnonzero(sizes)
    if len(known):
        mean = sums[known] / sizes[known, None]
        share = np.exp(mean - mean.max(axis=1, keepdims=True))
        share /= share.sum(axis=1, keepdims=True)
        for k, row in zip(known, share, strict=True):
            names[k], scores[k] = net.classes[int(row.argmax())], float(row.max())
    return names, scores


def identify(docs: DataFrame, *, net: Network | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred, score of every whole text, one row per input row.

    Without ``net`` one is fitted on ``docs``, which then need a ``lang`` column.  Null texts, texts without a letter
    and all texts if nothing is labelled get ``und`` and score 0.  Repeated rows get equal predictions; a null
    doc_id is kept and not held out; other columns are ignored; an empty table gives no rows.
    """
    net = net or fit(docs)
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(1).to_pylist()
            names, scores = predict_batch(shared.value, values) if shared.value else ([UNKNOWN] * len(values), [0.0] * len(values))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    held_out = F.coalesce(fold("doc_id", FOLDS) == HELD_OUT, F.lit(False))
    return map_slices(texts(docs, id_col, text_col), run, "doc_id long, lang_pred string, score double").select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
