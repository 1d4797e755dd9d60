"""Best-fit packing of documents into sequences of fixed capacity.

How well pieces fit together depends on their lengths alone, and there are no more lengths than the capacity.
So the plan is made from the histogram of lengths (as many rows as the capacity at most, whatever the corpus),
and the pieces then look up their places by their rank among the pieces of the same length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_slices, store, texts
from .tokens import added_tokens, encode, same_ids, vocabulary_encoder, vocabulary_tokenizer

CAPACITY = 1024
END_ID = 2

PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long, part long, local_rank long"


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` ids: one if they fit, else full pieces behind a first one that may be shorter."""
    if n <= capacity:
        return [(0, n)]
    first = n % capacity or capacity
    return [(0, first)] + [(start, capacity) for start in range(first, n, capacity)]


def tokenize_pieces(docs: DataFrame, json_path: str, pattern: str, *, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of every whole text (null: empty), stored in the shared folder.

    ``part`` and ``local_rank`` number the pieces of equal length inside a task, so that ranks over the whole
    corpus need only counts.  Ids are those of the ``tokenizers`` file.  Where the file proves that an encoder built
    from its vocabulary gives the same ids, several times faster, that one is used; texts that hold an added token of
    the file, and all texts of other files, go to the library.
    """
    proven = same_ids(json_path, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fast = vocabulary_encoder(json_path, pattern) if proven else None
        part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        added = added_tokens(json_path)
        exact = lambda text: vocabulary_tokenizer(json_path).encode(text, add_special_tokens=False).ids if text else []
        find = lambda text: encode(fast, text) if proven and not (added and text and added.search(text)) else exact(text)
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.asarray([*find(text.as_py()), end_id], dtype="<u4")
                for k, (start, length) in enumerate(cut(len(ids), capacity)):
                    rows.append((doc_id, k, start, length, zlib.crc32(ids[start : start + length].tobytes()), part, int(seen[length])))
                    seen[length] += 1
            columns = list(zip(*rows, strict=True)) or [()] * 7
            kinds = [pa.int64(), pa.int32(), *[pa.int64()] * 5]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32", "part", "local_rank"])

    return store(map_slices(texts(docs, id_col, text_col), run, PIECE_SCHEMA), "pieces")


def plan_bins(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Rows (length, first_rank, end_rank, first_bin, offset): ranks first_rank.. of a length lie in bins first_bin.. at offset.

    Lengths above a third of the capacity come first, the longest before the others.  At most two of them share a
    bin: each is matched greedily with the longest other one that fits.  The smaller ones then go, longest first,
    to the tightest gap that holds them; a new bin is opened only where no gap does.  Bins of equal content are
    moved together, so the work depends on the number of lengths and not on the number of pieces.
    """
    left = {int(s): int(c) for s, c in histogram.items() if c > 0}
    if any(s <= 0 or s > capacity for s in left):
        raise ValueError("a length must lie between 1 and the capacity")
    used: dict[int, int] = dict.fromkeys(left, 0)
    plan: list[tuple[int, int, int, int, int]] = []
    gaps: dict[int, list[tuple[int, int]]] = {}  # gap -> runs of bins (first, count)
    n_bins = 0

    def place(size: int, count: int, first_bin: int, offset: int) -> None:
        plan.append((size, used[size], used[size] + count, first_bin, offset))
        used[size] += count
        left[size] -= count

    def open_gap(gap: int, first: int, count: int) -> None:
        if gap and count:
            gaps.setdefault(gap, []).append((first, count))

    large = sorted((s for s in left if 3 * s > capacity), reverse=True)
    for size in large:
        for partner in [p for p in large if p <= size and p + size <= capacity]:
            count = min(left[size], left[partner]) if partner != size else left[size] // 2
            if count:
                place(size, count, n_bins, 0)
                place(partner, count, n_bins, size)
                open_gap(capacity - size - partner, n_bins, count)
                n_bins += count
            if not left[size]:
                break
        if left[size]:
            open_gap(capacity - size, n_bins, left[size])
            first, count = n_bins, left[size]
            n_bins += count
            place(size, count, first, 0)

    for size in sorted((s for s in left if 3 * s <= capacity), reverse=True):
        while left[size]:
            fitting = [g for g in gaps if g >= size]
            if not fitting:
                bins = -(-left[size] // (capacity // size))
                gaps[capacity] = [(n_bins, bins)]
                n_bins += bins
                continue
            gap = min(fitting)
            runs = gaps[gap]
            first, count = runs.pop()
            if not runs:
                del gaps[gap]
            deep = min(gap // size, -(-left[size] // count))
            for k in range(deep):  # as one by one: a bin that got a piece is the tightest until it is full
                taken = min(count, left[size])
                if taken < count:
                    open_gap(gap - k * size, first + taken, count - taken)
                    count = taken
                place(size, taken, first, capacity - gap + k * size)
            open_gap(gap - deep * size, first, count)
    return plan


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to pieces that carry length, part and local_rank.

    The histogram (one row a length) goes to the driver and the plan back; its size depends on the capacity
    alone.  Ranks come from counts by task: each piece is joined with the count of equal lengths in earlier tasks.
    """
    counts = pieces.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("length", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    plan = np.asarray(sorted(plan_bins(histogram, capacity)), dtype=np.int64).reshape(-1, 5)
    rows = {int(size): plan[plan[:, 0] == size] for size in np.unique(plan[:, 0])}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for size in np.unique(length):
                at, own = np.flatnonzero(length == size), rows[int(size)]
                k = np.searchsorted(own[:, 1], rank[at], side="right") - 1
                sequence[at], offset[at] = own[k, 3] + rank[at] - own[k, 1], own[k, 4]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    ranked = pieces.join(bases, ["length", "part"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("local_rank")).alias("rank"))
    return map_slices(ranked, run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long", 10_000)


def pack_documents(docs: DataFrame, json_path: str, pattern: str, *, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Packs all documents: one row per piece with doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Every row of the input is packed.  A null or empty text is one piece with the end id alone; texts that
    give more ids than the capacity are cut; repeated rows are packed each; a null doc_id is kept; an empty
    table gives no rows.  Sequences are gapless from offset 0.
    """
    return pack(tokenize_pieces(docs, json_path, pattern, capacity=capacity, end_id=end_id, id_col=id_col, text_col=text_col), capacity)
