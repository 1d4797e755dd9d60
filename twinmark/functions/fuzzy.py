"""String metrics without a built-in equivalent: common subsequence, token-set, partial and n-gram similarity.

Plain functions on Python texts, and one Arrow pass that applies them to distinct text pairs.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..workers import ship


def round2(x: float) -> float:
    return math.floor(x * 100 + 0.5) / 100


def places(text: str) -> dict[str, int]:
    """Bit set of the places of each character."""
    found: dict[str, int] = {}
    for k, c in enumerate(text):
        found[c] = found.get(c, 0) | 1 << k
    return found


def common_length(at: dict[str, int], n: int, other: str) -> int:
    """Length of the longest common subsequence of a text of ``n`` characters and another, a word of bits at a time."""
    row, full = (1 << n) - 1, (1 << n) - 1
    for c in other:
        hit = row & at.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return n - row.bit_count()


def ratio(a: str, b: str) -> float:
    """100 * 2 * common / (both lengths)."""
    total = len(a) + len(b)
    return 200.0 * common_length(places(a), len(a), b) / total if total else 100.0


def token_set_parts(a: str, b: str) -> float | tuple[str, str, float]:
    """The score if it is known at once, else the two texts to compare and what they reach at least."""
    left, right = set(a.split()), set(b.split())
    if not left or not right:
        return 0.0
    both = " ".join(sorted(left & right))
    if both and (left <= right or right <= left):
        return 100.0
    one, two = (" ".join([both, *sorted(x)] if both else sorted(x)) for x in (left - right, right - left))
    least = max(200.0 * len(both) / (len(both) + len(x)) for x in (one, two)) if both else 0.0
    return one, two, least


def token_set_ratio(a: str, b: str) -> float:
    """Best ratio of the shared tokens, and of the shared tokens with those of either side."""
    ready = token_set_parts(a, b)
    return ready if isinstance(ready, float) else max(ready[2], ratio(ready[0], ready[1]))


def partial_ratio(a: str, b: str) -> float:
    """Best ratio of the shorter text against the windows of its length, cut off at both ends of the longer one."""
    if not a or not b:
        return 100.0 if a == b else 0.0
    short, long = sorted((a, b), key=len)

    def best(short: str, long: str) -> float:
        at, n, found = places(short), len(short), 0.0
        need, have, shared = Counter(short), Counter(), 0  # shared bounds what a window can have in common
        for end in range(1, len(long) + n):
            if end <= len(long):
                c = long[end - 1]
                have[c] += 1
                shared += have[c] <= need[c]
            if end > n:
                c = long[end - n - 1]
                shared -= have[c] <= need[c]
                have[c] -= 1
            window_size = min(end, len(long)) - max(0, end - n)
            if 200.0 * shared / (n + window_size) > found:
                window = long[max(0, end - n) : end]
                found = max(found, 200.0 * common_length(at, n, window) / (n + window_size))
        return found

    return max(best(short, long), best(long, short)) if len(a) == len(b) else best(short, long)


@lru_cache(maxsize=50_000)
def grams(text: str) -> dict[str, int]:
    """Character n-grams (3 to 5) inside words padded by a space; a padded word no longer than n is taken once."""
    found: Counter[str] = Counter()
    for word in text.lower().split():
        padded = f" {word} "
        for n in (3, 4, 5):
            if len(padded) <= n:
                found[padded] += 1
                break
            found.update(padded[k : k + n] for k in range(len(padded) - n + 1))
    return dict(found)


@lru_cache(maxsize=50_000)
def squares(text: str) -> int:
    return sum(n * n for n in grams(text).values())


#: Squared weight of an n-gram that only one of two texts has; one that both have weighs 1.
ALONE = (1.0 + math.log(1.5)) ** 2


def ngram_cosine(a: str, b: str) -> float:
    """Cosine of tf-idf vectors fitted on just these two texts, times 100."""
    x, y = grams(a), grams(b)
    shared = x.keys() & y.keys()
    if not shared:
        return 0.0
    dot, own_x, own_y = 0, 0, 0
    for g in shared:
        n, m = x[g], y[g]
        dot += n * m
        own_x += n * n
        own_y += m * m
    return 100.0 * dot / math.sqrt((own_x + (squares(a) - own_x) * ALONE) * (own_y + (squares(b) - own_y) * ALONE))


#: Texts up to this length fit a machine word, and pairs of a chunk are scored together.
WORD, CHUNK = 63, 1000


def common_lengths(short: list[str], owner: np.ndarray, other: list[str]) -> np.ndarray:
    """Length of the longest common subsequence of ``short[owner[k]]`` and ``other[k]`` for all k at once.

    The bit rows of all pairs advance together, one character of the other text a step.  ASCII texts; those in
    ``short`` have at most WORD characters.
    """
    masks = np.zeros((len(short), 128), np.uint64)
    for row, text in enumerate(short):
        for k, c in enumerate(text.encode("ascii")):
            masks[row, c] |= np.uint64(1 << k)
    masks[:, 0] = 0
    width = max(map(len, other), default=0)
    codes = np.frombuffer("".join([o.ljust(width, "\0") for o in other]).encode("ascii"), np.uint8).reshape(len(other), width)
    sizes = np.array([len(t) for t in short], np.uint64)
    full = ((np.uint64(1) << sizes) - np.uint64(1))[owner]
    state, flat, base = full.copy(), masks.ravel(), owner.astype(np.int64) * 128
    for column in np.ascontiguousarray(codes.T):
        hit = state & flat[base + column]
        state = (state + hit) | (state - hit)
    return sizes[owner].astype(np.int64) - np.bitwise_count(state & full).astype(np.int64)


#: Pairs that ``cross_scores`` looks at together, about.
CROSS = 200_000


def scores_of(words: list[str], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """``part_score`` of ``words[left[k]]`` and ``words[right[k]]`` for all k at once; each word's bit rows are made once."""
    sizes = np.array([len(w) if fits(w, w) else 0 for w in words], np.int64)
    plain = (sizes[left] > 0) & (sizes[right] > 0)
    out = np.zeros(len(left))
    if plain.any():
        width = int(sizes.max())
        raw = "".join([(w if n else "").ljust(width, "\0") for w, n in zip(words, sizes.tolist(), strict=True)]).encode("ascii")
        letters, codes = np.unique(np.frombuffer(b"\0" + raw, np.uint8), return_inverse=True)
        codes = np.ascontiguousarray(codes[1:].reshape(len(words), width).T)
        masks = np.zeros((len(words), len(letters)), np.uint64)
        rows = np.arange(len(words))
        for k, column in enumerate(codes):
            masks[rows, column] |= np.uint64(1 << k)
        masks[:, 0] = 0  # what fills up shorter words
        u, v = left[plain], right[plain]
        full = ((np.uint64(1) << sizes.astype(np.uint64)) - np.uint64(1))[u]
        state, flat, base = full.copy(), masks.ravel(), u * len(letters)
        for column in codes[: int(sizes[v].max())]:
            hit = state & flat[base + column[v]]
            state = (state + hit) | (state - hit)
        common = sizes[u] - np.bitwise_count(state & full).astype(np.int64)
        out[plain] = np.floor(200.0 * common / (sizes[u] + sizes[v]) * 100 + 0.5) / 100
    for k in np.flatnonzero(~plain).tolist():
        out[k] = part_score(words[left[k]], words[right[k]])
    return out


def cross_scores(a: pa.ListArray, b: pa.ListArray) -> pa.ListArray:
    """For each row the ``part_score`` of each text of ``a`` with each of ``b``, those of the first text of ``a`` first."""
    n_a, n_b = (x.value_lengths().fill_null(0).to_numpy().astype(np.int64) for x in (a, b))
    ends = np.cumsum(n_a * n_b)
    found, row = [], 0
    while row < len(n_a):
        last = max(row + 1, int(np.searchsorted(ends, (ends[row - 1] if row else 0) + CROSS, side="right")))
        x, y = (side.slice(row, last - row).flatten().fill_null("") for side in (a, b))
        coded = pa.concat_arrays([x, y]).dictionary_encode()
        at = coded.indices.to_numpy().astype(np.int64)
        size_a, size_b = n_a[row:last], n_b[row:last]
        each = np.repeat(np.arange(last - row), size_a * size_b)
        place = np.arange(len(each)) - np.repeat(np.cumsum(size_a * size_b) - size_a * size_b, size_a * size_b)
        left = (np.cumsum(size_a) - size_a)[each] + place // size_b[each]
        right = len(x) + (np.cumsum(size_b) - size_b)[each] + place % size_b[each]
        found.append(scores_of(coded.dictionary.to_pylist(), at[left], at[right]))
        row = last
    offsets = np.concatenate([[0], ends]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(found) if found else np.zeros(0)))


def windows(short: str, long: str) -> list[str]:
    """All windows of the shorter text's length, cut off at both ends of the longer one."""
    n = len(short)
    return [long[max(0, end - n) : end] for end in range(1, len(long) + n)]


def best_windows(pairs: list[tuple[str, str]]) -> np.ndarray:
    """Partial ratio of (shorter, longer) pairs: best over windows, together for all pairs."""
    cut = [windows(a, b) for a, b in pairs]
    owner = np.repeat(np.arange(len(pairs)), [len(w) for w in cut])
    flat = [w for own in cut for w in own]
    total = np.array([len(a) for a, _ in pairs])[owner] + np.array([len(w) for w in flat])
    scores = 200.0 * common_lengths([a for a, _ in pairs], owner, flat) / total
    return np.maximum.reduceat(scores, np.concatenate([[0], np.cumsum([len(w) for w in cut])[:-1]]))


def fits(a: str, b: str) -> bool:
    """Whether the shorter of two texts fits a machine word and both are plain."""
    return 0 < min(len(a), len(b)) <= WORD and a.isascii() and b.isascii() and "\0" not in a and "\0" not in b


def ratios(pairs: list[tuple[str, str]]) -> list[float]:
    """``ratio`` of many pairs."""
    out = [0.0] * len(pairs)
    at = [k for k, p in enumerate(pairs) if fits(*p)]
    if at:
        ordered = [sorted(pairs[k], key=len) for k in at]
        common = common_lengths([p[0] for p in ordered], np.arange(len(at)), [p[1] for p in ordered])
        for k, n in zip(at, common.tolist(), strict=True):
            out[k] = 200.0 * n / (len(pairs[k][0]) + len(pairs[k][1]))
    for k in set(range(len(pairs))) - set(at):
        out[k] = ratio(*pairs[k])
    return out


def partial_ratios(pairs: list[tuple[str, str]]) -> list[float]:
    """``partial_ratio`` of many pairs of texts that are not blank."""
    out = [0.0] * len(pairs)
    tasks: list[tuple[str, str]] = []
    owner: list[int] = []
    for k, (a, b) in enumerate(pairs):
        if not fits(a, b):
            out[k] = partial_ratio(a, b)
            continue
        short, long = sorted((a, b), key=len)
        tasks.append((short, long))
        owner.append(k)
        if len(a) == len(b):
            tasks.append((long, short))
            owner.append(k)
    if tasks:
        for k, score in zip(owner, best_windows(tasks).tolist(), strict=True):
            out[k] = max(out[k], score)
    return out


def token_set_ratios(pairs: list[tuple[str, str]]) -> list[float]:
    """``token_set_ratio`` of many pairs."""
    out = [0.0] * len(pairs)
    tasks: list[tuple[int, str, str]] = []
    for k, (a, b) in enumerate(pairs):
        ready = token_set_parts(a, b)
        if isinstance(ready, float):
            out[k] = ready
        else:
            out[k] = ready[2]
            tasks.append((k, ready[0], ready[1]))
    for (k, _, _), score in zip(tasks, ratios([t[1:] for t in tasks]), strict=True):
        out[k] = max(out[k], score)
    return out


def text_scores(a: str | None, b: str | None) -> tuple[float, float]:
    """(n-gram cosine, fuzzy) of two similarity texts, rounded; 0 if one is blank."""
    if not a or not b:
        return 0.0, 0.0
    return round2(ngram_cosine(a, b)), round2(0.6 * token_set_ratio(a, b) + 0.4 * partial_ratio(a, b))


def part_score(a: str | None, b: str | None) -> float:
    return round2(ratio(a, b)) if a and b else 0.0


def score_many(pairs: list[tuple[str, str]]) -> list[tuple[float, float]]:
    """``text_scores`` of many pairs."""
    out = [(0.0, 0.0)] * len(pairs)
    at = [k for k, (a, b) in enumerate(pairs) if a and b]
    for start in range(0, len(at), CHUNK):
        part = at[start : start + CHUNK]
        own = [pairs[k] for k in part]
        for k, (a, b), tokens, partial in zip(part, own, token_set_ratios(own), partial_ratios(own), strict=True):
            out[k] = round2(ngram_cosine(a, b)), round2(0.6 * tokens + 0.4 * partial)
    return out


def score_texts(pairs: DataFrame) -> DataFrame:
    """(text_a, text_b) with tfidf_score and fuzzy_score; give it distinct pairs."""
    ship(pairs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = score_many(list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([s[0] for s in scores], pa.float64()), pa.array([s[1] for s in scores], pa.float64())], names=["text_a", "text_b", "tfidf_score", "fuzzy_score"])

    return pairs.select("text_a", "text_b").mapInArrow(run, "text_a string, text_b string, tfidf_score double, fuzzy_score double")


def add_part_scores(pairs: DataFrame, part_a: str, part_b: str) -> DataFrame:
    """Adds part_no_similarity of two columns in one narrow pass; part numbers hardly repeat, so pairs are not made distinct."""
    ship(pairs.sparkSession)
    at_a, at_b, names = pairs.columns.index(part_a), pairs.columns.index(part_b), pairs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [(a or "", b or "") for a, b in zip(batch.column(at_a).to_pylist(), batch.column(at_b).to_pylist(), strict=True)]
            scores = [round2(x) if a and b else 0.0 for (a, b), x in zip(own, ratios(own), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], names=[*names, "part_no_similarity"])

    return pairs.mapInArrow(run, T.StructType([*pairs.schema.fields, T.StructField("part_no_similarity", T.DoubleType())]))


def cross_part_scores(pairs: DataFrame, texts_a: str, texts_b: str, name: str) -> DataFrame:
    """Adds an array of the part_no_similarity of all texts of one array with all of another; see ``cross_scores``.

    Only the two arrays are sent to Python, whatever else a row holds.
    """
    ship(pairs.sparkSession)

    @F.arrow_udf("array<double>")
    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        return cross_scores(a, b)

    return pairs.withColumn(name, run(texts_a, texts_b))
