"""Near-duplicate documents: SetSketch registers, bands, joint estimates, then full sets.

A document is its set of word shingles.  Its sketch is a row of SetSketch registers: the least of
exponentially distributed hash values, truncated to exponentially spaced steps.  Registers of a union are the
maxima of the registers, and equal registers are about as likely as the sets are similar.  Bands of registers
find the candidates, a likelihood over the register comparisons rules out what is clearly below the threshold,
and the full sets decide.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_slices, perhaps_among, store, texts
from .components import connected_components

WORDS = 5
PERCENT = 80
#: Registers and how many of them make a band.  A pair at similarity 0.8 meets in none of 32 bands of 4 with
#: probability (1 - 0.8 ** 4) ** 32 < 5e-8.
REGISTERS, BAND = 128, 4
#: Steps of the registers: values in [0, LAST], each step a factor BASE, RATE shifts them so that small sets fit.
BASE, RATE, LAST = 1.001, 20.0, 65535
#: Twice the log-likelihood by which the threshold must lose against the best estimate for a pair to be ruled out
#: (6 standard deviations).
RULE_OUT = 36.0
#: Buckets up to this size give all their pairs at once; larger ones first compare all members with one of them.
SMALL = 5

_RANDOM = np.random.default_rng(20240229)
FACTORS = _RANDOM.integers(0, 1 << 63, REGISTERS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SHIFTS = _RANDOM.integers(0, 1 << 63, REGISTERS, dtype=np.uint64) * np.uint64(2)
PLACES = _RANDOM.integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class WordHashes(dict):
    """64-bit hashes of words, remembered; emptied when it has grown large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 60_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def shingles(text: str | None, k: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles; the whole sequence is one if there are fewer words.

    A-Z are lowered; words are runs without ASCII white space; no text or no words give no shingles.
    """
    words = text.encode().lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    each = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    width = min(k, len(each))
    total = np.full(len(each) - width + 1, width, np.uint64)
    for j in range(width):
        total += each[j : len(each) - width + 1 + j] * PLACES[j]
    return np.unique(mix(total))


def registers(members: np.ndarray) -> np.ndarray:
    """SetSketch registers of a set of 64-bit hashes (uint16)."""
    least = np.full(REGISTERS, np.iinfo(np.uint64).max, np.uint64)
    for start in range(0, len(members), 2048):
        block = np.multiply.outer(FACTORS, members[start : start + 2048])
        block += SHIFTS[:, None]
        np.minimum(least, block.min(axis=1), out=least)
    exponential = -np.log1p(-(least.astype(np.float64) + 1.0) / (2.0**64 + 4096.0)) / RATE
    return np.clip(np.floor(1.0 - np.log(exponential) / math.log(BASE)), 0, LAST).astype("<u2")


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Registers of the union of two sets."""
    return np.maximum(a, b)


def likelihood(j: np.ndarray, u: np.ndarray, more: np.ndarray, less: np.ndarray, same: np.ndarray) -> np.ndarray:
    """Log-likelihood of similarity ``j`` given how many registers are larger, smaller and equal; ``u`` is the
    first set's share of both sizes, which are known exactly."""
    v = 1.0 - u
    step = lambda x: -np.log1p(-np.clip(x, 0.0, 1.0) * (BASE - 1.0) / BASE) / math.log(BASE)
    up, down = step(u - v * j), step(v - u * j)
    safe = lambda x: np.log(np.maximum(x, 1e-12))
    return more * safe(up) + less * safe(down) + same * safe(1.0 - up - down)


def possible(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, percent: int) -> np.ndarray:
    """Which pairs of register rows may reach the threshold."""
    small, large = np.minimum(n_a, n_b).astype(float), np.maximum(n_a, n_b).astype(float)
    fits = 100 * small >= percent * large
    more, less = (a > b).sum(axis=1), (a < b).sum(axis=1)
    same = a.shape[1] - more - less
    u, top = n_a / np.maximum(n_a + n_b, 1), small / np.maximum(large, 1)
    best = np.full(len(a), -np.inf)
    for share in np.linspace(0.0, 1.0, 41):
        np.maximum(best, likelihood(share * top, u, more, less, same), out=best)
    at = likelihood(np.minimum(percent / 100, top), u, more, less, same)
    above = same >= percent / 100 * a.shape[1]
    return fits & (above | (2 * (best - at) <= RULE_OUT))


def sketch(docs: DataFrame, *, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, digest (of the set), registers of every whole text; narrow, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            rows = []
            for text in batch.column(1):
                members = shingles(text.as_py(), words, hashes)
                if len(members):
                    rows.append((len(members), xxhash.xxh3_128_digest(members.tobytes()), registers(members).tobytes()))
                else:
                    rows.append((0, None, None))
            columns = list(zip(*rows, strict=True)) or [()] * 3
            kinds = (pa.int64(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=["doc_id", "n_shingles", "digest", "registers"])

    return map_slices(texts(docs, id_col, text_col), run, "doc_id long, n_shingles long, digest binary, registers binary")


def band_keys(reps: DataFrame) -> DataFrame:
    """(id, key): one row a band, keyed by the band's number and its bytes of the registers; a pass in the JVM.

    Two bands with one key by chance cost a comparison and change no result.
    """
    width = 2 * BAND
    each = reps.select("id", "registers", F.explode(F.sequence(F.lit(0), F.lit(REGISTERS // BAND - 1))).alias("band"))
    return each.select("id", F.xxhash64("band", F.substring(F.col("registers"), F.col("band") * width + 1, F.lit(width))).alias("key"))


def sets_of(docs: DataFrame, wanted: DataFrame, *, words: int, id_col: str, text_col: str) -> DataFrame:
    """(id, members) for the wanted (id, digest): the full sets, from the texts again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            ids, found = [], []
            for doc_id, text, digest in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                raw = shingles(text.as_py(), words, hashes).tobytes()
                if xxhash.xxh3_128_digest(raw) == digest:
                    ids.append(doc_id)
                    found.append(raw)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(found, pa.binary())], names=["id", "members"])

    own = perhaps_among(texts(docs, id_col, text_col), "doc_id", wanted.select("id")).where("__perhaps")  # other texts are not shuffled
    joined = own.join(wanted.select(F.col("id").alias("doc_id"), "digest"), "doc_id").select("doc_id", "text", "digest")
    return map_slices(joined, run, "id long, members binary")


def filtered(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that sizes and registers do not rule out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = lambda column: np.frombuffer(b"".join(column.to_pylist()), "<u2").reshape(-1, REGISTERS)
        for batch in batches:
            if batch.num_rows:
                ok = possible(rows(batch.column(4)), rows(batch.column(5)), batch.column(2).to_numpy(), batch.column(3).to_numpy(), percent)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(ok))

    def side(name: str) -> DataFrame:
        return reps.select(F.col("id").alias(name), F.col("n").alias(f"n_{name}"), F.col("registers").alias(f"r_{name}"))

    joined = pairs.join(side("a"), "a").join(side("b"), "b").where(f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)")
    return map_slices(joined.select("a", "b", "n_a", "n_b", "r_a", "r_b"), run, "a long, b long", 4000)


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets reach the threshold, in whole numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                a, b = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.concatenate([a, b])
                both.sort(kind="stable")
                common = int((both[1:] == both[:-1]).sum())
                ok.append(100 * common >= percent * (len(a) + len(b) - common))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    a = sets.select(F.col("id").alias("a"), F.col("members").alias("m_a"))
    b = sets.select(F.col("id").alias("b"), F.col("members").alias("m_b"))
    return map_slices(pairs.join(a, "a").join(b, "b").select("a", "b", "m_a", "m_b"), run, "a long, b long")


def ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()


def prefix_pairs(open_rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of different components that may reach the threshold, found without comparing all with all.

    ``open_rows`` has id and component.  Two sets of n and m shingles at threshold t have at least
    o = ceil(t / (1 + t) (n + m)) in common.  With the shingles of all sets in one order, the rarest first, they then
    share one among the first n - o + 1 of the one and the first m - o + 1 of the other.  So a copy with many
    shingles of its own meets nobody.  On each shingle, rows of the most frequent component are only met by rows
    of others.
    """

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, raw in enumerate(batch.column(2)):
                members = np.frombuffer(raw.as_buffer(), np.int64)
                same = lambda column, n=len(members), k=k: pa.array(np.full(n, column[k].as_py(), np.int64))
                yield pa.RecordBatch.from_arrays([same(batch.column(0)), same(batch.column(1)), pa.array(np.full(len(members), len(members))), pa.array(members)], names=["id", "component", "n", "h"])

    rows = map_slices(open_rows.join(sets, "id").select("id", "component", "members"), spread, "id long, component long, n long, h long")
    rows = store(rows, "open-shingles")
    # the aggregates by shingle are written before they are joined, so that a shingle of very many rows can be split
    often = store(rows.groupBy("h").agg(F.count(F.lit(1)).alias("f")).where("f > 1"), "frequencies")
    own = rows.join(often, "h").groupBy("id", "component", "n").agg(F.sort_array(F.collect_list(F.struct("f", "h"))).alias("common"))
    longest = f"(n - ({percent} * n + 99) div 100 + 1)"  # the bound for the smallest partner
    common = f"({percent} * (n_a + n_b) + {99 + percent}) div {100 + percent}"
    placed = (
        own.withColumn("lone", F.expr("n - size(common)"))
        .where(f"lone < {longest}")
        .select("id", "component", "n", "lone", F.posexplode(F.expr(f"slice(common, 1, cast({longest} - lone as int))")).alias("k", "s"))
        .select("id", "component", "n", F.col("s.h").alias("h"), F.expr("lone + k + 1").alias("place"))
    )
    placed = store(placed, "prefixes")
    counts = placed.groupBy("h", "component").agg(F.count(F.lit(1)).alias("c"))
    main = store(counts.groupBy("h").agg(F.max(F.struct("c", "component")).alias("top"), F.count(F.lit(1)).alias("components")).where("components > 1").select("h", F.col("top.component").alias("main")), "main-components")
    split = store(placed.join(main, "h"), "split-shingles")
    side = lambda df, x: df.select("h", *[F.col(c).alias(f"{c}_{x}") for c in ("id", "component", "n", "place")])
    met = side(split.where("component <> main"), "a").join(side(split, "b"), "h").where(
        f"component_a <> component_b and 100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b) and place_a <= n_a - {common} + 1 and place_b <= n_b - {common} + 1"
    )
    return met.select(F.col("id_a").alias("a"), F.col("id_b").alias("b"))


def link_documents(docs: DataFrame, *, words: int = WORDS, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Components of near-duplicate documents: doc_id, n_shingles, component_id, kept, one row per input row.

    Two documents are linked if 100 * |A and B| >= percent * |A or B| on their full shingle sets.  component_id is
    the least doc_id reachable (the own one without links); kept marks it.  Documents with equal sets are one
    class from the start and never make pairs.  Null and empty texts have no shingles and link with nothing.
    Repeated rows are copies and get the same component.  A null doc_id is kept with the component of its
    text's class (null if that has no other row) and is never ``kept``.  Other columns are ignored; an empty
    table gives no rows.

    Candidates come from shared band keys.  A bucket of more than SMALL classes is not expanded into pairs: its
    members are compared with the one among them that meets the most others.  Where a bucket's members are then
    still in several components, pairs between those come from the rarest shingles of their sets, so no link
    between components is lost; links inside a component change nothing and are left out.
    """
    drawn = store(sketch(docs, words=words, id_col=id_col, text_col=text_col), "sketches")
    reps = store(
        drawn.where("digest is not null and doc_id is not null")
        .groupBy("digest")
        .agg(F.min("doc_id").alias("id"), F.first("n_shingles").alias("n"), F.first("registers").alias("registers")),
        "classes",
    )
    # one aggregate finds the shared keys and, where two classes share one, their pair; only larger buckets need their members
    bands = band_keys(reps)
    shared = store(bands.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min("id").alias("low"), F.max("id").alias("high")).where("size > 1"), "shared-keys")
    twos = shared.where("size = 2").select(F.col("low").alias("a"), F.col("high").alias("b"))
    met = store(bands.join(shared.where("size > 2").select("key", "size"), "key"), "buckets")

    small = met.where(f"size <= {SMALL}").groupBy("key").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    spread = small.select("ids", F.posexplode("ids").alias("k", "a")).select("a", F.explode(F.expr("slice(ids, k + 2, size(ids))")).alias("b"))
    degree = met.groupBy("id").agg(F.sum("size").alias("degree"))
    large = store(met.where(f"size > {SMALL}").join(degree, "id").select("key", "id", "degree"), "large-buckets")
    # the aggregates by key are written first, so that a bucket of very many members can be split in the joins
    hubs = store(large.groupBy("key").agg(F.max(F.struct("degree", (-F.col("id")).alias("order"))).alias("top")).select("key", (-F.col("top.order")).alias("hub")), "hubs")
    star = large.select("key", "id").join(hubs, "key").select(F.col("hub").alias("a"), F.col("id").alias("b"))

    candidates = store(filtered(ordered(twos.unionAll(spread).unionAll(star)), reps, percent), "candidates")
    needed = candidates.select(F.col("a").alias("id")).unionAll(candidates.select(F.col("b").alias("id"))).unionAll(large.select("id")).distinct()
    sets = store(sets_of(docs, needed.join(reps.select("id", "digest"), "id"), words=words, id_col=id_col, text_col=text_col).dropDuplicates(["id"]), "sets")
    links = store(verified(candidates, sets, percent), "links")
    found = store(connected_components(links), "components")

    placed = large.join(found, "id", "left").select("key", "id", F.coalesce("component", "id").alias("component"))
    split = store(placed.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("key"), "split-buckets")
    open_rows = store(placed.join(split, "key").select("id", "component").distinct(), "open")
    if not open_rows.isEmpty():
        rest = store(filtered(ordered(prefix_pairs(open_rows, sets, percent)), reps, percent), "candidates")
        more = store(verified(rest, sets, percent), "links")
        if not more.isEmpty():
            stars = found.where("id <> component").select(F.col("id").alias("a"), F.col("component").alias("b"))
            found = store(connected_components(stars.unionAll(more)), "components")

    classes = reps.join(found, "id", "left").select("digest", F.coalesce("component", "id").alias("class_component"))
    joined = drawn.select("doc_id", "n_shingles", "digest").join(classes, "digest", "left")
    component = F.coalesce("class_component", "doc_id")
    return joined.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, *, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` without near duplicates: of each component the row with the least doc_id stays.

    Of rows that repeat a kept doc_id one stays.  Rows without a doc_id stay: nothing could name them as copies.
    Only texts that may have to go are shuffled, by doc_id.
    """
    linked = link_documents(docs, words=words, percent=percent).where("doc_id is not null")
    ids = store(linked.groupBy("doc_id").agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias("rows")), "kept-ids")
    gone = ids.where("not kept or rows > 1").select("doc_id")
    marked = perhaps_among(docs, "doc_id", gone)
    rest = marked.where("not __perhaps").select(*docs.columns).unionByName(marked.where("__perhaps").join(gone, "doc_id", "left_anti").select(*docs.columns))
    repeated = ids.where("kept and rows > 1").select("doc_id")
    if repeated.isEmpty():
        return rest
    return rest.unionByName(docs.join(repeated, "doc_id", "left_semi").select(*docs.columns).dropDuplicates(["doc_id"]))


ORACLE_SQL = r"""
with recursive d as (
 select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x20\x09-\x0D]+') as ws from documents),
s as (
 select doc_id, case when len(ws) = 0 then [] when len(ws) < 4 then [array_to_string(ws, ' ')]
  else list_distinct([ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] || ' ' || ws[i + 3] for i in range(1, len(ws) - 2)]) end as g
 from d),
x as (select doc_id, len(g) as n, unnest(g) as g from s),
cls as (select list_sort(g) as g, min(doc_id) as rep from s where len(g) > 0 group by 1),
y as (select rep, len(g) as n, unnest(g) as g from cls),
p as (select a.rep as a, b.rep as b, any_value(a.n) as na, any_value(b.n) as nb, count(*) as c
      from y a join y b on a.g = b.g and a.rep < b.rep and 100 * a.n >= 80 * b.n and 100 * b.n >= 80 * a.n group by 1, 2),
e as (select a, b from p where 100 * c >= 80 * (na + nb - c)),
both_ways as (select a, b from e union all select b, a from e),
r(id, c) as (select rep, rep from cls union select both_ways.b, r.c from r join both_ways on r.id = both_ways.a),
comp as (select id, min(c) as c from r group by id)
select s.doc_id, len(s.g) as n_shingles, coalesce(comp.c, s.doc_id) as component_id, s.doc_id = coalesce(comp.c, s.doc_id) as kept
from s left join cls on list_sort(s.g) = cls.g left join comp on comp.id = cls.rep
"""
