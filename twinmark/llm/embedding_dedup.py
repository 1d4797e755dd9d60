"""Near-duplicate embeddings by a robust-pruned flat graph.

Vectors of a label are dealt to overlapping cluster shards, large clusters by centroids of their own.  Each shard builds one flat layer of a proximity graph
whose neighbour lists are robust-pruned, and the lists of a vector from all its shards are united.  Every vector
then searches the shards around it: greedily from the shard's medoids, and from whatever it finds in range the
search spreads along the graph until nothing new is in range.  Where a vector's list, which holds its nearest
vector, shows that nothing is in range, the search of that shard ends at once.  Links are decided on exact double-precision
cosines.  What is found to be connected is then compared all with all in blocks, which counts every link once and
for both of its ends.  A sample of queries is compared with brute force after every search; the search is widened
while its recall is too low, and if that does not help, vectors are compared all with all.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_slices, store
from .components import connected_components

THRESHOLD = 0.93
#: Vectors of a cluster aimed at, home vectors of a shard and queries of a group at most: larger clusters are split.
CLUSTER, PIECE, ASKED = 2000, 4096, 16384
#: Rows that centroids are fitted on, at most; also bounds how many centroids there are on the first level.
SAMPLE = 20_000
#: Clusters of more home vectors than this get centroids of their own, fitted on so many of their rows; at most so many.
SPLIT, SUBSAMPLE, SUBCLUSTERS = 4000, 4000, 500
#: Vectors that are dealt to the second level in one task.
DEALT = 16384
#: Clusters whose graphs hold a vector, and clusters that a vector searches.
HELD, VISITED = 2, 3
#: Neighbours by robust pruning, long-range neighbours, candidates for both, slack of the pruning.
NEAR, FAR, CANDIDATES, ALPHA = 20, 6, 48, 1.2
#: Beam of the greedy search, entry points, how far below the threshold the spreading still goes.
BEAM, ENTRIES, MARGIN = 32, 16, 0.04
QUERIES = 128
#: Pairs of a query and a row that are compared at a time in the search.
LOOKED = 8192
#: Vectors that a function gets at a time.
VECTORS = 4000
#: Vectors of a block of exact comparison.
BLOCK = 4096
#: Queries with links that the audit judges on, the recall it asks for, and how often the search may be widened.
AUDITED, RECALL, WIDENINGS = 200, 0.99, 2


def prepare(rows: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """vec_id, label, digest, vec (unit vector, little-endian doubles); both null for vectors that link with nothing."""
    own = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).cast("array<double>").alias("v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, vectors = [], []
            for vec_id, label, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                unit = None
                if value.is_valid and label is not None and vec_id is not None and value.values.null_count == 0:
                    x = value.values.to_numpy(zero_copy_only=False).astype("<f8")
                    if len(x) and np.isfinite(x).all() and (scale := np.abs(x).max()) > 0:
                        raw = x.tobytes()
                        x = x / scale
                        unit = x / np.sqrt((x * x).sum())
                digests.append(xxhash.xxh3_128_digest(label.encode() + b"\0" + raw) if unit is not None else None)
                vectors.append(unit.tobytes() if unit is not None else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(digests, pa.binary()), pa.array(vectors, pa.binary())], names=["vec_id", "label", "digest", "vec"])

    return map_slices(own, run, "vec_id long, label string, digest binary, vec binary", VECTORS)


def matrix(column) -> np.ndarray:
    """Rows of equally long vectors."""
    values = column.to_pylist()
    return np.frombuffer(b"".join(values), "<f8").reshape(len(values), -1)


def k_means(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Centers of unit vectors, of unit length."""
    random = np.random.default_rng(11)
    centers = x[random.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        near = (x @ centers.T).argmax(axis=1)
        for c in range(k):
            own = x[near == c]
            center = own.sum(axis=0) if len(own) else x[random.integers(len(x))]
            centers[c] = center / max(np.linalg.norm(center), 1e-300)
    return centers


def fit_centroids(classes: DataFrame, total: int) -> dict[tuple[str, int], np.ndarray]:
    """Centroids by label and dimension, fitted on at most SAMPLE rows; none for labels that fit one shard."""
    sample = classes.select("label", "vec").orderBy(F.xxhash64("id"), "id").limit(SAMPLE).toPandas()
    share = max(1.0, total / max(len(sample), 1))
    found = {}
    for (label, size), part in sample.groupby([sample["label"], sample["vec"].str.len()]):
        x = np.frombuffer(b"".join(part["vec"]), "<f8").reshape(len(part), -1)
        k = min(int(np.ceil(len(x) * share / CLUSTER)), len(x) // 8)
        if k >= 2:
            found[label, size // 8] = k_means(x, k)
    return found


def deal(classes: DataFrame, centroids: dict, visited: int, few: frozenset = frozenset()) -> DataFrame:
    """One row per vector and cluster that it searches: label, dim, cluster, rank (0: its home), id, vec.

    Vectors of the labels and dimensions in ``few`` search the clusters that hold them and no others.
    """
    shared = classes.sparkSession.sparkContext.broadcast(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, clusters, ranks, dims = [], [], [], []
            for k, (label, raw) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                x = np.frombuffer(raw, "<f8")
                centers = shared.value.get((label, len(x)))
                order = [0] if centers is None else np.argsort(-(centers @ x), kind="stable")[: HELD if (label, len(x)) in few else visited].tolist()
                rows += [k] * len(order)
                clusters += order
                ranks += range(len(order))
                dims += [len(x)] * len(order)
            out = batch.take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([*out.columns, pa.array(dims, pa.int32()), pa.array(clusters, pa.int32()), pa.array(ranks, pa.int32())], names=["label", "id", "vec", "dim", "cluster", "rank"])

    return map_slices(classes.select("label", "id", "vec"), run, "label string, id long, vec binary, dim int, cluster int, rank int", VECTORS)


def fit_second_level(classes: DataFrame, centroids: dict) -> DataFrame | None:
    """(label, dim, cluster, n, centers) of the clusters with more than SPLIT home vectors; none if there are none.

    As many clusters as there are first centroids are counted.  The centroids of a cluster are fitted where a sample of
    its rows lies, drawn by hash, so their number grows with the corpus and nothing of them reaches the driver.
    """
    key = ["label", "dim", "cluster"]
    homes = deal(classes, centroids, 1)
    large = store(homes.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where(f"n > {SPLIT}"), "large-clusters")
    if not centroids or large.isEmpty():
        return None
    part = F.pmod(F.xxhash64("id", F.lit(3)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    drawn = homes.join(F.broadcast(large), key).where(part * F.col("n") < SUBSAMPLE)  # at most one row a first centroid is broadcast

    def run(group: pa.Table) -> pa.Table:
        x, n = matrix(group.column("vec")), group.column("n")[0].as_py()
        centers = k_means(x, max(1, min(-(-n // CLUSTER), SUBCLUSTERS, len(x) // 8)))
        return pa.table({**{c: group.column(c).slice(0, 1) for c in key}, "n": pa.array([n]), "centers": pa.array([centers.astype("<f8").tobytes()], pa.binary())})

    return store(drawn.select(*key, "n", "vec").groupBy(*key).applyInArrow(run, "label string, dim int, cluster int, n long, centers binary"), "second-centroids")


def held_together(centroids: dict, second: DataFrame | None) -> frozenset:
    """(label, dimension) of which any two vectors are nodes of one cluster, as each is held by more than half of them.

    Clusters with centroids of their own hold their vectors in other ways, so their labels are left out.
    """
    few = {key for key, centers in centroids.items() if len(centers) < 2 * HELD}
    if second is not None and few:  # at most one row a first centroid
        few -= {(r["label"], r["dim"]) for r in second.select("label", "dim").distinct().collect()}
    return frozenset(few)


def refine(dealt: DataFrame, second: DataFrame | None, visited: int) -> DataFrame:
    """Deals the rows of large clusters on to the nearest of their own centroids; the ranks of both levels add up.

    Rows of a cluster are split by hash, and each part meets the centroids of its cluster once.
    """
    if second is None:
        return dealt
    key = ["label", "dim", "cluster"]
    parts = second.withColumn("parts", F.ceil(F.col("n") * visited / DEALT).cast("int"))
    sizes = F.broadcast(parts.select(*key, "parts"))  # at most one row a first centroid
    rows = dealt.join(sizes, key, "left")
    own = rows.where("parts is not null").withColumn("part", F.pmod(F.xxhash64("id", F.lit(4)), F.col("parts")).cast("int"))
    centers = parts.select(*key, "centers", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))

    def run(group: pa.Table, found: pa.Table) -> pa.Table:
        schema = pa.schema([("label", pa.string()), ("dim", pa.int32()), ("cluster", pa.int32()), ("rank", pa.int32()), ("id", pa.int64()), ("vec", pa.binary())])
        if not group.num_rows:
            return schema.empty_table()
        x = matrix(group.column("vec"))
        c = np.frombuffer(found.column("centers")[0].as_py(), "<f8").reshape(-1, x.shape[1])
        rank, cluster = group.column("rank").to_numpy(), group.column("cluster").to_numpy()
        at, sub, total = [], [], []
        for start in range(0, len(x), 1024):
            order = np.argsort(-(x[start : start + 1024] @ c.T), axis=1, kind="stable")[:, :visited]
            place = rank[start : start + 1024, None] + np.arange(order.shape[1])[None]
            row, column = np.nonzero(place < visited)
            at.append(start + row)
            sub.append(order[row, column])
            total.append(place[row, column])
        at, sub, total = (np.concatenate(part) for part in (at, sub, total))
        # first-level numbers stay below the offset, so numbers of the two levels never meet
        number = (cluster[at].astype(np.int64) + 1) * 1024 + SAMPLE + sub
        out = group.take(pa.array(at))
        return pa.table([out.column("label"), out.column("dim"), pa.array(number.astype(np.int32)), pa.array(total.astype(np.int32)), out.column("id"), out.column("vec")], schema=schema)

    names = [*key, "rank", "id", "vec"]
    split = own.groupBy(*key, "part").cogroup(centers.groupBy(*key, "part")).applyInArrow(run, "label string, dim int, cluster int, rank int, id long, vec binary")
    return rows.where("parts is null").select(*names).unionByName(split)


def shard(dealt: DataFrame) -> DataFrame:
    """Splits clusters into pieces of bounded size, and the vectors that search a cluster into parts of bounded size.

    A vector is a node in one piece of a cluster, in each part of it, and a query in one part of each piece; so a group
    (label, dim, cluster, piece, part) is bounded however many vectors share a cluster.
    """
    key = ["label", "dim", "cluster"]
    homes = F.sum(F.when(F.col("rank") == 0, 1).otherwise(0))
    sizes = dealt.groupBy(*key).agg(F.greatest(F.ceil(homes / PIECE), F.lit(1)).cast("int").alias("pieces"), F.ceil(F.count(F.lit(1)) / ASKED).cast("int").alias("parts"))
    own = dealt.join(sizes, key).withColumn("mine", F.pmod(F.xxhash64("id"), F.col("pieces")).cast("int")).withColumn("asks", F.pmod(F.xxhash64("id", F.lit(2)), F.col("parts")).cast("int"))
    held = F.col("rank") < HELD
    place = lambda piece, part, node, query: F.struct(piece.alias("piece"), part.alias("part"), node.alias("node"), query.alias("query"))
    asked = F.transform(F.sequence(F.lit(0), F.col("pieces") - 1), lambda p: place(p, F.col("asks"), held & (p == F.col("mine")), F.lit(True)))
    others = F.filter(F.sequence(F.lit(0), F.col("parts") - 1), lambda q: held & (q != F.col("asks")))
    answers = F.transform(others, lambda q: place(F.col("mine"), q, F.lit(True), F.lit(False)))
    return own.select(*key, "id", "vec", F.explode(F.concat(asked, answers)).alias("p")).select(*key, "p.*", "id", "vec")


def robust_prune(x: np.ndarray, at: np.ndarray, candidates: np.ndarray, keep: int) -> np.ndarray:
    """For each row of ``at`` at most ``keep`` of its candidates (-1: none): a candidate goes if a kept one is
    nearer to it, by the factor ALPHA, than it is to the row.  Candidates come nearest first."""
    gathered = x[candidates]
    valid = (candidates >= 0) & (candidates != at[:, None])
    to_row = 1 - np.einsum("bmd,bd->bm", gathered, x[at])
    between = 1 - gathered @ gathered.transpose(0, 2, 1)
    alive, out, count = valid.copy(), np.full((len(at), keep), -1, np.int64), np.zeros(len(at), int)
    rows = np.arange(len(at))
    for m in range(candidates.shape[1]):
        take = alive[:, m] & (count < keep)
        out[rows[take], count[take]] = candidates[take, m]
        count += take
        alive &= ~(take[:, None] & (ALPHA * between[:, m] <= to_row))
    return out


def build_graph(x: np.ndarray, seed: int = 5) -> np.ndarray:
    """Neighbour lists (row numbers, -1 where there are fewer) of one shard: the nearest ones and long-range ones,
    both robust-pruned, with links back where a list has room."""
    n, random = len(x), np.random.default_rng(seed)
    lists = np.full((n, NEAR + FAR), -1, np.int64)
    for start in range(0, n, 256):
        at = np.arange(start, min(start + 256, n))
        near = x[at] @ x.T
        m = min(CANDIDATES, n)
        top = np.argpartition(-near, m - 1, axis=1)[:, :m]
        top = np.take_along_axis(top, np.argsort(-np.take_along_axis(near, top, axis=1), axis=1, kind="stable"), axis=1)
        lists[at, :NEAR] = robust_prune(x, at, top, NEAR)
        far = random.integers(0, n, (len(at), CANDIDATES // 2))
        far = np.take_along_axis(far, np.argsort(-np.take_along_axis(near, far, axis=1), axis=1, kind="stable"), axis=1)
        lists[at, NEAR:] = robust_prune(x, at, far, FAR)
    back: list[list[int]] = [[] for _ in range(n)]
    for row, own in enumerate(lists[:, :NEAR]):
        for other in own[own >= 0]:
            if len(back[other]) < NEAR:
                back[other].append(row)
    extra = np.full((n, NEAR), -1, np.int64)
    for row, own in enumerate(back):
        extra[row, : len(own)] = own
    return np.hstack([lists, extra])


def entry_points(x: np.ndarray) -> np.ndarray:
    """The medoid and, around it, medoids of parts: each next one is the row least covered so far."""
    center = x.mean(axis=0)
    chosen = [int((x @ center).argmax())]
    covered = x @ x[chosen[0]]
    while len(chosen) < min(ENTRIES, len(x)):
        chosen.append(int(covered.argmin()))
        np.maximum(covered, x @ x[chosen[-1]], out=covered)
    return np.unique(chosen)


def without_links(x: np.ndarray, lists: np.ndarray, threshold: float) -> np.ndarray:
    """Which rows have nothing in range but themselves.

    The lists must hold the nearest other row of every row, as those of ``build_graph`` do: pruning takes it first.  So
    where no listed neighbour is in range, no row is, and there is nothing to search for.
    """
    nearest = np.full(len(x), -9.0)
    for start in range(0, len(x), QUERIES):
        own = lists[start : start + QUERIES]
        row, column = np.nonzero(own >= 0)
        values = np.full(own.shape, -9.0)
        values[row, column] = np.einsum("md,md->m", x[own[row, column]], x[start + row])
        nearest[start : start + QUERIES] = values.max(axis=1)
    return nearest < threshold - 1e-9  # the graph is built by matrix products, which may differ in the last digits


def range_search(x: np.ndarray, lists: np.ndarray, queries: np.ndarray, own: np.ndarray, threshold: float, beam: int = BEAM, entries: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(query, row) of all that is found with cosine >= threshold.

    Greedy search from the entry points (and from the query's own row where it has one, ``own`` >= 0), then
    spreading over the neighbours of whatever is in range, until nothing new is.
    """
    b, n = len(queries), len(x)
    entries = entry_points(x) if entries is None else entries
    seen, kept = np.zeros(b * n, bool), []

    def look(flat: np.ndarray) -> np.ndarray:
        """Cosines of the places query * n + row, which are marked as seen; only these are gathered, some at a time."""
        seen[flat] = True
        values = np.empty(len(flat))
        for s in range(0, len(flat), LOOKED):
            q, p = np.divmod(flat[s : s + LOOKED], n)
            values[s : s + LOOKED] = np.einsum("md,md->m", x[p], queries[q])
        return values

    start = np.hstack([np.broadcast_to(entries, (b, len(entries))), np.where(own >= 0, own, entries[0])[:, None]])
    fresh = np.ones(start.shape, bool)
    fresh[own < 0, -1] = False  # these have no row of their own, and their first entry point counts once
    fresh[:, :-1] &= (start[:, :-1] != start[:, -1:]) | (own < 0)[:, None]
    values, flat = np.full(start.shape, -9.0), np.arange(b)[:, None] * n + start
    values[fresh] = look(flat[fresh])
    kept.append((flat[fresh], values[fresh]))
    # the beams of the queries that still have a place to expand; the others are left out of every further round
    rows, places, done = np.arange(b), start, ~fresh
    for _ in range(8 * beam):
        if places.shape[1] > beam:
            order = np.argpartition(-values, beam - 1, axis=1)[:, :beam]
            places, values, done = (np.take_along_axis(part, order, axis=1) for part in (places, values, done))
        waiting = np.where(done, -9.0, values)
        best = waiting.argmax(axis=1)
        every = np.arange(len(rows))
        active = waiting[every, best] > -9.0
        if not active.all():
            rows, places, values, done, best = rows[active], places[active], values[active], done[active], best[active]
            every = np.arange(len(rows))
        if not len(rows):
            break
        done[every, best] = True
        new = lists[places[every, best]]
        flat = rows[:, None] * n + new
        fresh = new >= 0
        fresh &= ~seen[np.where(fresh, flat, 0)]
        found = np.full(new.shape, -9.0)
        found[fresh] = look(flat[fresh])
        kept.append((flat[fresh], found[fresh]))
        places, values, done = np.hstack([places, new]), np.hstack([values, found]), np.hstack([done, ~fresh])
    flat, values = (np.concatenate(part) for part in zip(*kept, strict=True))
    hits, front = [flat[values >= threshold]], np.unique(flat[values >= threshold - MARGIN])
    while len(front):
        further = []
        for part in range(0, len(front), 4096):
            q, p = np.divmod(front[part : part + 4096], n)
            around = lists[p]
            flat = (q[:, None] * n + around)[around >= 0]
            flat = np.unique(flat[~seen[flat]])
            values = look(flat)
            hits.append(flat[values >= threshold])
            further.append(flat[values >= threshold - MARGIN])
        front = np.concatenate(further)
    return np.divmod(np.unique(np.concatenate(hits)), n)


class Forest:
    """Union-find over row numbers."""

    def __init__(self, n: int) -> None:
        self.parent = np.arange(n)

    def find(self, rows: np.ndarray) -> np.ndarray:
        roots = self.parent[rows]
        while True:
            above = self.parent[roots]
            if (above == roots).all():
                return roots
            roots = above

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        pairs = np.unique(np.stack([self.find(a), self.find(b)]), axis=1)
        for x, y in pairs.T:
            low, high = sorted((int(self.find(np.array([x]))[0]), int(self.find(np.array([y]))[0])))
            self.parent[high] = low


def build(shards: DataFrame) -> DataFrame:
    """(id, neighbours) united over all shards that hold a vector."""

    def run(group: pa.Table) -> pa.Table:
        ids = group.column("id").to_numpy()
        lists = build_graph(matrix(group.column("vec")))
        return pa.table({"id": pa.array(ids), "neighbours": pa.array([np.unique(ids[own[own >= 0]]) for own in lists], pa.list_(pa.int64()))})

    nodes = shards.where("node and query").groupBy("label", "dim", "cluster", "piece").applyInArrow(run, "id long, neighbours array<long>")
    return nodes.groupBy("id").agg(F.array_distinct(F.flatten(F.collect_list("neighbours"))).alias("neighbours"))


def search(shards: DataFrame, graph: DataFrame, threshold: float, beam: int) -> DataFrame:
    """One row per vector and shard: id, root.

    ``root`` joins what is linked inside the shard; pairs themselves are never returned.
    """

    def run(group: pa.Table) -> pa.Table:
        # a vector may be here as node; rows are sorted by id so that roots are the least ids
        order = np.argsort(group.column("id").to_numpy(), kind="stable")
        group = group.take(pa.array(order))
        ids, is_node, asks = (group.column(c).to_numpy() for c in ("id", "node", "query"))
        at = np.flatnonzero(is_node)
        forest = Forest(len(ids))
        if len(at):
            every = matrix(group.column("vec"))
            x, node_ids = every[at], ids[at]
            near = group.column("neighbours").take(pa.array(at))
            row = np.repeat(np.arange(len(at)), pc.fill_null(pc.list_value_length(near), 0).to_numpy())
            own = pc.list_flatten(near).to_numpy()
            place = np.searchsorted(node_ids, own)
            place = np.where(place < len(node_ids), place, 0)
            here = node_ids[place] == own  # the others are nodes of other shards
            row, place = row[here], place[here]
            count = np.bincount(row, minlength=len(at))
            lists = np.full((len(at), max(1, count.max())), -1, np.int64)
            lists[row, np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)] = place
            entries, own_row = entry_points(x), np.full(len(ids), -1, np.int64)
            own_row[at] = np.arange(len(at))
            alone = np.zeros(len(ids), bool)
            alone[at] = without_links(x, lists, threshold)
            asked = np.flatnonzero(asks & ~alone)
            for start in range(0, len(asked), QUERIES):
                part = asked[start : start + QUERIES]
                q, p = range_search(x, lists, every[part], own_row[part], threshold, beam, entries)
                other = ids[part[q]] != node_ids[p]
                forest.join(part[q[other]], at[p[other]])
        roots = ids[forest.find(np.arange(len(ids)))]
        return pa.table({"id": pa.array(ids), "root": pa.array(roots)})

    joined = shards.join(graph, "id", "left")
    return joined.groupBy("label", "dim", "cluster", "piece", "part").applyInArrow(run, "id long, root long")


def compare(groups: DataFrame, threshold: float, roots: bool = False) -> DataFrame:
    """id, found, root: for each vector of (key, id, mult, vec) the others of its key that are linked, with copies, and
    the least id that the links of these two blocks connect it with.

    A key of more than BLOCK vectors is cut into blocks, and every two of its blocks meet in one task; small keys share
    tasks.  A vector is in one block, so its rows (one for each block it meets) add up; pairs are never returned.
    Without ``roots`` the root is the own id.
    """
    sizes = groups.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    tasks = max(1, groups.count() // BLOCK)
    own = groups.join(sizes, "key").withColumn("mine", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    meets = F.sequence(F.lit(0), F.col("blocks") - 1)
    place = lambda a, b, query, node: F.struct(a.alias("a"), b.alias("b"), query.alias("query"), node.alias("node"))
    asks = F.transform(meets, lambda o: place(F.col("mine"), o, F.lit(True), o == F.col("mine")))
    answers = F.transform(F.filter(meets, lambda o: o != F.col("mine")), lambda o: place(o, F.col("mine"), F.lit(False), F.lit(True)))
    met = own.select(F.pmod(F.xxhash64("key"), F.lit(tasks)).alias("task"), "key", "id", "mult", "vec", F.explode(F.concat(asks, answers)).alias("p"))

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by([("key", "ascending"), ("id", "ascending")])
        keys = group.column("key").to_numpy()
        ids, mult, query, node = (group.column(c).to_numpy() for c in ("id", "mult", "query", "node"))
        found, forest = np.zeros(len(ids), np.int64), Forest(len(ids))
        starts = np.sort(np.unique(keys, return_index=True)[1])
        for start, end in zip(starts, [*starts[1:], len(keys)], strict=True):
            x = matrix(group.column("vec").slice(start, end - start))
            at, asked = (start + np.flatnonzero(part[start:end]) for part in (node, query))
            nodes = x[at - start]
            for k in range(0, len(asked), QUERIES):
                rows = asked[k : k + QUERIES]
                linked = (x[rows - start] @ nodes.T >= threshold) & (ids[rows][:, None] != ids[at][None])
                found[rows] = linked @ mult[at]
                for row in np.flatnonzero(linked.any(axis=1)) if roots else ():
                    same = np.unique(forest.find(np.append(at[linked[row]], rows[row])))
                    forest.parent[same[1:]] = same[0]
        root = ids[forest.find(np.arange(len(ids)))]
        return pa.table({"id": pa.array(ids[query]), "found": pa.array(found[query]), "root": pa.array(root[query])})

    return met.select("task", "key", "id", "mult", "vec", "p.*").groupBy("task", "a", "b").applyInArrow(run, "id long, found long, root long")


def count_links(classes: DataFrame, components: DataFrame, threshold: float) -> DataFrame:
    """id, found: the links of every vector inside its component; vectors that are alone have no row.

    A link joins its ends, so no link that was found is outside; one that the search missed is counted too if other
    links connect its ends.
    """
    groups = store(classes.join(components, "id").select(F.col("component").cast("string").alias("key"), "id", "mult", "vec"), "groups")
    return compare(groups, threshold).groupBy("id").agg(F.sum("found").alias("found"))


def true_links(classes: DataFrame, threshold: float, most: int = AUDITED) -> dict[int, int] | None:
    """True links, with copies, of vectors drawn by hash order: ten times as many each time, until ``most`` of them have
    links or all are drawn; none if SAMPLE vectors are too few for that.

    The queries go to all executors and are compared with every row in blocks; one row a query and task is shuffled.
    """
    drawn = most
    while True:
        sample = classes.select("id", "label", "vec").orderBy(F.xxhash64("id", F.lit(1)), "id").limit(drawn).collect()
        truth = {r["id"]: 0 for r in sample} | compare_sample(classes, sample, threshold)
        if sum(n > 0 for n in truth.values()) >= most or len(sample) < drawn:
            return truth
        if drawn >= SAMPLE:
            return None
        drawn = min(10 * drawn, SAMPLE)


def compare_sample(classes: DataFrame, sample: list, threshold: float) -> dict[int, int]:
    """True links of the sampled rows, by brute force."""
    queries: dict[tuple[str, int], list] = {}
    for r in sample:
        queries.setdefault((r["label"], len(r["vec"])), []).append(r)
    asked = {key: (np.array([r["id"] for r in own]), np.frombuffer(b"".join(r["vec"] for r in own), "<f8").reshape(len(own), -1)) for key, own in queries.items()}
    shared = classes.sparkSession.sparkContext.broadcast(asked)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, int] = {}
        for batch in batches:
            frame = batch.to_pandas()
            for (label, size), part in frame.groupby([frame["label"], frame["vec"].str.len()]):
                if (label, size) in shared.value:
                    ids, vectors = shared.value[label, size]
                    x, others, mult = np.frombuffer(b"".join(part["vec"]), "<f8").reshape(len(part), -1), part["id"].to_numpy(), part["mult"].to_numpy()
                    for k in range(0, len(ids), QUERIES):
                        own = ids[k : k + QUERIES]
                        linked = (vectors[k : k + QUERIES] @ x.T >= threshold) & (own[:, None] != others[None])
                        for i, n in zip(own.tolist(), (linked @ mult).tolist(), strict=True):
                            total[i] = total.get(i, 0) + n
        yield pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.int64()), pa.array(total.values(), pa.int64())], names=["id", "n"])

    found = map_slices(classes.select("id", "label", "mult", "vec"), run, "id long, n long", VECTORS).groupBy("id").agg(F.sum("n").alias("n"))
    return {r["id"]: r["n"] for r in found.collect()}


def recall(truth: dict[int, int], counts: DataFrame) -> float:
    """The lower of two recalls of the vectors in ``truth``: over all their links, in which dense groups weigh most, and
    the mean over the vectors that have links, in which each weighs the same.  1 if none has a link."""
    true = {i: n for i, n in truth.items() if n}
    if not true:
        return 1.0
    asked = counts.sparkSession.createDataFrame([(i,) for i in true], "id long")
    found = {r["id"]: r["found"] for r in counts.join(F.broadcast(asked), "id").select("id", "found").collect()}
    hit = {i: max(0, n - abs(found.get(i, 0) - n)) for i, n in true.items()}  # links too many are as wrong as missing ones
    return min(sum(hit.values()) / sum(true.values()), sum(hit[i] / n for i, n in true.items()) / len(true))


def audit(classes: DataFrame, counts: DataFrame, threshold: float, most: int = AUDITED) -> float | None:
    """Recall of ``counts`` on sampled vectors; none if too few of them have links to judge on."""
    truth = true_links(classes, threshold, most)
    return None if truth is None else recall(truth, counts)


def link_vectors(rows: DataFrame, *, threshold: float = THRESHOLD, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """vec_id, n_links, component_id, kept, one row per input row.

    Vectors are linked if their labels are equal and their cosine in double precision is at least the threshold.
    Null labels, null ids, and vectors that are null, empty, zero or hold null or non-finite components link with
    nothing: n_links 0, component_id the own id.  Vectors of different length are not compared.  Equal vectors of a
    label are one class; its copies link with each other.  n_links counts each linked vector once, whatever shards
    hold it, and a link counts for both of its ends.  The recall of the links is at least RECALL on sampled vectors, or all
    vectors of a label are compared.  Rows that repeat an id with the same vector are one vector
    and get equal results.  Other columns are ignored; an empty table gives no rows.
    """
    ready = store(prepare(rows, id_col, vector_col, label_col), "vectors")
    classes = store(
        ready.where("digest is not null").groupBy("digest", "label").agg(F.min("vec_id").alias("id"), F.countDistinct("vec_id").alias("mult"), F.first("vec").alias("vec")),
        "vector-classes",
    )
    total = classes.count()
    centroids = fit_centroids(classes, total)
    # labels of one shard say nothing about those whose vectors search only some clusters: each kind is judged alone
    key = F.concat_ws(":", (F.length("vec") / 8).cast("int"), "label")
    spread = key.isin([f"{size}:{label}" for label, size in centroids])
    kinds = [classes.where(spread), classes.where(~spread)] if centroids else [classes]
    truths = [true_links(kind, threshold) for kind in kinds]

    def connect(links: DataFrame) -> tuple[DataFrame, DataFrame]:
        found = connected_components(links.where("id <> root").select(F.col("id").alias("a"), F.col("root").alias("b")))
        return found, store(count_links(classes, found, threshold), "counts")

    second = fit_second_level(classes, centroids)
    few = held_together(centroids, second)
    visited, beam = VISITED, BEAM
    for turn in range(WIDENINGS + 1):
        shards = store(shard(refine(deal(classes, centroids, visited, few), second, visited)), "shards")
        graph = store(build(shards), "graph")
        searched = store(search(shards, graph, threshold, beam), "searched")
        found, counts = connect(searched.select("id", "root"))
        low = [kind for kind, truth in zip(kinds, truths, strict=True) if truth is None or recall(truth, counts) < RECALL]
        if not low or None in truths:
            break
        visited, beam = 2 * visited, 2 * beam
    if low:
        # no evidence, or too low a recall after all widening: compare all with all there
        exact = reduce(DataFrame.unionAll, [compare(kind.select(key.alias("key"), "id", "mult", "vec"), threshold, roots=True).select("id", "root") for kind in low])
        found, counts = connect(searched.select("id", "root").unionAll(store(exact, "exact")))
    by_class = (
        classes.join(counts, "id", "left")
        .join(found, "id", "left")
        .select("digest", (F.coalesce("found", F.lit(0)) + F.col("mult") - 1).alias("links"), F.coalesce("component", "id").alias("class_component"))
    )
    component = F.coalesce("class_component", "vec_id")
    return (
        ready.select("vec_id", "digest")
        .join(by_class, "digest", "left")
        .select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
    )


ORACLE_SQL = f"""
with recursive v as (select vec_id, label, embedding::double[] as e from embeddings
  where label is not null and vec_id is not null and embedding is not null),
ok as (select * from v where len(list_filter(e, lambda x: x is null or not isfinite(x))) = 0
  and len(list_filter(e, lambda x: x <> 0)) > 0),
p as (select a.vec_id as a, b.vec_id as b from ok a join ok b on a.label = b.label and a.vec_id <> b.vec_id
  and len(a.e) = len(b.e) and list_cosine_similarity(a.e, b.e) >= {THRESHOLD}),
r(id, c) as (select vec_id, vec_id from ok union select p.b, r.c from r join p on r.id = p.a),
comp as (select id, min(c) as c from r group by id),
n as (select a as id, count(*) as n from p group by a)
select vec_id, coalesce(n.n, 0) as n_links, coalesce(comp.c, vec_id) as component_id, vec_id = coalesce(comp.c, vec_id) as kept
from embeddings left join comp on comp.id = vec_id left join n on n.id = vec_id
"""
