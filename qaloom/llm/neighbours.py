"""Approximate nearest neighbours by a forest of random-projection trees.

Equal vectors are one entry of the index with its smallest ids. A bounded sample of entries fits the trees: each node
splits at the median of a projection on the direction between two random entries. Every entry is placed in a leaf of every
tree. A query pops the leaves of all trees from one priority queue, best margin first, until they hold enough
entries, and its candidates in these leaves are scored exactly on the original vectors. An entry is one row that knows its
leaves in all trees and lies in a tile of the first tree; a query goes to the tiles that its leaves reach.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from qaloom.llm.common import sent
from qaloom.session import stage

TREES = 8
# Entries that fit the trees, and entries in a leaf as long as the sample allows that many leaves.
SAMPLE = 16_384
LEAF = 512
# A query searches leaves until they hold this share of all entries; entries count once for each tree, so the number of trees
# as a share is all. The vectors of the tables have no structure below their clusters, so a large share is needed.
SHARE = 1.5
# Leaves of the first tree that make a tile, rows of a side that meet in one task, and queries that are scored at once.
TILE_LEAVES = 16
TILE_QUERIES = 4_096
TILE_ENTRIES = 65_536
QUERIES = 256


def usable(vector: str) -> Column:
    """Whether a vector takes part: not null or zero, without null or non-finite components."""
    bad = F.exists(F.col(vector), lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    some = F.exists(F.col(vector), lambda x: x != 0)
    return F.coalesce(~bad & some, F.lit(False))


class Tree:
    """Inner nodes in arrays; a child is another node, or a leaf as ``-1 - leaf``."""

    def __init__(self, rows: np.ndarray, leaf: int, rng: np.random.Generator):
        self.normals: list[np.ndarray] = []
        self.cuts: list[float] = []
        self.children: list[list[int]] = []
        self.leaves = 0
        self.root = self._grow(rows, np.arange(len(rows)), leaf, rng)
        self.normals_ = np.array(self.normals).reshape(len(self.normals), rows.shape[1])

    def _grow(self, rows: np.ndarray, own: np.ndarray, leaf: int, rng: np.random.Generator) -> int:
        if len(own) > leaf:
            for _ in range(5):
                one, two = rng.choice(own, 2, replace=False)
                normal = rows[one] - rows[two]
                normal = normal / max(float(np.linalg.norm(normal)), 1e-300)
                along = rows[own] @ normal
                cut = float(np.median(along))
                low, high = own[along < cut], own[along >= cut]
                if len(low) and len(high):
                    node = len(self.cuts)
                    self.normals.append(normal)
                    self.cuts.append(cut)
                    self.children.append([0, 0])
                    self.children[node] = [self._grow(rows, low, leaf, rng), self._grow(rows, high, leaf, rng)]
                    return node
        self.leaves += 1
        return -self.leaves

    def place(self, rows: np.ndarray) -> np.ndarray:
        """The leaf of every row."""
        out = np.empty(len(rows), np.int64)
        todo = [(self.root, np.arange(len(rows)))]
        while todo:
            node, own = todo.pop()
            if node < 0:
                out[own] = -1 - node
            elif len(own):
                high = rows[own] @ self.normals_[node] >= self.cuts[node]
                todo += [(self.children[node][0], own[~high]), (self.children[node][1], own[high])]
        return out


class Forest:
    """Trees over a sample; once all entries were placed, ``counts`` has the entries of every leaf and ``reach`` its tiles."""

    def __init__(self, sample: np.ndarray, entries: int, trees: int, seed: int):
        rng = np.random.default_rng(seed)
        # As many leaves as hold LEAF entries each, if the sample has at least 8 rows for each of them.
        leaf = max(8, -(-len(sample) * LEAF // max(entries, 1)))
        self.sample = sample
        self.trees = [Tree(sample, min(leaf, max(1, len(sample))), rng) for _ in range(trees)]
        self.homes = np.array([tree.place(sample) for tree in self.trees])
        # The leaves of all trees in one row: leaf ``i`` of tree ``t`` stands at ``base[t] + i``.
        self.base = np.cumsum([0, *(tree.leaves for tree in self.trees)])
        self.counts: list[np.ndarray] = []
        self.reach = np.zeros((0, 0), bool)

    def search(self, query: np.ndarray, margins: list[np.ndarray], enough: float) -> list[tuple[int, int]]:
        """Leaves ``(tree, leaf)`` in the order of one queue over all trees, until they hold ``enough`` entries.

        A node is as good as the worst margin on its path; the far side of a split has the negative margin.
        """
        queue = [(-np.inf, t, tree.root) for t, tree in enumerate(self.trees)]
        heapq.heapify(queue)
        found: list[tuple[int, int]] = []
        held = 0.0
        while queue and held < enough:
            worst, t, node = heapq.heappop(queue)
            tree = self.trees[t]
            while node >= 0:
                margin = float(margins[t][node])
                low, high = tree.children[node]
                near, far = (high, low) if margin >= 0 else (low, high)
                heapq.heappush(queue, (max(worst, abs(margin)), t, far))
                node = near
            found.append((t, -1 - node))
            held += float(self.counts[t][-1 - node])
        return found


def _matrix(values: pa.Array) -> np.ndarray:
    """Rows of an Arrow list column without nulls as a matrix in double precision."""
    flat = values.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(values), -1) if len(values) else flat.reshape(0, 0)


def _exact(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Inner products row by row, summed in the same order for every pair."""
    return (one * two).sum(axis=1)


def entries(vectors: DataFrame, vec_id: str, vector: str, most: int) -> DataFrame:
    """``entry, vector, ids``: distinct vectors with their ``most`` smallest ids.

    No more than the ``most`` smallest ids of equal vectors can be among the nearest of anything. The smallest id names
    the entry. The rows of a very common vector meet first by the hash of their ids, then the best of each part.
    """
    rows = vectors.where(usable(vector)).select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).alias("vector"))
    rows = rows.where("vec_id IS NOT NULL").withColumn("_part", F.pmod(F.xxhash64("vec_id"), F.lit(64)))
    in_part = W.partitionBy("vector", "_part").orderBy("vec_id")
    first = rows.withColumn("_place", F.row_number().over(in_part)).where(F.col("_place") <= most)
    in_all = W.partitionBy("vector").orderBy("vec_id")
    best = first.withColumn("_place", F.row_number().over(in_all)).where(F.col("_place") <= most)
    lists = best.groupBy("vector").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    return stage(lists.select(F.col("ids")[0].alias("entry"), "vector", "ids"), "entries")


def _sampled(found: DataFrame, n: int, sample: int) -> np.ndarray:
    share = int(1_000_000 * min(1.0, sample / max(1, n)))
    drawn = found.where(F.pmod(F.xxhash64("entry"), F.lit(1_000_000)) < share).orderBy("entry").limit(sample).select("vector")
    return np.array([row[0] for row in drawn.collect()], np.float64)


def nearest(
    vectors: DataFrame,
    queries: Column,
    k: int = 20,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    trees: int = TREES,
    share: float = SHARE,
    sample: int = SAMPLE,
    seed: int = 1,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` largest inner products found for each row that ``queries`` selects.

    Candidates are all rows but the query's own; equal scores go to the smaller id. Vectors that are null, zero or
    hold null or non-finite components take no part, as do rows without id, and vectors of another length than most.
    Repeated ids are one row each. Other columns are not read.
    """
    lengths = vectors.where(usable(vector)).groupBy(F.size(vector).alias("d")).count().orderBy(F.desc("count"), "d").first()
    if lengths is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    vectors = vectors.where(F.size(vector) == lengths["d"]).select(F.col(vec_id), F.col(vector), queries.alias("_asks"))
    found = entries(vectors, vec_id, vector, k + 1)
    n = found.count()
    forest = Forest(_sampled(found, n, sample), n, trees, seed)
    spark = vectors.sparkSession
    grown = sent(spark, forest.trees)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = grown()
        for batch in batches:
            rows = _matrix(batch.column(1))
            homes = np.stack([tree.place(rows) for tree in trees], axis=1).astype(np.int32)
            leaves = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * len(trees), pa.int32()), pa.array(homes.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, leaves], names=["entry", "vector", "ids", "leaves"])

    kind = found.schema["vector"].dataType.simpleString()
    placed = found.mapInArrow(place, f"entry long, vector {kind}, ids array<long>, leaves array<int>")
    placed = stage(placed.withColumn("tile", F.floor(F.col("leaves")[0] / TILE_LEAVES)), "placed")
    # One row per leaf, each with at most as many numbers as there are tiles: the sample bounds both.
    held = placed.select("tile", F.posexplode("leaves").alias("tree", "leaf"))
    sizes = held.groupBy("tree", "leaf").agg(F.count("*").alias("n"), F.collect_set("tile").alias("tiles")).collect()
    forest.counts = [np.zeros(tree.leaves, np.int64) for tree in forest.trees]
    forest.reach = np.zeros((forest.base[-1], -(-forest.trees[0].leaves // TILE_LEAVES)), bool)
    for row in sizes:
        forest.counts[row["tree"]][row["leaf"]] = row["n"]
        forest.reach[forest.base[row["tree"]] + row["leaf"], row["tiles"]] = True
    ready = sent(spark, forest)
    enough = share * n

    asking = vectors.where("_asks").select(F.col(vec_id).cast("long").alias("query_id"), F.col(vector).alias("vector"))
    asking = asking.where(F.col("query_id").isNotNull() & usable("vector")).distinct()
    asking = stage(asking.join(found.select("vector", "entry"), "vector"), "asking")
    distinct = found.join(asking.select("entry").distinct(), "entry", "left_semi").select("entry", "vector")

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = ready()
        homes = forest.homes + forest.base[:-1, None]
        for batch in batches:
            rows = _matrix(batch.column(1))
            for begin in range(0, len(rows), QUERIES):
                part = rows[begin : begin + QUERIES]
                margins = [part @ t.normals_.T - np.array(t.cuts) if t.cuts else np.zeros((len(part), 0)) for t in forest.trees]
                near = part @ forest.sample.T
                probed = np.zeros((len(part), forest.base[-1]), bool)
                tiles, bounds = [], []
                for i in range(len(part)):
                    hits = forest.search(part[i], [m[i] for m in margins], enough)
                    probed[i, [forest.base[t] + leaf for t, leaf in hits]] = True
                    tiles.append(np.flatnonzero(forest.reach[probed[i]].any(axis=0)).tolist())
                    # A lower bound of the last place: the sample's rows in these leaves are candidates too.
                    scores = near[i][probed[i][homes].any(axis=0)]
                    bounds.append(np.partition(scores, -k - 1)[-k - 1] if len(scores) > k else -np.inf)
                leaves = [row.tobytes() for row in np.packbits(probed, axis=1)]
                columns = [batch.column(0).slice(begin, len(part)), batch.column(1).slice(begin, len(part))]
                columns += [pa.array(tiles, pa.list_(pa.int64())), pa.array(leaves, pa.binary()), pa.array(bounds, pa.float64())]
                yield pa.RecordBatch.from_arrays(columns, names=["query", "vector", "tiles", "leaves", "bound"])

    probes = distinct.mapInArrow(probe, f"query long, vector {kind}, tiles array<long>, leaves binary, bound double")
    probes = stage(probes, "probes")
    flat = _score(placed, probes, forest.base, k).select("query", "score", F.explode("ids").alias("vec_id"))
    order = W.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    flat = stage(flat.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k + 1), "nearest")
    # Every member of a query's entry leaves its own row out.
    answers = asking.select("query_id", F.col("entry").alias("query")).join(flat, "query").where("query_id <> vec_id")
    ranked = answers.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy("place")))
    return ranked.where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _score(placed: DataFrame, probes: DataFrame, base: np.ndarray, k: int) -> DataFrame:
    """``query, score, ids``: the best candidates of every query in every tile, in leaves that it probes.

    A tile is a row of neighbouring leaves of the first tree, so an entry meets a query once, whichever trees lead there.
    The sides of a tile are cut into parts of bounded size, and each pair of parts meets in one task.
    """
    parts = placed.groupBy("tile").agg(F.ceil(F.count("*") / TILE_ENTRIES).alias("e_parts"))
    probes = probes.withColumn("tile", F.explode("tiles")).drop("tiles")
    asked = probes.groupBy("tile").agg(F.ceil(F.count("*") / TILE_QUERIES).alias("q_parts"))
    # One row per tile: bounded by the leaves of a tree.
    both = F.broadcast(stage(parts.join(asked, "tile"), "tiles"))
    left = placed.join(both, "tile").withColumn("e", F.pmod(F.xxhash64("entry"), "e_parts"))
    left = left.withColumn("q", F.explode(F.sequence(F.lit(0).cast("long"), F.col("q_parts") - 1)))
    right = probes.join(both, "tile").withColumn("q", F.pmod(F.xxhash64("query"), "q_parts"))
    right = right.withColumn("e", F.explode(F.sequence(F.lit(0).cast("long"), F.col("e_parts") - 1)))
    key = ["tile", "e", "q"]
    left = left.select(*key, "vector", "ids", "leaves")
    right = right.select(*key, "query", "vector", "leaves", "bound")

    def meet(entries: pa.Table, queries: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if entries.num_rows and queries.num_rows:
            rows, asks = _matrix(entries["vector"].combine_chunks()), _matrix(queries["vector"].combine_chunks())
            homes = entries["leaves"].combine_chunks().flatten().to_numpy().reshape(len(rows), -1) + base[:-1]
            bound = queries["bound"].to_numpy()
            bits = np.frombuffer(b"".join(queries["leaves"].to_pylist()), np.uint8).reshape(len(asks), -1)
            by_leaf = np.argsort(homes[:, 0], kind="stable")
            pieces = np.split(by_leaf, np.flatnonzero(np.diff(homes[by_leaf, 0])) + 1)
            for begin in range(0, len(asks), QUERIES):
                some = np.arange(begin, min(begin + QUERIES, len(asks)))
                # Leaves by rows, so that an entry's leaf picks the queries that probe it.
                probed = np.unpackbits(bits[some], axis=1, count=int(base[-1])).T.astype(bool)
                for own in pieces:
                    hit = np.zeros((len(own), len(some)), bool)
                    for tree in range(homes.shape[1]):
                        hit |= probed[homes[own, tree]]
                    scores = asks[some] @ rows[own].T
                    size = np.abs(scores).max(axis=1, initial=0)
                    scores[~hit.T] = -np.inf
                    least = bound[some]
                    if len(own) > k + 1:
                        least = np.maximum(least, np.partition(scores, -k - 1, axis=1)[:, -k - 1])
                    # Room for the rounding of the product; the exact score decides.
                    room = 1e-9 * (np.where(np.isfinite(least), np.abs(least), 0.0) + size)
                    q, e = np.nonzero(hit.T & (scores >= (least - room)[:, None]))
                    out.append((some[q], own[e], _exact(asks[some[q]], rows[own[e]])))
        q, e, scores = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.empty(0, np.int64),) * 2 + (np.empty(0),)
        ids = entries["ids"].combine_chunks().take(pa.array(e, pa.int64())) if entries.num_rows else pa.array([], pa.list_(pa.int64()))
        return pa.table([queries["query"].combine_chunks().take(pa.array(q, pa.int64())), pa.array(scores), ids], names=["query", "score", "ids"])

    sides = left.groupBy(*key).cogroup(right.groupBy(*key))
    return sides.applyInArrow(meet, "query long, score double, ids array<long>")
