"""Exact cosine search that skips what cannot matter, over an index of cells around pivots.

Every vector lies in the cell of its nearest pivot, in a folder of its own, sorted by its cosine to the pivot. Angles obey
the triangle inequality: a query at angle a from a pivot is at least as far from a vector of the cell as a differs
from that vector's angle to the pivot. So the least and largest cosine in a cell bound what a query can find
there. The cells with the best bounds are searched first; their k-th best score is the query's bar, and only cells whose
bound reaches the bar of some query are read at all. Inside a cell the same bound drops runs of vectors before they are
scored. The result is that of the full search.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from qaloom import prompts
from qaloom.operators.ranking import SCORE_DECIMALS, top_k
from qaloom.operators.tiles import CACHED_CELLS, SCORE_CELLS, at_least, best_per_row, nth_best, single_error, smallest, unit_rows, usable
from qaloom.session import scratch_path

# Vectors that place the pivots (drawn by the hash of their ids), and rounds of moving them.
SAMPLE = 16_384
ROUNDS = 4
# There are so many vectors to a pivot, as long as that takes no more pivots than this.
CELL_ROWS = 4_096
MOST_PIVOTS = 4_096
# Queries times cells, and queries times dimensions, of one pass over the index; more queries take several passes.
QUERY_CELLS = 1 << 22
QUERY_ELEMENTS = 1 << 21
# Neighbouring vectors of a cell that are kept or dropped together, and hits that a task holds per query before it sorts.
RUN = 512
HELD = 4
# The cell of vectors of length 0, whose cosine with everything is 0.
NO_PIVOT = -1
# Wider than the decimals at which scores are compared.
MARGIN = 2 * 10.0**-SCORE_DECIMALS


@dataclass(frozen=True)
class PivotIndex:
    """``vectors``: ``cell, near, doc_id, vector``; per cell its rows and the range of ``near``, the cosine to its pivot."""

    vectors: DataFrame
    pivots: np.ndarray
    rows: np.ndarray
    least: np.ndarray
    most: np.ndarray


def pivot_index(corpus: DataFrame, path: str | None = None, doc_id: str = "doc_id", vector: str = "vector", seed: int = 1) -> PivotIndex:
    """Write the index of a corpus (to ``path``, which must not exist, or to the scratch folder) and open it.

    A vector takes part if it has the commonest length and only finite components, and its row an id.
    """
    spark = corpus.sparkSession
    path = path or scratch_path(spark, "pivot-index")
    rows = corpus.select(F.col(doc_id).alias("doc_id"), F.col(vector).alias("vector")).where("doc_id IS NOT NULL")
    lengths = rows.where(F.size("vector") > 0).groupBy(F.size("vector").alias("d")).agg(F.count("*").alias("n"))
    common = lengths.orderBy(F.desc("n"), "d").first()
    dimensions = common["d"] if common else 0
    rows = rows.where(usable("vector", dimensions))
    n = rows.count()
    share = int(1_000_000 * min(1.0, SAMPLE / max(1, n)))
    drawn = rows.where(F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1_000_000)) < share).limit(SAMPLE).select("vector").toArrow()
    pivots = _placed(unit_rows(drawn["vector"]), max(1, min(MOST_PIVOTS, -(-n // CELL_ROWS))), np.random.default_rng(seed))
    held = spark.sparkContext.broadcast(pivots)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres = held.value
        for batch in batches:
            units = unit_rows(batch.column(1))
            cell, near = np.full(len(units), NO_PIVOT), np.zeros(len(units))
            for part in np.array_split(np.flatnonzero(units.any(axis=1)), -(-max(1, len(units) * len(centres)) // SCORE_CELLS)):
                if len(part) and len(centres):
                    scores = units[part] @ centres.T
                    cell[part] = scores.argmax(axis=1)
                    near[part] = scores[np.arange(len(part)), cell[part]]
            yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), pa.array(near), *batch.columns], names=["cell", "near", "doc_id", "vector"])

    kinds = {name: rows.schema[name].dataType.simpleString() for name in rows.columns}
    placed = rows.mapInArrow(assign, f"cell int, near double, doc_id {kinds['doc_id']}, vector {kinds['vector']}")
    # Copies of a vector are equally near their pivot, so their ids spread them.
    placed = placed.repartitionByRange("cell", F.desc("near"), F.xxhash64("doc_id")).sortWithinPartitions("cell", F.desc("near"))
    placed.write.partitionBy("cell").parquet(f"{path}/vectors")
    found = spark.read.schema(f"near double, doc_id {kinds['doc_id']}, vector {kinds['vector']}, cell int").parquet(f"{path}/vectors")
    sizes = found.groupBy("cell").agg(F.count("*").alias("rows"), F.min("near").alias("least"), F.max("near").alias("most"))
    # One row per pivot, with the pivot itself.
    centres = spark.createDataFrame([(i, p) for i, p in enumerate(pivots.tolist())], "cell int, pivot array<double>")
    sizes.join(centres, "cell", "full").coalesce(1).write.parquet(f"{path}/cells")
    found.limit(0).write.parquet(f"{path}/shape")
    return open_pivot_index(spark, path)


def open_pivot_index(spark: SparkSession, path: str) -> PivotIndex:
    """An index written earlier by :func:`pivot_index`."""
    kinds = spark.read.parquet(f"{path}/shape").schema
    cells = {row["cell"]: row for row in spark.read.parquet(f"{path}/cells").collect()}
    pivots = np.array([cells[i]["pivot"] for i in range(len(cells) - (NO_PIVOT in cells))], np.float64)
    order = [*range(len(pivots)), NO_PIVOT]
    figure = lambda name: np.array([(cells[i][name] if i in cells else 0) or 0 for i in order])
    vectors = spark.read.schema(kinds).parquet(f"{path}/vectors")
    return PivotIndex(vectors, pivots, figure("rows"), figure("least"), figure("most"))


def _placed(sample: np.ndarray, n: int, rng: np.random.Generator) -> np.ndarray:
    """Up to ``n`` unit vectors in the middle of the sample's vectors that are nearest to them."""
    sample = np.unique(sample[sample.any(axis=1)], axis=0)
    pivots = sample[rng.permutation(len(sample))[:n]]
    for _ in range(ROUNDS if len(pivots) > 1 else 0):
        home = np.concatenate([(part @ pivots.T).argmax(axis=1) for part in np.array_split(sample, -(-len(sample) * len(pivots) // SCORE_CELLS))])
        sums = np.zeros_like(pivots)
        np.add.at(sums, home, sample)
        norms = np.linalg.norm(sums, axis=1)
        pivots = np.where((norms > 1e-9)[:, None], sums / np.maximum(norms, 1e-9)[:, None], pivots)
    return pivots


def reach(near: np.ndarray, least: np.ndarray, most: np.ndarray) -> np.ndarray:
    """The largest cosine of a query, at cosine ``near`` from a pivot, with vectors whose cosine to it lies in a range."""
    angle, far, close = (np.arccos(np.clip(x, -1, 1)) for x in (near, least, most))
    return np.cos(np.maximum(0, np.maximum(angle - far, close - angle)))


def pivot_search(
    queries: DataFrame,
    index: PivotIndex,
    k: int = prompts.TOP_K,
    query_id: str = "query_id",
    vector: str = "vector",
    exclude_same_id: bool = False,
    report: dict[str, int] | None = None,
) -> DataFrame:
    """Top ``k`` vectors of the index per query vector by cosine: ``query_id, doc_id, score, rank``.

    Queries whose vectors have another length than the index, or a component that is null or not finite, take no part.
    A ``report`` gets the numbers of cells, of cells read, and of pairs of a query and a vector in all and in cells searched.
    """
    dimensions = index.pivots.shape[1] if len(index.pivots) else 0
    left = queries.select(F.col(query_id).alias("query_id"), F.col(vector).alias("vector")).where("query_id IS NOT NULL")
    if dimensions:
        left = left.where(usable("vector", dimensions))
    n = left.count()
    at_once = max(1, min(QUERY_CELLS // max(1, len(index.rows)), QUERY_ELEMENTS // max(1, dimensions)))
    passes = max(1, -(-n // at_once))
    part = F.pmod(F.xxhash64("query_id", F.lit(3)), F.lit(passes)).cast("int")
    if passes > 1:
        # A pass reads its own folder.
        path = scratch_path(left.sparkSession, "pivot-queries")
        parted = left.withColumn("_pass", part).repartition(passes, "_pass")
        parted.write.partitionBy("_pass").parquet(path)
        left, part = left.sparkSession.read.schema(parted.schema).parquet(path), F.col("_pass")
    found = [_pass(left.where(part == i).select("query_id", "vector"), index, k, exclude_same_id, report) for i in range(passes)]
    united = found[0]
    for more in found[1:]:
        united = united.unionByName(more)
    return united


def _pass(left: DataFrame, index: PivotIndex, k: int, exclude_same_id: bool, report: dict[str, int] | None) -> DataFrame:
    asked = left.toArrow()
    units = unit_rows(asked["vector"])
    zero = ~units.any(axis=1)
    # A row per query, a column per cell; the last cell is that of vectors of length 0.
    bounds = np.zeros((len(units), len(index.rows)))
    if len(units) and len(index.pivots):
        bounds[:, :-1] = reach(units @ index.pivots.T, index.least[:-1], index.most[:-1])
    bounds[zero] = 0.0
    bounds[:, index.rows == 0] = -np.inf
    order = np.argsort(-bounds, axis=1, kind="stable")
    before = np.cumsum(index.rows[order], axis=1) - index.rows[order]
    first = np.zeros(bounds.shape, bool)
    # The best cells, until they hold k vectors besides the query's own.
    np.put_along_axis(first, order, before < k + exclude_same_id, axis=1)
    first &= index.rows > 0
    seeds = _scan(left, asked, units, first, np.full(len(units), -np.inf), index, k, exclude_same_id)
    path = scratch_path(left.sparkSession, "pivot-seeds")
    seeds.write.parquet(path)
    seeds = left.sparkSession.read.schema(seeds.schema).parquet(path)
    bar = np.full(len(units), -np.inf)
    last = top_k(seeds, k, ["_row"]).where(F.col("rank") == k).select("_row", "score").toArrow()
    bar[last["_row"].to_numpy()] = last["score"].to_numpy() - MARGIN
    rest = (bounds >= bar[:, None]) & ~first & (index.rows > 0)
    if report is not None:
        report["cells"] = report.get("cells", 0) + int((index.rows > 0).sum())
        report["cells_read"] = report.get("cells_read", 0) + int((first | rest).any(axis=0).sum())
        report["pairs"] = report.get("pairs", 0) + len(units) * int(index.rows.sum())
        report["pairs_searched"] = report.get("pairs_searched", 0) + int(((first | rest) * index.rows).sum())
    hits = seeds.unionByName(_scan(left, asked, units, rest, bar, index, k, exclude_same_id))
    return top_k(hits, k, ["_row"]).select("query_id", "doc_id", "score", "rank")


def _scan(
    left: DataFrame, asked: pa.Table, units: np.ndarray, wanted: np.ndarray, bar: np.ndarray, index: PivotIndex, k: int, exclude_same_id: bool
) -> DataFrame:
    """``_row, query_id, doc_id, score``: the best ``k`` of every query in every task, in the cells that it wants."""
    ids = asked["query_id"].to_numpy()
    read = np.flatnonzero(wanted.any(axis=0))
    cells = [int(c) if c < len(index.pivots) else NO_PIVOT for c in read]
    askers = {cell: np.flatnonzero(wanted[:, c]).astype(np.int32) for cell, c in zip(cells, read, strict=True)}
    held = left.sparkSession.sparkContext.broadcast((units, ids, askers, bar, index.pivots))
    kind = left.schema["query_id"].dataType.simpleString()
    doc_kind = index.vectors.schema["doc_id"].dataType.simpleString()
    asked_kind = asked.schema.field("query_id").type

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units, ids, askers, bar, pivots = held.value
        single, zero, error = units.astype(np.float32), ~units.any(axis=1), single_error(units.shape[1])
        # The bars rise with the best hits so far.
        hits, doc_kind = _Hits(k, bar.copy()), None
        for batch in batches:
            doc_kind = batch.schema.field("doc_id").type
            cell, near = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            docs, rows = batch.column(2).to_numpy(zero_copy_only=False), unit_rows(batch.column(3))
            single_rows = rows.astype(np.float32)
            # Runs of neighbours within one cell.
            edges = np.unique(np.concatenate([np.flatnonzero(np.diff(cell)) + 1, np.arange(0, len(cell), RUN), [len(cell)]]))
            for begin, end in zip(edges[:-1], edges[1:], strict=True):
                who, found = askers[int(cell[begin])], docs[begin:end]
                if (nulls := who[zero[who]]).size:
                    # A query of length 0 scores 0 with all, so the smallest ids are its best.
                    some = found[smallest(found, k)]
                    row, doc = np.repeat(nulls, len(some)), np.tile(some, len(nulls))
                    other = ids[row] != doc if exclude_same_id else np.full(len(row), True)
                    hits.add(row[other], doc[other], np.zeros(int(other.sum())))
                    who = who[~zero[who]]
                if cell[begin] != NO_PIVOT:
                    own = near[begin:end]
                    bound = reach(units[who] @ pivots[cell[begin]], own.min(), own.max())
                    who = who[bound >= hits.bar[who]]
                else:
                    who = who[hits.bar[who] <= 0]
                for some in np.array_split(who, -(-len(who) * (end - begin) // CACHED_CELLS)) if len(who) else ():
                    scores = single[some] @ single_rows[begin:end].T
                    least = hits.bar[some] - error
                    if (unbarred := np.flatnonzero(np.isneginf(least))).size:
                        if exclude_same_id:
                            scores[ids[some][:, None] == found] = -np.inf
                        least[unbarred] = nth_best(scores[unbarred], k) - 2 * error - MARGIN
                    q, d = np.divmod(at_least(scores, least), end - begin)
                    exact = np.einsum("ij,ij->i", units[some[q]], rows[begin:end][d])
                    kept = exact >= hits.bar[some[q]]
                    if exclude_same_id:
                        kept &= ids[some[q]] != found[d]
                    hits.add(some[q[kept]], found[d[kept]], exact[kept])
        if doc_kind is not None:
            row, found, scores = hits.best()
            columns = [pa.array(row, pa.int64()), pa.array(ids[row]).cast(asked_kind), pa.array(found).cast(doc_kind), pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=["_row", "query_id", "doc_id", "score"])

    vectors = index.vectors.select("cell", "near", "doc_id", "vector").where(F.col("cell").isin(cells))
    return vectors.mapInArrow(run, f"_row long, query_id {kind}, doc_id {doc_kind}, score double")


class _Hits:
    """The best ``k`` hits of every query over parts as they come, and the score that a further hit has to reach."""

    def __init__(self, k: int, bar: np.ndarray):
        self.k, self.bar, self.parts, self.held, self.last = k, bar, [], 0, 1 << 16

    def add(self, rows: np.ndarray, found: np.ndarray, scores: np.ndarray) -> None:
        self.parts.append((rows, found, scores))
        self.held += len(rows)
        if self.held > HELD * self.last:
            self.parts = [self.best()]
            self.held = len(self.parts[0][0])
            self.last = max(self.last, self.held)

    def best(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if not self.parts:
            return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        rows, found, scores = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        values = np.round(scores, SCORE_DECIMALS)
        keep = best_per_row(rows, values, found, self.k)
        counts = np.bincount(rows[keep], minlength=len(self.bar))
        full = counts == self.k
        self.bar[full] = np.maximum(self.bar[full], values[keep][(np.cumsum(counts) - 1)[full]] - MARGIN)
        return rows[keep], found[keep], scores[keep]
