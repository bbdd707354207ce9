"""Vector search: exact cosine top-k, over a plain corpus or an index of pivots, and re-scoring of lexical candidates."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qaloom import prompts
from qaloom.operators.blockmax import BlockIndex
from qaloom.operators.lexical import LexicalIndex, bm25_search
from qaloom.operators.pivots import PivotIndex, pivot_search
from qaloom.operators.ranking import SCORE_DECIMALS, top_k
from qaloom.operators.skew import fetch
from qaloom.operators.tiles import LEFT_ROWS, RIGHT_ROWS, BestHits, blocks_for, tiled, unit_rows, usable

# Rows of a tile's right side that are scored together.
RIGHT_SLICE = 8_192
# Tiles of a core, as long as their left sides keep so many rows.
TILES_PER_CORE = 4
LEAST_ROWS = 1_024


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine of two array columns, computed in doubles; 0 where a vector is zero."""
    a, b = (F.col(c) if isinstance(c, str) else c for c in (a, b))

    def dot(x: Column, y: Column) -> Column:
        products = F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double"))
        return F.aggregate(products, F.lit(0.0), lambda acc, p: acc + p)

    return F.coalesce(F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))), F.lit(0.0))


# The queries are handed to every task while they are no more than this, and the corpus is not shuffled then.
BROADCAST_QUERIES = 32_768
BROADCAST_ELEMENTS = 1 << 21


def dense_search(
    queries: DataFrame,
    corpus: DataFrame | PivotIndex,
    k: int = prompts.TOP_K,
    query_id: str = "query_id",
    doc_id: str = "doc_id",
    vector: str = "vector",
    exclude_same_id: bool = False,
    broadcast: bool | None = None,
) -> DataFrame:
    """Top ``k`` corpus vectors per query vector by cosine: ``query_id, doc_id, score, rank``.

    Exact. Queries that were counted and are few go to every task, which keeps ``k`` rows per query while it reads its
    part of the corpus; otherwise blocks of both sides meet in tiles, and at most ``k`` rows per query leave a tile.
    Scores are computed in slices of bounded size either way. Ids have to be integers or strings and unique per table.

    A vector takes part if it has the commonest length of the query vectors and only finite components: a null, NaN
    or infinite component, or another length, takes its row out and nothing else. A zero vector has cosine 0.

    A corpus that was indexed by its pivots (:mod:`qaloom.operators.pivots`) is read in part only, with the same result.
    """
    if isinstance(corpus, PivotIndex):
        return pivot_search(queries, corpus, k, query_id, vector, exclude_same_id)
    left = queries.select(F.col(query_id).alias("query_id"), F.col(vector).alias("vector")).where("query_id IS NOT NULL")
    right = corpus.select(F.col(doc_id).alias("doc_id"), F.col(vector).alias("vector")).where("doc_id IS NOT NULL")
    id_types = (left.schema["query_id"].dataType.simpleString(), right.schema["doc_id"].dataType.simpleString())
    schema = f"query_id {id_types[0]}, doc_id {id_types[1]}, score double"
    lengths = left.where(F.size("vector") > 0).groupBy(F.size("vector").alias("d")).agg(F.count("*").alias("n"))
    common = lengths.orderBy(F.desc("n"), "d").first()
    dimensions = common["d"] if common else 0
    left, right = left.where(usable("vector", dimensions)), right.where(usable("vector", dimensions))
    n_left = left.count()
    if broadcast is None:
        broadcast = n_left <= BROADCAST_QUERIES and n_left * dimensions <= BROADCAST_ELEMENTS
    if broadcast:
        winners = _against_all(left, right, k, exclude_same_id, schema)
    else:
        winners = _in_tiles(left, right, n_left, dimensions, k, exclude_same_id, schema)
    return top_k(winners, k, ["query_id"]).select("query_id", "doc_id", "score", "rank")


def _hits(best: BestHits) -> list[pa.Array]:
    rows, found, scores = best.hits
    return [pa.array(best.ids[rows]), pa.array(found), pa.array(scores, pa.float64())]


def _against_all(left: DataFrame, right: DataFrame, k: int, exclude_same_id: bool, schema: str) -> DataFrame:
    asked = left.toArrow()
    ids = asked["query_id"].to_numpy()
    held = left.sparkSession.sparkContext.broadcast((unit_rows(asked["vector"]), ids))
    asked_kind = asked.schema.field("query_id").type

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = BestHits(*held.value, k, SCORE_DECIMALS, exclude_same_id)
        kind = None
        for batch in batches:
            kind = batch.schema.field(0).type
            best.add(unit_rows(batch.column(1)), batch.column(0).to_numpy(zero_copy_only=False))
        if kind is not None:
            asked_ids, found, scores = _hits(best)
            yield pa.RecordBatch.from_arrays(
                [asked_ids.cast(asked_kind), found.cast(kind), scores], names=["query_id", "doc_id", "score"]
            )

    return right.mapInArrow(run, schema)


def _in_tiles(
    left: DataFrame, right: DataFrame, n_left: int, dimensions: int, k: int, exclude_same_id: bool, schema: str
) -> DataFrame:
    def search_tile(lt: pa.Table, rt: pa.Table) -> pa.Table:
        kinds = (lt.schema.field("query_id").type, rt.schema.field("doc_id").type)
        best = BestHits(unit_rows(lt["vector"]), lt["query_id"].to_numpy(), k, SCORE_DECIMALS, exclude_same_id)
        for begin in range(0, rt.num_rows, RIGHT_SLICE):
            part = rt.slice(begin, RIGHT_SLICE)
            best.add(unit_rows(part["vector"]), part["doc_id"].to_numpy())
        found = _hits(best)
        return pa.table([found[0].cast(kinds[0]), found[1].cast(kinds[1]), found[2]], names=["query_id", "doc_id", "score"])

    # Blocks are large, since each row goes to all blocks of the other side, as long as all cores have tiles.
    n_right = blocks_for(right.count(), dimensions, RIGHT_ROWS)
    wanted = -(-TILES_PER_CORE * left.sparkSession.sparkContext.defaultParallelism // n_right)
    most = blocks_for(n_left, dimensions, LEAST_ROWS)
    parts = max(blocks_for(n_left, dimensions, LEFT_ROWS), min(wanted, most)), n_right
    return tiled(left, right, "query_id", "doc_id", *parts, partitions=2 * parts[0] * parts[1]).applyInArrow(search_tile, schema)


def rerank(
    hits: DataFrame, query_vectors: DataFrame, doc_vectors: DataFrame, k: int = prompts.TOP_K, vector: str = "vector"
) -> DataFrame:
    """Re-score candidate hits by cosine and keep the best ``k`` per query."""
    q = query_vectors.select("query_id", F.col(vector).alias("_q"))
    d = doc_vectors.select("doc_id", F.col(vector).alias("_d"))
    pairs = fetch(hits.select("query_id", "doc_id"), d, "doc_id", "query_id").join(q, "query_id")
    rescored = pairs.select("query_id", "doc_id", cosine("_q", "_d").alias("score"))
    return top_k(rescored, k, ["query_id"]).select("query_id", "doc_id", "score", "rank")


def rerank_search(
    queries: DataFrame,
    corpus: DataFrame | LexicalIndex | BlockIndex,
    query_vectors: DataFrame,
    doc_vectors: DataFrame,
    k: int = prompts.TOP_K,
    candidates: int = 50,
    **columns: str,
) -> DataFrame:
    """Two-stage search: lexical candidates, re-scored by cosine."""
    return rerank(bm25_search(queries, corpus, candidates, **columns), query_vectors, doc_vectors, k)


def side_by_side(runs: dict[str, DataFrame]) -> DataFrame:
    """Hits of several search modes as one table with a ``mode`` column."""
    tables = [hits.select(F.lit(mode).alias("mode"), *hits.columns) for mode, hits in runs.items()]
    united = tables[0]
    for table in tables[1:]:
        united = united.unionByName(table)
    return united
