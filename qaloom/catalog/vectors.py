"""Vector search queries and the comparison of search modes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from qaloom.catalog.tables import (
    SQL_POSTINGS,
    SQL_QUERIES,
    corpus,
    queries,
    sql_bm25,
    sql_top,
    table,
)
from qaloom.operators.dense import cosine, dense_search, rerank_search
from qaloom.operators.pivots import open_pivot_index, pivot_index
from qaloom.plans.evaluate import search_both_modes
from qaloom.session import scratch_path, stage

CANDIDATES = 50


def vectors(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias(name), F.col("embedding").alias("vector"))


def text_vectors(spark: SparkSession, sf_dir: str, texts: DataFrame, key: str) -> DataFrame:
    """Stand-in text vectors: text number i has the vector i modulo the number of vectors."""
    known = table(spark, sf_dir, "embeddings")
    numbered = known.select(F.col("vec_id").alias("_vec"), F.col("embedding").alias("vector"))
    return texts.select(key, F.pmod(F.col(key), F.lit(known.count())).alias("_vec")).join(numbered, "_vec").drop("_vec")


def dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten nearest other vectors of every vector."""
    hits = dense_search(
        vectors(spark, sf_dir, "query_id"), vectors(spark, sf_dir, "doc_id"), exclude_same_id=True
    )
    return hits.withColumn("score", F.round("score", 6))


def rerank_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fifty lexical candidates per passage, re-scored by cosine, ten best."""
    asked, documents = queries(spark, sf_dir), corpus(spark, sf_dir)
    hits = rerank_search(
        asked,
        documents,
        text_vectors(spark, sf_dir, asked, "query_id"),
        text_vectors(spark, sf_dir, documents, "doc_id"),
        candidates=CANDIDATES,
    )
    return hits.withColumn("score", F.round("score", 6))


def both_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked, documents = queries(spark, sf_dir), corpus(spark, sf_dir)
    return search_both_modes(
        asked,
        documents,
        text_vectors(spark, sf_dir, asked, "query_id"),
        text_vectors(spark, sf_dir, documents, "doc_id"),
    )


def mode_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per passage: how many of the ten keyword hits the semantic mode shows as well, and whether the first agrees."""
    hits = stage(both_modes(spark, sf_dir), "hits")
    best = F.min(F.when(F.col("rank") == 1, F.col("doc_id")))
    per_mode = hits.groupBy("query_id").pivot("mode", ["keyword", "semantic"]).agg(best)
    shared = hits.groupBy("query_id", "doc_id").agg(F.count("*").alias("modes"))
    overlap = shared.groupBy("query_id").agg(F.count_if(F.col("modes") == 2).alias("shared_hits"))
    found = queries(spark, sf_dir).select("query_id").join(per_mode.join(overlap, "query_id"), "query_id", "left")
    return found.select(
        "query_id",
        F.col("keyword").alias("keyword_first"),
        F.col("semantic").alias("semantic_first"),
        F.coalesce("shared_hits", F.lit(0)).alias("shared_hits"),
        F.coalesce((F.col("keyword") == F.col("semantic")).cast("int"), F.lit(0)).alias("same_first"),
    )


HARD_VECTORS = """
SELECT vec_id, CASE vec_id % 50
  WHEN 1 THEN NULL
  WHEN 2 THEN transform(embedding, (x, i) -> IF(i = 3, float('NaN'), x))
  WHEN 3 THEN transform(embedding, (x, i) -> IF(i = 5, NULL, x))
  WHEN 4 THEN transform(embedding, x -> float(0))
  WHEN 5 THEN slice(embedding, 1, 8)
  ELSE embedding END AS vector
FROM {vectors}"""


def dense_topk_hard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten nearest in tiles, where some vectors are null, zero, short or have a null or NaN component."""
    hard = spark.sql(HARD_VECTORS, vectors=table(spark, sf_dir, "embeddings"))
    asked, known = hard.withColumnRenamed("vec_id", "query_id"), hard.withColumnRenamed("vec_id", "doc_id")
    hits = dense_search(asked, known, exclude_same_id=True, broadcast=False)
    return hits.withColumn("score", F.round("score", 6))


def dense_topk_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten nearest other vectors of every vector, from an index of pivots that was written and opened again."""
    path = scratch_path(spark, "pivots")
    pivot_index(vectors(spark, sf_dir, "doc_id"), path)
    hits = dense_search(vectors(spark, sf_dir, "query_id"), open_pivot_index(spark, path), exclude_same_id=True)
    return hits.withColumn("score", F.round("score", 6))


def dense_topk_pivots_hard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten nearest by pivots, where some vectors are null, zero, short or have a null or NaN component."""
    hard = spark.sql(HARD_VECTORS, vectors=table(spark, sf_dir, "embeddings"))
    index = pivot_index(hard.withColumnRenamed("vec_id", "doc_id"))
    hits = dense_search(hard.withColumnRenamed("vec_id", "query_id"), index, exclude_same_id=True)
    return hits.withColumn("score", F.round("score", 6))


def vector_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cosine of every vector with itself reversed: the row-level cosine expression."""
    flipped = F.reverse("embedding")
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(cosine("embedding", flipped), 6).alias("cosine"))


QUERIES = {
    "dense_topk": dense_topk,
    "dense_topk_hard": dense_topk_hard,
    "dense_topk_pivots": dense_topk_pivots,
    "dense_topk_pivots_hard": dense_topk_pivots_hard,
    "rerank_topk": rerank_topk,
    "mode_comparison": mode_comparison,
    "cosine_expression": vector_norms,
}

SQL_VECTOR_PAIRS = """
sized AS (SELECT count(*) AS n_vec FROM embeddings),
vec AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"""

SQL_RERANK = f"""
candidates AS ({sql_top('bm25', CANDIDATES)}),
rescored AS (
  SELECT c.query_id, c.doc_id, list_cosine_similarity(q.v, d.v) AS score
  FROM candidates c, sized JOIN vec q ON q.vec_id = c.query_id % n_vec JOIN vec d ON d.vec_id = c.doc_id % n_vec
)"""

SQL_BOTH_MODES = f"""{SQL_QUERIES}, {SQL_POSTINGS}, {sql_bm25()}, {SQL_VECTOR_PAIRS},
cosines AS (
  SELECT c.query_id, d.doc_id, list_cosine_similarity(q.v, e.v) AS score
  FROM queries c, documents d, sized JOIN vec q ON q.vec_id = c.query_id % n_vec JOIN vec e ON e.vec_id = d.doc_id % n_vec
),
hits AS (
  SELECT 'keyword' AS mode, * FROM ({sql_top('bm25')})
  UNION ALL SELECT 'semantic' AS mode, * FROM ({sql_top('cosines')})
)"""

SQL = {
    "dense_topk": f"""
WITH vec AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
scored AS (
  SELECT q.vec_id AS query_id, d.vec_id AS doc_id, list_cosine_similarity(q.v, d.v) AS score
  FROM vec q, vec d WHERE q.vec_id <> d.vec_id
), top AS ({sql_top('scored')})
SELECT query_id, doc_id, round(score, 6) AS score, rank FROM top""",
    "rerank_topk": f"""
WITH {SQL_QUERIES}, {SQL_POSTINGS}, {sql_bm25()}, {SQL_VECTOR_PAIRS}, {SQL_RERANK}, top AS ({sql_top('rescored')})
SELECT query_id, doc_id, round(score, 6) AS score, rank FROM top""",
    "mode_comparison": f"""
WITH {SQL_BOTH_MODES},
firsts AS (
  SELECT query_id, min(CASE WHEN mode = 'keyword' AND rank = 1 THEN doc_id END) AS keyword_first,
         min(CASE WHEN mode = 'semantic' AND rank = 1 THEN doc_id END) AS semantic_first FROM hits GROUP BY query_id
),
shared AS (
  SELECT query_id, count(*) FILTER (modes = 2) AS shared_hits
  FROM (SELECT query_id, doc_id, count(*) AS modes FROM hits GROUP BY query_id, doc_id) GROUP BY query_id
)
SELECT query_id, keyword_first, semantic_first, coalesce(shared_hits, 0) AS shared_hits,
       coalesce(CAST(keyword_first = semantic_first AS INTEGER), 0) AS same_first
FROM queries LEFT JOIN firsts USING (query_id) LEFT JOIN shared USING (query_id)""",
    "dense_topk_hard": f"""
WITH vec AS (
  SELECT vec_id, CASE WHEN vec_id % 50 = 4 THEN list_transform(embedding, lambda x: 0.0) ELSE CAST(embedding AS DOUBLE[]) END AS v
  FROM embeddings WHERE vec_id % 50 NOT IN (1, 2, 3, 5)
),
scored AS (
  SELECT q.vec_id AS query_id, d.vec_id AS doc_id,
         CASE WHEN q.vec_id % 50 = 4 OR d.vec_id % 50 = 4 THEN 0.0 ELSE list_cosine_similarity(q.v, d.v) END AS score
  FROM vec q, vec d WHERE q.vec_id <> d.vec_id
), top AS ({sql_top('scored')})
SELECT query_id, doc_id, round(score, 6) AS score, rank FROM top""",
    "cosine_expression": """
SELECT vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(list_reverse(embedding) AS DOUBLE[])), 6)
  AS cosine FROM embeddings""",
}
SQL["dense_topk_pivots"] = SQL["dense_topk"]
SQL["dense_topk_pivots_hard"] = SQL["dense_topk_hard"]
