"""Lexical search queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from qaloom.catalog.tables import (
    SQL_PAIRS,
    SQL_POSTINGS,
    SQL_QUERIES,
    corpus,
    qa_pairs,
    queries,
    sql_bm25,
    sql_top,
)
from qaloom.operators.lexical import bm25_index, bm25_search, open_bm25_index, term_statistics
from qaloom.session import scratch_path


def bm25_term_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document and collection frequency and weight of every term."""
    stats = term_statistics(bm25_index(corpus(spark, sf_dir)))
    return stats.select("term", "df", "occurrences", F.round("idf", 6).alias("idf"))


def bm25_corpus_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length of every document next to the mean length of the corpus."""
    index = bm25_index(corpus(spark, sf_dir))
    lengths = index.postings.where(F.col("term") == "")
    return lengths.select(
        "doc_id",
        F.col("length").cast("bigint").alias("length"),
        F.lit(index.documents).cast("bigint").alias("documents"),
        F.lit(round(index.mean_length, 6)).alias("mean_length"),
    )


def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten best documents per benchmark passage."""
    hits = bm25_search(queries(spark, sf_dir), corpus(spark, sf_dir))
    return hits.withColumn("score", F.round("score", 6))


def bm25_topk_stored_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five best documents per user question, from an index that was written and opened again."""
    path = scratch_path(spark, "bm25-index")
    bm25_index(corpus(spark, sf_dir), path=path)
    asked = qa_pairs(spark, sf_dir).select(F.col("pair_id").alias("query_id"), F.col("question").alias("query"))
    hits = bm25_search(asked, open_bm25_index(spark, path), k=5)
    return hits.withColumn("score", F.round("score", 6))


def bm25_topk_pruned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents per passage by the pruned way, which large inputs take."""
    hits = bm25_search(queries(spark, sf_dir), corpus(spark, sf_dir), direct=False)
    return hits.withColumn("score", F.round("score", 6))


def bm25_top_1200(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 1,200 best documents per passage."""
    hits = bm25_search(queries(spark, sf_dir), corpus(spark, sf_dir), k=1200)
    return hits.withColumn("score", F.round("score", 6))


QUERIES = {
    "bm25_topk_pruned": bm25_topk_pruned,
    "bm25_top_1200": bm25_top_1200,
    "bm25_term_stats": bm25_term_stats,
    "bm25_corpus_stats": bm25_corpus_stats,
    "bm25_topk": bm25_topk,
    "bm25_topk_stored_index": bm25_topk_stored_index,
}

SQL = {
    "bm25_term_stats": f"""
WITH {SQL_POSTINGS}
SELECT term, df, CAST(occurrences AS BIGINT) AS occurrences, round(ln(1 + (n - df + 0.5) / (df + 0.5)), 6) AS idf
FROM (SELECT term, count(*) AS df, sum(tf) AS occurrences FROM postings GROUP BY term), figures""",
    "bm25_corpus_stats": f"""
WITH {SQL_POSTINGS}
SELECT doc_id, length, CAST(n AS BIGINT) AS documents, round(mean_length, 6) AS mean_length FROM lengths, figures""",
    "bm25_topk": f"""
WITH {SQL_QUERIES}, {SQL_POSTINGS}, {sql_bm25()}, top AS ({sql_top('bm25')})
SELECT query_id, doc_id, round(score, 6) AS score, rank FROM top""",
    "bm25_topk_pruned": f"""
WITH {SQL_QUERIES}, {SQL_POSTINGS}, {sql_bm25()}, top AS ({sql_top('bm25')})
SELECT query_id, doc_id, round(score, 6) AS score, rank FROM top""",
    "bm25_top_1200": f"""
WITH {SQL_QUERIES}, {SQL_POSTINGS}, {sql_bm25()}, top AS ({sql_top('bm25', 1200)})
SELECT query_id, doc_id, round(score, 6) AS score, rank FROM top""",
    "bm25_topk_stored_index": f"""
WITH {SQL_PAIRS}, asked AS (SELECT pair_id AS query_id, question AS query FROM pairs),
{SQL_POSTINGS}, {sql_bm25('asked')}, top AS ({sql_top('bm25', 5)})
SELECT query_id, doc_id, round(score, 6) AS score, rank FROM top""",
}
