"""Judgment and ranking-metric queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from qaloom.catalog.tables import (
    SQL_POSTINGS,
    SQL_QRELS,
    SQL_QUERIES,
    corpus,
    qrels,
    queries,
    questions,
    sql_bm25,
    sql_top,
    sql_words,
    table,
)
from qaloom.catalog.vectors import SQL_BOTH_MODES, both_modes, vectors
from qaloom.functions.text import words
from qaloom.operators.containment import containing, containing_parts
from qaloom.operators.dense import dense_search
from qaloom.operators.lexical import bm25_search
from qaloom.operators.ranking import (
    METRICS,
    evaluate_ranking,
    ideal_ranking,
    judge_hits,
    ranking_metrics,
    with_average,
)
from qaloom.operators.report import leaderboard, metrics_long
from qaloom.plans.evaluate import evaluate_retrieval
from qaloom.plans.prep import restrict_to_corpus
from qaloom.session import broadcast_if_small, stage


def rounded(scores: DataFrame) -> DataFrame:
    return scores.select(
        *[F.round(c, 6).alias(c) if c in METRICS else F.col(c) for c in scores.columns]
    )


def keyword_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bm25_search(queries(spark, sf_dir), corpus(spark, sf_dir))


def qrels_by_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The judgments themselves."""
    return qrels(spark, sf_dir)


def qrels_short_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that contain a passage, or any one word of a passage, counted per passage; found by automata."""
    asked = questions(spark, sf_dir)
    whole = asked.select(F.col("query_id").cast("string").alias("query_id"), F.col("query").alias("passage"))
    single = asked.select(F.explode(F.array_distinct(words("query"))).alias("passage")).distinct()
    short = containing(single.select(F.col("passage").alias("query_id"), "passage"), corpus(spark, sf_dir))
    found = containing_parts(whole, corpus(spark, sf_dir)).withColumn("kind", F.lit("passage"))
    both = found.unionByName(short.withColumn("kind", F.lit("word")))
    return both.groupBy("kind", F.col("query_id").alias("passage")).agg(F.count("*").alias("documents"), F.max("doc_id").alias("last_doc_id"))


def judged_twice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyword hits against judgments that come twice with other grades: the first one counts."""
    judged = qrels(spark, sf_dir)
    again = judged.select("query_id", "doc_id", (F.col("relevance") + 1).alias("relevance"), F.lit(1).alias("at"))
    twice = stage(judged.withColumn("at", F.lit(0)).unionByName(again), "qrels")
    return judge_hits(keyword_hits(spark, sf_dir), twice, "at").select("query_id", "doc_id", "rank", "relevance")


def judged_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyword hits with their judged relevance, 0 where unjudged."""
    judged = judge_hits(keyword_hits(spark, sf_dir), qrels(spark, sf_dir))
    return judged.select("query_id", "doc_id", "rank", "relevance")


def ideal_relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judgments per query by falling grade, as runs of ranks."""
    return ideal_ranking(qrels(spark, sf_dir)).select("query_id", "relevance", "judgments", "first_rank", "last_rank")


def ranking_per_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All metrics at 10 per passage for the keyword hits."""
    scores = evaluate_ranking(
        keyword_hits(spark, sf_dir), stage(qrels(spark, sf_dir), "qrels"), queries(spark, sf_dir), average=False
    )
    return rounded(scores)


def ranking_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both search modes with their average rows: the flagship evaluation."""
    scores = evaluate_retrieval(
        both_modes(spark, sf_dir), stage(qrels(spark, sf_dir), "qrels"), queries(spark, sf_dir)
    )
    return rounded(scores)


def ranking_leaderboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metric by search mode."""
    averages = ranking_average(spark, sf_dir).where(F.col("query_id") == "Average")
    return leaderboard(
        metrics_long(averages, METRICS, ["mode"]), ["keyword", "semantic"], "value", by=["metric"], pivot="mode"
    )


def halves(df: DataFrame) -> DataFrame:
    """Queries as two stand-in datasets."""
    return df.withColumn("dataset", F.when(F.pmod("query_id", F.lit(2)) == 0, "even").otherwise("odd"))


def ranking_datasets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Average metrics of two datasets in both search modes, in one pass, with one column per mode."""
    scores = evaluate_retrieval(
        halves(both_modes(spark, sf_dir)),
        halves(stage(qrels(spark, sf_dir), "qrels")),
        halves(queries(spark, sf_dir)),
        query=("dataset", "query_id"),
    )
    averages = rounded(scores.where(F.col("query_id") == "Average"))
    return leaderboard(
        metrics_long(averages, METRICS, ["dataset", "mode"]),
        ["keyword", "semantic"],
        "value",
        by=["dataset", "metric"],
        pivot="mode",
    )


def ranking_metrics_textbook(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall and average precision over the relevant judgments instead of all judgments and found hits."""
    scores = evaluate_ranking(
        keyword_hits(spark, sf_dir),
        stage(qrels(spark, sf_dir), "qrels"),
        queries(spark, sf_dir),
        recall_denominator="relevant",
        ap_denominator="relevant",
        average=False,
    )
    return rounded(scores)


def dense_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vector hits judged by equal labels. A label's own size gives the ideal ranking, so no pairs are built."""
    hits = dense_search(vectors(spark, sf_dir, "query_id"), vectors(spark, sf_dir, "doc_id"), exclude_same_id=True)
    labels = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    query_labels = labels.select(F.col("vec_id").alias("query_id"), F.col("label").alias("_query"))
    doc_labels = labels.select(F.col("vec_id").alias("doc_id"), F.col("label").alias("_doc"))
    judged = hits.join(doc_labels, "doc_id").join(query_labels, "query_id").select(
        "query_id", "doc_id", "rank", (F.col("_query") == F.col("_doc")).cast("int").alias("relevance")
    )
    others = labels.groupBy(F.col("label").alias("_query")).agg((F.count("*") - 1).alias("relevant"))
    ideal = F.lit(0.0)
    for i in range(1, 11):
        ideal = ideal + F.when(F.col("relevant") >= i, F.lit(1.0) / F.log2(F.lit(float(i + 1)))).otherwise(F.lit(0.0))
    others = broadcast_if_small(stage(others.where(F.col("relevant") > 0), "labels"))
    profile = query_labels.join(others, "_query").select(
        "query_id", ideal.alias("ideal_dcg"), F.col("relevant").alias("judged"), "relevant"
    )
    return ranking_metrics(judged, profile, query_labels)


def ranking_metrics_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All metrics at 10 per vector, with the average."""
    return rounded(with_average(dense_scores(spark, sf_dir)))


def qrels_restricted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judgments of documents that carry a quality label."""
    return restrict_to_corpus(qrels(spark, sf_dir), table(spark, sf_dir, "labels")).select(
        "query_id", "doc_id", "relevance"
    )


QUERIES = {
    "qrels_by_containment": qrels_by_containment,
    "qrels_restricted": qrels_restricted,
    "qrels_short_passages": qrels_short_passages,
    "judged_hits": judged_hits,
    "judged_twice": judged_twice,
    "ideal_relevance": ideal_relevance,
    "ranking_metrics": ranking_per_query,
    "ranking_average": ranking_average,
    "ranking_leaderboard": ranking_leaderboard,
    "ranking_datasets": ranking_datasets,
    "ranking_metrics_textbook": ranking_metrics_textbook,
    "ranking_metrics_dense": ranking_metrics_dense,
}


def sql_metrics(judged: str, qrels: str, wanted: str, keys: str = "query_id", textbook: bool = False) -> str:
    """``scores`` CTEs from judged hits, judgments and the wanted queries."""
    on = " AND ".join(f"h.{key} = w.{key}" for key in keys.split(", "))
    wanted_keys = ", ".join(f"w.{key}" for key in keys.split(", "))
    recall_base = "relevant" if textbook else "judged"
    ap_base = "relevant" if textbook else "hits"
    return f"""
running AS (
  SELECT *, sum(CAST(relevance > 0 AS INTEGER)) OVER (PARTITION BY {keys} ORDER BY rank) AS found
  FROM {judged} WHERE rank <= 10
),
per_query AS (
  SELECT {keys}, sum(relevance / log2(rank + 1)) AS dcg, min(CASE WHEN relevance > 0 THEN rank END) AS first,
         count(*) FILTER (relevance > 0) AS hits, sum(CASE WHEN relevance > 0 THEN found / rank END) AS precisions
  FROM running GROUP BY {keys}
),
ideal AS (
  SELECT query_id, sum(CASE WHEN i <= 10 THEN relevance / log2(i + 1) END) AS ideal_dcg, count(*) AS judged,
         count(*) FILTER (relevance > 0) AS relevant
  FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY relevance DESC) AS i FROM {qrels})
  GROUP BY query_id
),
parts AS (
  SELECT {wanted_keys}, coalesce(dcg, 0) AS dcg,
         CASE WHEN judged IS NULL THEN 0 ELSE coalesce(dcg, 0) / nullif(ideal_dcg, 0) * 100 END AS ndcg,
         coalesce(1 / first, 0) * 100 AS mrr, coalesce(hits, 0) / 10 AS p,
         coalesce(coalesce(hits, 0) / nullif({recall_base}, 0), 0) AS r,
         coalesce(precisions / nullif({ap_base}, 0), 0) * 100 AS map
  FROM {wanted} w LEFT JOIN per_query h ON {on} LEFT JOIN ideal i ON i.query_id = w.query_id
),
scores AS (
  SELECT {keys}, dcg, ndcg, mrr, p * 100 AS precision, r * 100 AS recall,
         coalesce(2 * p * r / nullif(p + r, 0), 0) * 100 AS f1, map FROM parts
)"""


SQL_ROUNDED = ", ".join(f"round({m}, 6) AS {m}" for m in METRICS)
SQL_MEANS = ", ".join(f"round(avg({m}), 6) AS {m}" for m in METRICS)

SQL_KEYWORD = f"""{SQL_QUERIES}, {SQL_POSTINGS}, {sql_bm25()}, {SQL_QRELS},
hits AS ({sql_top('bm25')}),
judged_hits AS (
  SELECT h.query_id, h.doc_id, h.rank, coalesce(q.relevance, 0) AS relevance
  FROM hits h LEFT JOIN qrels q ON q.query_id = h.query_id AND q.doc_id = h.doc_id
)"""

SQL_BOTH = f"""{SQL_BOTH_MODES}, {SQL_QRELS},
judged_hits AS (
  SELECT h.mode, h.query_id, h.doc_id, h.rank, coalesce(q.relevance, 0) AS relevance
  FROM hits h LEFT JOIN qrels q ON q.query_id = h.query_id AND q.doc_id = h.doc_id
),
wanted AS (SELECT mode, query_id FROM queries, (SELECT unnest(['semantic', 'keyword']) AS mode)),
{sql_metrics('judged_hits', 'qrels', 'wanted', 'mode, query_id')}"""

SQL = {
    "qrels_by_containment": f"WITH {SQL_QRELS} SELECT query_id, doc_id, relevance FROM qrels",
    "qrels_restricted": f"""
WITH {SQL_QRELS} SELECT query_id, doc_id, relevance FROM qrels WHERE doc_id IN (SELECT doc_id FROM labels)""",
    "qrels_short_passages": f"""
WITH asked AS (
  SELECT 'passage' AS kind, CAST(item_id AS VARCHAR) AS passage, text AS part FROM benchmark
  UNION ALL SELECT 'word', w, w FROM (SELECT DISTINCT unnest({sql_words('text')}) AS w FROM benchmark)
)
SELECT kind, passage, count(*) AS documents, max(doc_id) AS last_doc_id
FROM asked JOIN documents ON contains(documents.text, part) GROUP BY kind, passage""",
    "judged_twice": f"WITH {SQL_KEYWORD} SELECT query_id, doc_id, rank, relevance FROM judged_hits",
    "judged_hits": f"WITH {SQL_KEYWORD} SELECT query_id, doc_id, rank, relevance FROM judged_hits",
    "ideal_relevance": f"""
WITH {SQL_QRELS}
SELECT query_id, relevance, count(*) AS judgments, min(i) AS first_rank, max(i) AS last_rank
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY relevance DESC) AS i FROM qrels)
GROUP BY query_id, relevance""",
    "ranking_metrics": f"""
WITH {SQL_KEYWORD}, {sql_metrics('judged_hits', 'qrels', 'queries')}
SELECT query_id, {SQL_ROUNDED} FROM scores""",
    "ranking_average": f"""
WITH {SQL_BOTH}
SELECT mode, CAST(query_id AS VARCHAR) AS query_id, {SQL_ROUNDED} FROM scores
UNION ALL SELECT mode, 'Average', {SQL_MEANS} FROM scores GROUP BY mode""",
    "ranking_leaderboard": f"""
WITH {SQL_BOTH},
means AS (SELECT mode, {SQL_MEANS} FROM scores GROUP BY mode),
long AS (UNPIVOT means ON dcg, ndcg, mrr, precision, recall, f1, map INTO NAME metric VALUE value)
SELECT metric, max(CASE WHEN mode = 'keyword' THEN value END) AS keyword,
       max(CASE WHEN mode = 'semantic' THEN value END) AS semantic FROM long GROUP BY metric""",
    "ranking_datasets": f"""
WITH {SQL_BOTH},
means AS (
  SELECT mode, CASE WHEN query_id % 2 = 0 THEN 'even' ELSE 'odd' END AS dataset, {SQL_MEANS} FROM scores GROUP BY ALL
),
long AS (UNPIVOT means ON dcg, ndcg, mrr, precision, recall, f1, map INTO NAME metric VALUE value)
SELECT dataset, metric, max(CASE WHEN mode = 'keyword' THEN value END) AS keyword,
       max(CASE WHEN mode = 'semantic' THEN value END) AS semantic FROM long GROUP BY dataset, metric""",
    "ranking_metrics_textbook": f"""
WITH {SQL_KEYWORD}, {sql_metrics('judged_hits', 'qrels', 'queries', textbook=True)}
SELECT query_id, {SQL_ROUNDED} FROM scores""",
    "ranking_metrics_dense": f"""
WITH vec AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
scored AS (
  SELECT q.vec_id AS query_id, d.vec_id AS doc_id, CAST(q.label = d.label AS INTEGER) AS relevance,
         list_cosine_similarity(q.v, d.v) AS score
  FROM vec q, vec d WHERE q.vec_id <> d.vec_id
),
judged_hits AS ({sql_top('scored')}),
qrels AS (SELECT query_id, doc_id, relevance FROM scored WHERE relevance = 1),
wanted AS (SELECT vec_id AS query_id FROM embeddings),
{sql_metrics('judged_hits', 'qrels', 'wanted')}
SELECT CAST(query_id AS VARCHAR) AS query_id, {SQL_ROUNDED} FROM scores
UNION ALL SELECT 'Average', {SQL_MEANS} FROM scores""",
}
