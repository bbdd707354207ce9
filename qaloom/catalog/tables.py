"""Inputs derived from the driver tables, in Spark and as SQL fragments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from qaloom.functions.text import WHITESPACE, truncate_words, words
from qaloom.operators.containment import containing


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``query_id, query``: the whole benchmark passages."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``query_id, query``: the benchmark passages under the query word limit of the retrieval evaluation."""
    return questions(spark, sf_dir).select("query_id", truncate_words("query").alias("query"))


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def qrels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``query_id, doc_id, relevance``: documents that contain a benchmark passage, graded by their quality label."""
    passages = questions(spark, sf_dir).withColumnRenamed("query", "passage")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    return containing(passages, corpus(spark, sf_dir)).join(labels, "doc_id", "left").select(
        "query_id", "doc_id", (F.lit(1) + F.coalesce("quality", F.lit(0))).alias("relevance")
    )


def qa_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``pair_id, conv_id, turn, question, answer``: user turns with the assistant turn right after them."""
    turns = table(spark, sf_dir, "conversations")
    asked = turns.where(F.col("role") == "user").select(
        "conv_id", "turn", F.concat_ws("/", "conv_id", "turn").alias("pair_id"), F.col("text").alias("question")
    )
    replied = turns.where(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer")
    )
    return asked.join(replied, ["conv_id", "turn"]).select("pair_id", "conv_id", "turn", "question", "answer")


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``pair_id, model, use_rag, answer, prediction``: two stand-in models over the pairs.

    ``neighbour`` replies with the next conversation's answer at the same turn (or the question itself),
    ``skipper`` with the reference answer without every fourth word.
    """
    pairs = qa_pairs(spark, sf_dir)
    other = pairs.select((F.col("conv_id") - 1).alias("conv_id"), "turn", F.col("answer").alias("_other"))
    joined = pairs.join(other, ["conv_id", "turn"], "left")
    skipped = F.array_join(F.filter(words("answer"), lambda w, i: i % 4 != 3), " ")
    replies = F.array(
        F.struct(F.lit("neighbour").alias("model"), F.coalesce("_other", "question").alias("prediction")),
        F.struct(F.lit("skipper").alias("model"), skipped.alias("prediction")),
    )
    return joined.select("pair_id", "question", "answer", F.inline(replies)).select(
        F.concat_ws("/", "model", "pair_id").alias("row_id"), "pair_id", "model", "question", "answer", "prediction"
    )


def json_text(column: str) -> Column:
    """A text as a JSON string literal."""
    return F.regexp_extract(F.to_json(F.array(F.col(column))), r"(?s)^\[(.*)\]$", 1)


# --- SQL fragments ---------------------------------------------------------------------------------------------------

WS = WHITESPACE


def sql_words(text: str) -> str:
    return f"list_filter(regexp_split_to_array({text}, '{WS}+'), lambda w: w <> '')"


def sql_terms(text: str) -> str:
    return rf"list_filter(regexp_split_to_array(lower({text}), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> '')"


def sql_ascii_terms(text: str) -> str:
    return f"list_filter(regexp_split_to_array(lower({text}), '[^a-z0-9]+'), lambda w: w <> '')"


def sql_strip(text: str) -> str:
    return f"regexp_replace({text}, '^{WS}+|{WS}+$', '', 'g')"


SQL_QUERIES = f"""
queries AS (
  SELECT item_id AS query_id, array_to_string(list_slice({sql_words('text')}, 1, 2999), ' ') AS query FROM benchmark
)"""

SQL_WHOLE_QUERIES = """
queries AS (SELECT item_id AS query_id, text AS query FROM benchmark)"""

SQL_QRELS = """
qrels AS (
  SELECT b.item_id AS query_id, d.doc_id, CAST(1 + coalesce(l.quality, 0) AS INTEGER) AS relevance
  FROM benchmark b JOIN documents d ON contains(d.text, b.text) LEFT JOIN labels l ON l.doc_id = d.doc_id
)"""

SQL_POSTINGS = f"""
tokenized AS (SELECT doc_id, {sql_terms('text')} AS toks FROM documents),
lengths AS (SELECT doc_id, len(toks) AS length FROM tokenized),
figures AS (SELECT CAST(count(*) AS DOUBLE) AS n, avg(length) AS mean_length FROM lengths),
postings AS (
  SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(toks) AS term FROM tokenized) GROUP BY doc_id, term
),
frequencies AS (SELECT term, count(*) AS df FROM postings GROUP BY term)"""


def sql_bm25(queries: str = "queries", name: str = "bm25") -> str:
    """All positive scores of ``queries(query_id, query)`` as a CTE of that name."""
    return f"""
{name}_terms AS (
  SELECT query_id, term, count(*) AS qtf
  FROM (SELECT query_id, unnest({sql_terms('query')}) AS term FROM {queries}) GROUP BY query_id, term
),
{name} AS (
  SELECT query_id, doc_id,
         sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5))
             * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean_length))) AS score
  FROM {name}_terms JOIN frequencies USING (term) JOIN postings USING (term) JOIN lengths USING (doc_id), figures
  GROUP BY query_id, doc_id
)"""


def sql_top(source: str, k: int = 10, by: str = "query_id") -> str:
    """Best ``k`` rows per group with their rank."""
    return f"""
  SELECT * EXCLUDE (score, position), score, CAST(position AS INTEGER) AS rank FROM (
    SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY round(score, 6) DESC, doc_id) AS position FROM {source}
  ) WHERE position <= {k}"""


SQL_PAIRS = f"""
pairs AS (
  SELECT concat_ws('/', u.conv_id, u.turn) AS pair_id, u.conv_id, u.turn, u.text AS question, a.text AS answer
  FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
  WHERE u.role = 'user' AND a.role = 'assistant'
)"""

SQL_PREDICTIONS = f"""{SQL_PAIRS},
predictions AS (
  SELECT concat_ws('/', model, pair_id) AS row_id, pair_id, model, question, answer, prediction FROM (
    SELECT p.pair_id, 'neighbour' AS model, p.question, p.answer, coalesce(o.answer, p.question) AS prediction
    FROM pairs p LEFT JOIN pairs o ON o.conv_id = p.conv_id + 1 AND o.turn = p.turn
    UNION ALL
    SELECT pair_id, 'skipper', question, answer,
           array_to_string(list_filter({sql_words('answer')}, lambda w, i: i % 4 <> 0), ' ')
    FROM pairs
  )
)"""
