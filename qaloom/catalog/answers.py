"""Long-form answer scores."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from qaloom.catalog.chats import length_ratio
from qaloom.catalog.tables import (
    SQL_PAIRS,
    SQL_PREDICTIONS,
    predictions,
    qa_pairs,
    sql_ascii_terms,
    sql_strip,
    sql_words,
    table,
)
from qaloom.functions.text import words
from qaloom.operators.overlap import bleu4, greedy_match_f1, rouge_l, rouge_l_rows, rouge_n
from qaloom.plans.evaluate import evaluate_long_form, long_form_scores, long_form_summary
from qaloom.session import stage


def rouge_n_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ROUGE-1 and ROUGE-2 of every prediction."""
    scores = rouge_n(predictions(spark, sf_dir), "row_id")
    return scores.select("row_id", "n", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f")])


def rouge_l_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ROUGE-L of every prediction."""
    return predictions(spark, sf_dir).select("row_id", F.round(rouge_l("prediction", "answer"), 6).alias("rougel"))


def rouge_l_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ROUGE-L of every prediction, those with more than 2,500 pairs of words in steps between tasks."""
    scored = rouge_l_rows(stage(predictions(spark, sf_dir), "predictions"), "row_id", "prediction", "answer", cells=2_500, step=128)
    return scored.select("row_id", F.round("rougel", 6).alias("rougel"))


def bleu_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentence BLEU of every prediction."""
    return bleu4(predictions(spark, sf_dir), "row_id").select("row_id", F.round("bleu", 6).alias("bleu"))


def greedy_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embedding match: sixteen consecutive vectors are one pair, eight candidate and eight reference tokens."""
    number = F.pmod(F.col("vec_id"), F.lit(16))
    tokens = table(spark, sf_dir, "embeddings").select(
        F.floor(F.col("vec_id") / 16).cast("bigint").alias("pair_id"),
        F.when(number < 8, F.lit("candidate")).otherwise(F.lit("reference")).alias("side"),
        F.pmod(number, F.lit(8)).alias("position"),
        F.col("embedding").alias("vector"),
    )
    scores = greedy_match_f1(tokens, baseline=0.05)
    return scores.select("pair_id", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


def scored_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return long_form_scores(stage(predictions(spark, sf_dir), "predictions"), "row_id")


def long_form_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All text scores of every prediction in one row."""
    return scored_predictions(spark, sf_dir).select(
        "row_id", "model", *[F.round(c, 6).alias(c) for c in ("rouge1", "rouge2", "rougel", "bleu")]
    )


def summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean scores per stand-in model."""
    means = long_form_summary(scored_predictions(spark, sf_dir), ["model"])
    return means.select("model", "answers", *[F.round(c, 6).alias(c) for c in ("rouge1", "rouge2", "rougel", "bleu")])


def terse_model(rows: list[dict[str, Any]], settings: Mapping[str, Any]) -> Sequence[Any]:
    """Stand-in model: says the question without every third word, with blanks around; fails on some questions."""
    replies: list[Any] = []
    for row in rows:
        asked = row["messages"][-1]["content"]
        said = " ".join(w for i, w in enumerate(asked.split(" ")) if i % 3 != 2)
        replies.append(ValueError("refused") if len(asked) % 7 == 0 else f"  {said}\n")
    return replies


def token_numbers(rows: DataFrame) -> DataFrame:
    """Stand-in token vectors: one, the length of a word, and how often it has an e."""
    sides = F.array(*[
        F.struct(F.lit(side).alias("side"), words(column).alias("words")) for side, column in (("candidate", "prediction"), ("reference", "answer"))
    ])
    texts = rows.select("row_id", F.inline(sides)).select("row_id", "side", F.posexplode("words").alias("position", "word"))
    length = F.length("word")
    numbers = F.array(F.lit(1), length, length - F.length(F.replace("word", F.lit("e"), F.lit(""))))
    return texts.select("row_id", "side", "position", F.transform(numbers, lambda x: x.cast("double")).alias("vector"))


def long_form_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A long-form run from prompts to scores, one row per answer: failed prompts score on the empty reply."""
    pairs = qa_pairs(spark, sf_dir).select(F.lit("chats").alias("dataset"), F.col("pair_id").alias("query_id"), "question", "answer")
    user = F.struct(F.lit("user").alias("role"), F.col("question").alias("content"))
    asked = pairs.withColumn("model", F.lit("terse")).withColumn("use_rag", F.lit(False)).withColumn("messages", F.array(user))
    scored, _ = evaluate_long_form(asked, terse_model, length_ratio, token_numbers, baseline=0.2, waves=2)
    metrics = ("rouge1", "rouge2", "rougel", "bleu", "match", "model_score")
    return scored.select("query_id", F.length("prediction").alias("chars"), *[F.round(c, 6).alias(c) for c in metrics])


QUERIES = {
    "long_form_run": long_form_run,
    "rouge_n": rouge_n_rows,
    "rouge_l": rouge_l_scores,
    "rouge_l_steps": rouge_l_steps,
    "bleu4": bleu_rows,
    "greedy_match": greedy_match,
    "long_form_rows": long_form_rows,
    "long_form_summary": summary,
}


def sql_matches(name: str, tokens, sizes: str) -> str:
    """Clipped n-gram counts of ``predictions`` as a CTE ``{name}(row_id, model, n, matches, c_total, r_total)``."""

    def side(column: str) -> str:
        return f"""
  SELECT row_id, n, gram, count(*) AS c FROM (
    SELECT row_id, n, unnest(list_transform(range(1, len(t) - n + 2),
                                            lambda i: array_to_string(t[i:i + n - 1], ' '))) AS gram
    FROM (SELECT row_id, {tokens(column)} AS t FROM predictions), (SELECT unnest({sizes}) AS n)
  ) GROUP BY row_id, n, gram"""

    return f"""
{name}_c AS ({side('prediction')}), {name}_r AS ({side('answer')}),
{name}_m AS (
  SELECT row_id, n, sum(least(a.c, b.c)) AS matches FROM {name}_c a JOIN {name}_r b USING (row_id, n, gram)
  GROUP BY row_id, n
),
{name} AS (
  SELECT p.row_id, p.model, s.n, coalesce(m.matches, 0) AS matches,
         coalesce(c.total, 0) AS c_total, coalesce(r.total, 0) AS r_total
  FROM predictions p CROSS JOIN (SELECT unnest({sizes}) AS n) s
  LEFT JOIN {name}_m m ON m.row_id = p.row_id AND m.n = s.n
  LEFT JOIN (SELECT row_id, n, sum(c) AS total FROM {name}_c GROUP BY row_id, n) c ON c.row_id = p.row_id AND c.n = s.n
  LEFT JOIN (SELECT row_id, n, sum(c) AS total FROM {name}_r GROUP BY row_id, n) r ON r.row_id = p.row_id AND r.n = s.n
)"""


SQL_ROUGE = f"""{sql_matches('overlap', sql_ascii_terms, '[1, 2]')},
rouge AS (
  SELECT row_id, model, n, p AS precision, r AS recall, coalesce(2 * p * r / nullif(p + r, 0), 0) AS f
  FROM (SELECT *, coalesce(matches / nullif(c_total, 0), 0) AS p, coalesce(matches / nullif(r_total, 0), 0) AS r
        FROM overlap)
)"""

SQL_BLEU = f"""{sql_matches('grams', sql_words, '[1, 2, 3, 4]')},
bleu_parts AS (
  SELECT row_id, avg(ln(CASE WHEN matches > 0 THEN matches ELSE 0.1 END / greatest(c_total, 1))) AS logs,
         max(CASE WHEN n = 1 THEN matches END) AS unigrams, max(CASE WHEN n = 1 THEN c_total END) AS c,
         max(CASE WHEN n = 1 THEN r_total END) AS r
  FROM grams GROUP BY row_id
),
bleus AS (
  SELECT row_id, CASE WHEN unigrams > 0
           THEN exp(logs) * CASE WHEN c > r THEN 1 ELSE exp(1 - r / c) END ELSE 0 END AS bleu
  FROM bleu_parts
)"""

# Longest common subsequence: one step per reference word; best[i] is the length within the first i candidate words.
SQL_LCS = f"""
texts AS (
  SELECT row_id, {sql_ascii_terms('prediction')} AS c, {sql_ascii_terms('answer')} AS r FROM predictions
),
steps AS (
  SELECT row_id, c, r, 0 AS j, list_transform(c, lambda x: 0) AS best FROM texts
  UNION ALL
  SELECT row_id, c, r, j + 1, list_transform(reached, lambda x, i: list_max(reached[1:i])) FROM (
    SELECT row_id, c, r, j, list_transform(c, lambda x, i: CASE WHEN x = r[j + 1]
             THEN greatest(best[i], 1 + CASE WHEN i > 1 THEN best[i - 1] ELSE 0 END) ELSE best[i] END) AS reached
    FROM steps WHERE j < len(r)
  )
),
longest AS (
  SELECT row_id, coalesce(2 * coalesce(list_max(best), 0) / nullif(len(c) + len(r), 0), 0) AS rougel
  FROM steps WHERE j = len(r)
)"""

SQL_LONG_FORM = f"""{SQL_PREDICTIONS}, {SQL_ROUGE}, {SQL_BLEU},
scores AS (
  SELECT row_id, model, max(CASE WHEN n = 1 THEN f END) AS rouge1, max(CASE WHEN n = 2 THEN f END) AS rouge2,
         max(bleu) AS bleu
  FROM rouge JOIN bleus USING (row_id) GROUP BY row_id, model
)"""

SQL = {
    "rouge_n": f"""
WITH {SQL_PREDICTIONS}, {SQL_ROUGE}
SELECT row_id, n, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f, 6) AS f FROM rouge""",
    "bleu4": f"WITH {SQL_PREDICTIONS}, {SQL_BLEU} SELECT row_id, round(bleu, 6) AS bleu FROM bleus",
    "greedy_match": """
WITH t AS (
  SELECT vec_id, vec_id // 16 AS pair_id, vec_id % 16 < 8 AS candidate, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
),
m AS (
  SELECT a.pair_id, a.candidate, a.vec_id, max(list_cosine_similarity(a.v, b.v)) AS best
  FROM t a LEFT JOIN t b ON b.pair_id = a.pair_id AND b.candidate <> a.candidate GROUP BY ALL
),
p AS (
  SELECT pair_id, coalesce(avg(CASE WHEN candidate THEN coalesce(best, 0) END), 0) AS p,
         coalesce(avg(CASE WHEN NOT candidate THEN coalesce(best, 0) END), 0) AS r FROM m GROUP BY pair_id
)
SELECT pair_id, round(p, 6) AS precision, round(r, 6) AS recall,
       round((coalesce(2 * p * r / nullif(p + r, 0), 0) - 0.05) / 0.95, 6) AS f1 FROM p""",
    "rouge_l": f"""
WITH RECURSIVE {SQL_PREDICTIONS}, {SQL_LCS} SELECT row_id, round(rougel, 6) AS rougel FROM longest""",
    "long_form_summary": f"""
WITH RECURSIVE {SQL_LONG_FORM}, {SQL_LCS}
SELECT model, count(*) AS answers, round(avg(rouge1), 6) AS rouge1, round(avg(rouge2), 6) AS rouge2,
       round(avg(rougel), 6) AS rougel, round(avg(bleu), 6) AS bleu
FROM scores JOIN longest USING (row_id) GROUP BY model""",
    "long_form_rows": f"""
WITH RECURSIVE {SQL_LONG_FORM}, {SQL_LCS}
SELECT row_id, model, round(rouge1, 6) AS rouge1, round(rouge2, 6) AS rouge2, round(rougel, 6) AS rougel, round(bleu, 6) AS bleu
FROM scores JOIN longest USING (row_id)""",
    "long_form_run": f"""
WITH RECURSIVE {SQL_PAIRS},
said AS (
  SELECT *, array_to_string(list_filter(string_split(question, ' '), lambda w, i: i % 3 <> 0), ' ') AS reply FROM pairs
),
predictions AS (
  SELECT pair_id AS row_id, 'terse' AS model, {sql_strip('answer')} AS answer,
         CASE WHEN length(question) % 7 = 0 THEN '' ELSE {sql_strip('reply')} END AS prediction FROM said
), {SQL_ROUGE}, {SQL_BLEU}, {SQL_LCS},
sides AS (
  SELECT row_id, 'c' AS side, {sql_words('prediction')} AS w FROM predictions
  UNION ALL SELECT row_id, 'r', {sql_words('answer')} FROM predictions
),
tokens AS (
  SELECT row_id, side, place, [1.0, length(word), length(word) - length(replace(word, 'e', ''))]::DOUBLE[] AS v
  FROM (SELECT row_id, side, unnest(w) AS word, generate_subscripts(w, 1) AS place FROM sides)
),
best AS (
  SELECT a.row_id, a.side, a.place, max(list_cosine_similarity(a.v, b.v)) AS best
  FROM tokens a LEFT JOIN tokens b ON b.row_id = a.row_id AND b.side <> a.side GROUP BY ALL
),
means AS (
  SELECT row_id, coalesce(avg(CASE WHEN side = 'c' THEN coalesce(best, 0) END), 0) AS p,
         coalesce(avg(CASE WHEN side = 'r' THEN coalesce(best, 0) END), 0) AS r FROM best GROUP BY row_id
),
scores AS (
  SELECT row_id, max(CASE WHEN n = 1 THEN f END) AS rouge1, max(CASE WHEN n = 2 THEN f END) AS rouge2, max(bleu) AS bleu
  FROM rouge JOIN bleus USING (row_id) GROUP BY row_id
)
SELECT row_id AS query_id, CAST(length(prediction) AS INTEGER) AS chars, round(rouge1, 6) AS rouge1, round(rouge2, 6) AS rouge2,
       round(rougel, 6) AS rougel, round(bleu, 6) AS bleu,
       round((coalesce(2 * p * r / nullif(p + r, 0), 0) - 0.2) / 0.8, 6) AS match,
       round(least(length(answer), length(prediction)) / greatest(length(answer), length(prediction), 1), 6) AS model_score
FROM predictions JOIN scores USING (row_id) JOIN longest USING (row_id) LEFT JOIN means USING (row_id)""",
}

SQL["rouge_l_steps"] = SQL["rouge_l"]
