"""Evaluation runs: retrieval, close-ended answers, long-form answers."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qaloom import prompts
from qaloom.functions.chat import build_prompt
from qaloom.functions.text import strip_ws, truncate_words
from qaloom.operators.answers import RUN, accuracy, score_close_ended
from qaloom.operators.blockmax import BlockIndex
from qaloom.operators.context import rag_context
from qaloom.operators.dense import dense_search, side_by_side
from qaloom.operators.inference import Predict, generate_to_table, model_score
from qaloom.operators.lexical import LexicalIndex, bm25_search
from qaloom.operators.overlap import greedy_match_f1, overlap_scores, rouge_l_rows
from qaloom.operators.pivots import PivotIndex
from qaloom.operators.ranking import evaluate_ranking
from qaloom.operators.report import each
from qaloom.session import scratch_path, stage

LONG_FORM_METRICS = ("rouge1", "rouge2", "rougel", "bleu")


def search_both_modes(
    queries: DataFrame,
    corpus: DataFrame | LexicalIndex | BlockIndex,
    query_vectors: DataFrame,
    doc_vectors: DataFrame | PivotIndex,
    k: int = prompts.TOP_K,
) -> DataFrame:
    """Keyword and semantic hits (``mode, query_id, doc_id, score, rank``) of queries cut to the word limit.

    Each mode searches the whole corpus: the words by BM25, the vectors by cosine. Re-scoring lexical candidates is
    a mode of its own, :func:`qaloom.operators.dense.rerank_search`.
    """
    cut = queries.select("query_id", truncate_words("query").alias("query"))
    return side_by_side({"keyword": bm25_search(cut, corpus, k), "semantic": dense_search(query_vectors, doc_vectors, k)})


def evaluate_retrieval(hits: DataFrame, qrels: DataFrame, queries: DataFrame, **options: Any) -> DataFrame:
    """Scores and averages of all modes in one pass; hits are landed first, as search is the costly part."""
    return evaluate_ranking(stage(hits, "hits"), qrels, queries, modes=("semantic", "keyword"), **options)


def prompts_with_and_without_context(
    questions: DataFrame,
    hits: DataFrame,
    corpus: DataFrame,
    models: Sequence[str],
    question_type: str | None = None,
) -> DataFrame:
    """One prompt per question, model and mode; the context is gathered once per question for all of them."""
    contexts = rag_context(questions, hits, corpus)
    runs = contexts.withColumn("model", each(models)).withColumn("use_rag", each((True, False)))
    kind = None if question_type is None else F.lit(question_type)
    return runs.withColumn("messages", build_prompt("question", "context", F.col("use_rag"), kind))


def run_close_ended(
    asked: DataFrame,
    predict: Predict,
    path: str | None = None,
    keys: Sequence[str] = ("dataset", "query_id", "model", "use_rag"),
    **options: Any,
) -> tuple[DataFrame, DataFrame]:
    """Generate, score and aggregate prompts that carry a gold ``answer``: (scored rows, accuracy per run)."""
    path = path or scratch_path(asked.sparkSession, "replies")
    replies = generate_to_table(asked, predict, ["model", "messages"], keys, path, **options)
    scored = score_close_ended(replies)
    return scored, accuracy(scored)


def run_long_form(
    asked: DataFrame,
    predict: Predict,
    path: str | None = None,
    keys: Sequence[str] = ("dataset", "query_id", "model", "use_rag"),
    settings: Mapping[str, Any] = prompts.LONG_FORM_SETTINGS,
    **options: Any,
) -> DataFrame:
    """Generate long-form replies: one attempt, an empty reply on failure, stripped."""
    path = path or scratch_path(asked.sparkSession, "replies")
    replies = generate_to_table(
        asked, predict, ["model", "messages"], keys, path, settings=settings, max_attempts=1, on_error="", **options
    )
    return replies.withColumn("prediction", strip_ws("reply")).withColumn("answer", strip_ws("answer"))


def long_form_scores(rows: DataFrame, key: str = "pair_id") -> DataFrame:
    """ROUGE-1, ROUGE-2, ROUGE-L and BLEU of every row; ``key`` has to be unique. ``rows`` is read twice: stage it.

    Texts are scored where they lie; joining the scores shuffles the columns that are wanted of the rows.
    """
    texts = rouge_l_rows(rows, key, "prediction", "answer")
    return texts.join(overlap_scores(rows, key), key)


def long_form_summary(
    scored: DataFrame, by: Sequence[str] = RUN, metrics: Sequence[str] = LONG_FORM_METRICS
) -> DataFrame:
    """Mean of every score per run."""
    return scored.groupBy(*by).agg(F.count("*").alias("answers"), *[F.avg(m).alias(m) for m in metrics])


# Takes rows with the key, prediction and answer; returns (key, side, position, vector) of the tokens of both texts.
TokenVectors = Callable[[DataFrame], DataFrame]
Scorer = Callable[[Sequence[str], Sequence[str]], Sequence[float]]


def evaluate_long_form(
    asked: DataFrame,
    predict: Predict,
    scorer: Scorer | None = None,
    token_vectors: TokenVectors | None = None,
    path: str | None = None,
    keys: Sequence[str] = ("dataset", "query_id", "model", "use_rag"),
    by: Sequence[str] = RUN,
    baseline: float = 0.0,
    **options: Any,
) -> tuple[DataFrame, DataFrame]:
    """The whole long-form run: replies, all scores per row, and their means per run.

    Rows get ``row_id``, ``prediction``, ROUGE-1/2/L and BLEU, with a ``scorer`` the learned score ``model_score`` and
    with ``token_vectors`` the embedding match ``match``. A prompt that failed scores on the empty reply. Replies and
    scored rows are staged, so that no model is asked and no text is scored twice.
    """
    replies = run_long_form(asked, predict, path, keys, **options)
    # Keys as JSON, so that no value can run into the next one.
    rows = replies.withColumn("row_id", F.to_json(F.struct(*keys), {"ignoreNullFields": "false"}))
    rows = rows.withColumn("answer", F.coalesce("answer", F.lit("")))
    rows = stage(rows.select("row_id", *keys, "answer", "prediction"), "answers")
    scored, metrics = long_form_scores(rows, "row_id"), [*LONG_FORM_METRICS]
    if token_vectors is not None:
        matched = greedy_match_f1(token_vectors(rows), "row_id", baseline=baseline)
        scored = scored.join(matched.select("row_id", F.col("f1").alias("match")), "row_id", "left")
        scored = scored.withColumn("match", F.coalesce("match", F.lit(-baseline / (1.0 - baseline))))
        metrics.append("match")
    if scorer is not None:
        scored = model_score(scored, scorer)
        metrics.append("model_score")
    scored = stage(scored, "long-form-scores")
    return scored, long_form_summary(scored, by, metrics)
