"""Conversations, prompts, retrieved context and inference."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from qaloom import prompts
from qaloom.catalog.tables import (
    SQL_PAIRS,
    SQL_POSTINGS,
    SQL_WHOLE_QUERIES,
    corpus,
    json_text,
    qa_pairs,
    queries,
    questions,
    sql_bm25,
    sql_strip,
    sql_top,
    sql_words,
    table,
)
from qaloom.functions import text
from qaloom.functions.chat import build_prompt, chat_field, to_chat
from qaloom.operators.context import rag_context
from qaloom.operators.inference import RateLimited, generate, model_score
from qaloom.operators.lanes import Budget
from qaloom.operators.lexical import bm25_search
from qaloom.operators.report import each, experiment_grid, leaderboard, retrieval_gain, retrieval_grid
from qaloom.plans.evaluate import prompts_with_and_without_context, run_close_ended
from qaloom.sources.readers import experiment_config


def chat_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs as three-message conversations, one row per message."""
    chats = qa_pairs(spark, sf_dir).select(
        "pair_id", to_chat(prompts.EXPERT_SYSTEM, "question", "answer").alias("messages")
    )
    return chats.select("pair_id", F.posexplode("messages").alias("position", "m")).select(
        "pair_id", "position", F.col("m.role").alias("role"), F.col("m.content").alias("content")
    )


def chat_unpack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First content per role of conversations in which some roles are missing."""
    turns = table(spark, sf_dir, "conversations")
    one = F.array(F.struct("role", F.col("text").alias("content")))
    twice = F.concat(one, F.array(F.struct("role", F.reverse("text").alias("content"))))
    return turns.select(
        "conv_id",
        "turn",
        chat_field(twice, "user").alias("question"),
        chat_field(twice, "assistant").alias("answer"),
    )


def options_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as multiple-choice questions; the options keep the order they were given in."""
    letters = [F.lit(c) for c in "DABC"]
    values = [F.col("p_type"), F.col("p_brand"), F.col("p_size").cast("string"), F.col("p_name")]
    options = F.map_from_arrays(F.array(*letters), F.array(*values))
    return table(spark, sf_dir, "part").select("p_partkey", text.render_options("p_name", options).alias("rendered"))


def snippet_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a turn as snippets, joined to a context, with the three forms of user content."""
    lines = F.transform(F.split("text", "\n"), lambda line: F.struct(F.nullif(line, F.lit("")).alias("text")))
    snippets = F.when(F.col("turn") > 0, lines)
    context = text.join_snippets(snippets)
    return table(spark, sf_dir, "conversations").select(
        "conv_id",
        "turn",
        text.user_content("role", context).alias("with_context"),
        text.user_content("role").alias("with_prefix"),
        text.user_content("role", prefix=False).alias("bare"),
        text.context_then_question(F.split("text", "\n"), F.when(F.col("turn") > 0, F.col("role"))).alias("joined"),
    )


def reference_answers_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reference answers of a turn (its lines, one more empty, one missing) as one text; empty results drop out."""
    lines = F.transform(F.split("text", "\n"), lambda line: F.struct(line.alias("ANSWER")))
    more = F.array(F.struct(F.lit("").alias("ANSWER")), F.struct(F.lit(None).cast("string").alias("ANSWER")))
    answers = F.when(F.col("role") != "system", F.concat(more, lines))
    joined = table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", text.reference_answers(answers).alias("answer")
    )
    return joined.where(F.col("answer") != "")


def first_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First entry of answers held as variants: system turns are empty lists, user turns texts, others lists."""
    listed = F.to_json(F.split("text", "\n"))
    raw = F.when(F.col("role") == "system", "[]").when(F.col("role") == "user", json_text("text")).otherwise(listed)
    turns = table(spark, sf_dir, "conversations").withColumn("raw", F.parse_json(raw))
    answers = turns.select("conv_id", "turn", text.first_answer("raw").alias("answer"))
    return answers.where(F.col("answer").isNotNull())


def passage_contexts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    asked, documents = questions(spark, sf_dir), corpus(spark, sf_dir)
    return asked.withColumnRenamed("query", "question"), bm25_search(asked, documents), documents


def rag_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Close-ended prompts with and without the ten retrieved documents, flattened."""
    asked, hits, documents = passage_contexts(spark, sf_dir)
    runs = prompts_with_and_without_context(asked, hits, documents, ["base"], "yesno")
    return runs.select(
        "query_id",
        "use_rag",
        chat_field("messages", "system").alias("system"),
        chat_field("messages", "user").alias("asked"),
    )


LONG_QUESTION = 3_500


def rag_prompt_long_question(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts without context whose questions, passages repeated, exceed every word limit: the question stays whole."""
    times = (F.floor(F.lit(LONG_QUESTION) / F.greatest(F.lit(1), F.size(text.words("query")))) + 1).cast("int")
    asked = questions(spark, sf_dir).select("query_id", F.array_join(F.array_repeat("query", times), "\n").alias("question"))
    documents = corpus(spark, sf_dir)
    nothing = documents.limit(0).select(F.col("doc_id").alias("query_id"), "doc_id", F.lit(1).alias("rank"))
    runs = prompts_with_and_without_context(asked, nothing, documents, ["base"], "yesno")
    question = chat_field("messages", "user")
    return runs.where(~F.col("use_rag")).select("query_id", F.length(question).alias("chars"), F.md5(question).alias("asked_md5"))


def rag_prompt_long_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long-form prompts with and without context, flattened."""
    asked, hits, documents = passage_contexts(spark, sf_dir)
    runs = prompts_with_and_without_context(asked, hits, documents, ["base"])
    return runs.select(
        "query_id",
        "use_rag",
        chat_field("messages", "system").alias("system"),
        F.md5(chat_field("messages", "user")).alias("asked_md5"),
    )


def rag_prompt_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contexts of passages for which nothing was retrieved: the fixed notice."""
    asked, documents = queries(spark, sf_dir), corpus(spark, sf_dir)
    nothing = documents.where(F.col("doc_id") < 0).select(
        F.col("doc_id").alias("query_id"), "doc_id", F.lit(1).alias("rank")
    )
    return rag_context(asked, nothing, documents).select("query_id", "context")


def prompt_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Instructions of all question types over the pairs."""
    pairs = qa_pairs(spark, sf_dir).withColumn("question_type", each(list(prompts.CLOSE_ENDED_INSTRUCTIONS)))
    messages = build_prompt("question", "answer", F.pmod(F.col("conv_id") + F.col("turn"), F.lit(2)) == 0, F.col("question_type"))
    return pairs.select(
        "pair_id",
        "question_type",
        chat_field(messages, "system").alias("system"),
        chat_field(messages, "user").alias("asked"),
    )


def stub_reply(rows: list[dict[str, Any]], settings: Mapping[str, Any]) -> Sequence[str]:
    """Stand-in model: yes or no by the length of the question, decorated like a model reply."""
    replies = []
    for row in rows:
        asked = row["messages"][-1]["content"]
        word = "Yes" if len(asked) % 2 == 0 else "NO"
        replies.append(f" [doc{len(asked) % 7}]{word}] " if row["model"] == "decorated" else word.lower())
    return replies


MODELS = ("decorated", "plain")


def close_ended_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a label as yes/no questions in two stand-in datasets, asked of two models in both modes."""
    labels = table(spark, sf_dir, "labels")
    asked = table(spark, sf_dir, "documents").join(labels, "doc_id")
    gold = F.when(F.col("quality") == 1, F.lit(" Yes")).when(F.col("toxic") == 1, F.lit(None)).otherwise(F.lit("no "))
    questions = asked.select(
        F.when(F.col("lang") == "en", F.lit("english")).otherwise(F.lit("other")).alias("dataset"),
        F.col("doc_id").alias("query_id"),
        F.col("text").alias("question"),
        gold.alias("answer"),
        F.concat_ws(" ", "lang", "source").alias("context"),
    )
    runs = questions.withColumn("model", each(MODELS)).withColumn("use_rag", each((True, False)))
    return runs.withColumn("messages", build_prompt("question", "context", F.col("use_rag"), F.lit("yesno")))


def close_ended_scored(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return run_close_ended(close_ended_prompts(spark, sf_dir), stub_reply)


class MoodyModel:
    """Stand-in service: raises for every call that holds a prompt it cannot read, and limits some prompts once."""

    def __init__(self):
        self.seen: set[str] = set()

    def __call__(self, rows: list[dict[str, Any]], settings: Mapping[str, Any]) -> Sequence[Any]:
        sizes = [len(row["messages"][-1]["content"]) for row in rows]
        if any(size % 11 == 0 for size in sizes):
            raise ValueError("unreadable")
        replies: list[Any] = []
        for row, size in zip(rows, sizes, strict=True):
            content = row["messages"][-1]["content"]
            limited = size % 13 == 0 and content not in self.seen
            self.seen.add(content)
            replies.append(RateLimited() if limited else f"reply {size}")
        return replies


def generate_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies and attempts where some prompts always fail their call and others are limited once."""
    asked = table(spark, sf_dir, "documents").select("doc_id", "text").where("text IS NOT NULL").dropDuplicates(["text"])
    user = F.struct(F.lit("user").alias("role"), F.col("text").alias("content"))
    asked = asked.select(F.col("text").alias("content"), F.array(user).alias("messages"))
    replies = generate(asked, MoodyModel(), ["messages"], wait=0.0, batch_rows=16)
    return replies.select(F.md5("content").alias("content_md5"), "reply", "attempts")


def generate_stub(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies of the stand-in model to every prompt, with the attempts they took."""
    replies = generate(close_ended_prompts(spark, sf_dir), stub_reply, ["model", "messages"])
    return replies.select("dataset", "query_id", "model", "use_rag", "reply", "attempts")


def generate_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies of the stand-in model, with one limit of requests and tokens for all tasks."""
    budget = Budget(requests_per_minute=60_000, tokens_per_minute=600_000_000, lanes=4, reply_tokens=16)
    asked = close_ended_prompts(spark, sf_dir).select("dataset", "query_id", "model", "use_rag", "messages")
    replies = generate(asked, stub_reply, ["model", "messages"], budget=budget)
    return replies.select("dataset", "query_id", "model", "use_rag", "reply", "attempts")


def clean_and_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies cleaned, gold answers folded, exact match per row."""
    scored, _ = close_ended_scored(spark, sf_dir)
    return scored.select("dataset", "query_id", "model", "use_rag", "answer", "prediction", "correct")


def accuracy_by_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy per dataset, model and mode."""
    return close_ended_scored(spark, sf_dir)[1]


def accuracy_leaderboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy by model and mode, one column per dataset."""
    return leaderboard(accuracy_by_model(spark, sf_dir), ["english", "other"])


def accuracy_gain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What retrieval adds per dataset and model."""
    gain = retrieval_gain(accuracy_by_model(spark, sf_dir))
    return gain.select("dataset", "model", "with_retrieval", "without_retrieval", F.round("gain", 5).alias("gain"))


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every language of the documents as a dataset, with every model and mode, and the questions each run would ask.

    A language without settings of its own is asked for yes, no or maybe by both models.
    """
    sizes = table(spark, sf_dir, "documents").where("lang IS NOT NULL").groupBy("lang").agg(F.count("*").alias("questions"))
    settings = experiment_config(
        spark,
        [
            {"task": "close-ended", "dataset": lang, "question_type": kind, "models": ["tuned", "base"]}
            for lang, kind in (("en", "mc"), ("fr", "yesno"), ("de", "ynm"))
        ],
    )
    both = F.array(F.lit("tuned"), F.lit("base"))
    datasets = sizes.join(settings, sizes["lang"] == settings["dataset"], "left").select(
        F.col("lang").alias("dataset"),
        F.coalesce("question_type", F.lit("ynm")).alias("question_type"),
        "questions",
        F.coalesce("models", both).alias("models"),
    )
    runs = experiment_grid(datasets).select("dataset", "question_type", "model", "use_rag", "questions")
    searches = retrieval_grid(datasets).select(
        "dataset", "question_type", F.col("mode").alias("model"), F.lit(True).alias("use_rag"), "questions"
    )
    return runs.unionByName(searches)


def length_ratio(references: Sequence[str], candidates: Sequence[str]) -> list[float]:
    """Stand-in learned score: the shorter length over the longer."""
    return [min(len(r), len(c)) / max(len(r), len(c), 1) for r, c in zip(references, candidates)]


def model_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch scorer over question and answer of every pair."""
    scored = model_score(qa_pairs(spark, sf_dir).select("pair_id", "question", "answer"), length_ratio, "question")
    return scored.select("pair_id", F.round("model_score", 6).alias("model_score"))


QUERIES = {
    "chat_messages": chat_messages,
    "chat_unpack": chat_unpack,
    "options_render": options_render,
    "context_join": snippet_context,
    "reference_answers_join": reference_answers_join,
    "first_answer": first_answers,
    "rag_prompt": rag_prompt,
    "rag_prompt_long_question": rag_prompt_long_question,
    "rag_prompt_long_form": rag_prompt_long_form,
    "rag_prompt_empty": rag_prompt_empty,
    "prompt_types": prompt_types,
    "generate_stub": generate_stub,
    "generate_failures": generate_failures,
    "generate_budget": generate_budget,
    "clean_and_match": clean_and_match,
    "accuracy_by_model": accuracy_by_model,
    "leaderboard": accuracy_leaderboard,
    "retrieval_gain": accuracy_gain,
    "experiment_grid": grid,
    "model_score": model_scores,
}


def quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


YES_NO = quoted(prompts.CLOSE_ENDED_INSTRUCTIONS["yesno"])

SQL_CONTEXTS = f"""{SQL_WHOLE_QUERIES}, {SQL_POSTINGS}, {sql_bm25()}, hits AS ({sql_top('bm25')}),
contexts AS (
  SELECT query_id, string_agg(coalesce(text, ''), chr(10) || chr(10) ORDER BY rank) AS context
  FROM hits JOIN documents USING (doc_id) GROUP BY query_id
),
runs AS (
  SELECT query_id, use_rag, CASE WHEN use_rag THEN
           'Question: ' || query || chr(10) || chr(10) || 'Context: ' || coalesce(context, {quoted(prompts.NO_CONTEXT)})
         ELSE query END AS asked
  FROM queries LEFT JOIN contexts USING (query_id), (SELECT unnest([true, false]) AS use_rag)
)"""

SQL_REPLIES = f"""
questions AS (
  SELECT CASE WHEN lang = 'en' THEN 'english' ELSE 'other' END AS dataset, d.doc_id AS query_id, text AS question,
         CASE WHEN quality = 1 THEN ' Yes' WHEN toxic = 1 THEN NULL ELSE 'no ' END AS answer,
         lang || ' ' || source AS context
  FROM documents d JOIN labels l ON l.doc_id = d.doc_id
),
asked AS (
  SELECT dataset, query_id, model, use_rag, answer,
         CASE WHEN use_rag THEN length('Question: ' || question || '..Context: ' || context)
              ELSE length(question) END AS size
  FROM questions, (SELECT unnest(['decorated', 'plain']) AS model), (SELECT unnest([true, false]) AS use_rag)
),
replies AS (
  SELECT *, CASE WHEN model = 'decorated'
              THEN ' [doc' || (size % 7) || ']' || CASE WHEN size % 2 = 0 THEN 'Yes' ELSE 'NO' END || '] '
              ELSE CASE WHEN size % 2 = 0 THEN 'yes' ELSE 'no' END END AS reply
  FROM asked
),
scored AS (
  SELECT dataset, query_id, model, use_rag, lower({sql_strip('answer')}) AS answer,
         lower({sql_strip("regexp_replace(regexp_replace(reply, '\\[doc[0-9]+\\]', '', 'g'), '[\\[\\]]', '', 'g')")})
           AS prediction
  FROM replies
),
matched AS (SELECT *, CAST(coalesce(prediction = answer, false) AS INTEGER) AS correct FROM scored),
accuracies AS (
  SELECT dataset, model, use_rag, count(*) AS questions, CAST(sum(correct) AS BIGINT) AS correct,
         count(*) FILTER (answer IS NULL) AS without_gold, round(avg(correct), 5) AS accuracy
  FROM matched GROUP BY dataset, model, use_rag
)"""

SQL_LINES = "string_split(text, chr(10))"

SQL = {
    "chat_messages": f"""
WITH {SQL_PAIRS}
SELECT pair_id, CAST(0 AS INTEGER) AS position, 'system' AS role, {quoted(prompts.EXPERT_SYSTEM)} AS content FROM pairs
UNION ALL SELECT pair_id, 1, 'user', question FROM pairs
UNION ALL SELECT pair_id, 2, 'assistant', answer FROM pairs""",
    "chat_unpack": """
SELECT conv_id, turn, CASE WHEN role = 'user' THEN text ELSE '' END AS question,
       CASE WHEN role = 'assistant' THEN text ELSE '' END AS answer FROM conversations""",
    "options_render": """
SELECT p_partkey, p_name || chr(10) || 'Options:' || chr(10) || 'D) ' || p_type || chr(10) || 'A) ' || p_brand
       || chr(10) || 'B) ' || p_size || chr(10) || 'C) ' || p_name AS rendered FROM part""",
    "context_join": f"""
WITH t AS (
  SELECT *, CASE WHEN turn > 0 THEN array_to_string({SQL_LINES}, ' ') ELSE '' END AS context FROM conversations
)
SELECT conv_id, turn, 'Question: ' || role || chr(10) || 'Context: ' || context AS with_context,
       'Question: ' || role AS with_prefix, role AS bare,
       {sql_strip(f"(array_to_string({SQL_LINES}, ' ') || ' ' || CASE WHEN turn > 0 THEN role ELSE '' END)")} AS joined
FROM t""",
    "reference_answers_join": f"""
WITH t AS (
  SELECT conv_id, turn, CASE WHEN role <> 'system'
           THEN array_to_string(list_filter({SQL_LINES}, lambda x: x <> ''), chr(10)) ELSE '' END AS answer
  FROM conversations
)
SELECT conv_id, turn, answer FROM t WHERE answer <> ''""",
    "first_answer": f"""
SELECT conv_id, turn, CASE WHEN role = 'user' THEN text ELSE {SQL_LINES}[1] END AS answer
FROM conversations WHERE role <> 'system' AND text <> ''""",
    "rag_prompt_long_question": f"""
WITH repeated AS (
  SELECT item_id, rtrim(repeat(text || chr(10), CAST(floor(3500 / greatest(1, len({sql_words('text')}))) + 1 AS INTEGER)), chr(10))
    AS asked FROM benchmark
)
SELECT item_id AS query_id, CAST(length(asked) AS INTEGER) AS chars, md5(asked) AS asked_md5 FROM repeated""",
    "rag_prompt": f"WITH {SQL_CONTEXTS} SELECT query_id, use_rag, {YES_NO} AS system, asked FROM runs",
    "rag_prompt_long_form": f"""
WITH {SQL_CONTEXTS}
SELECT query_id, use_rag, CASE WHEN use_rag THEN {quoted(prompts.LONG_FORM_INSTRUCTION_WITH_CONTEXT)}
       ELSE {quoted(prompts.LONG_FORM_INSTRUCTION)} END AS system, md5(asked) AS asked_md5 FROM runs""",
    "rag_prompt_empty": f"SELECT item_id AS query_id, {quoted(prompts.NO_CONTEXT)} AS context FROM benchmark",
    "prompt_types": f"""
WITH {SQL_PAIRS}, kinds AS (
  {" UNION ALL ".join(f"SELECT {quoted(k)} AS question_type, {quoted(v)} AS system"
                      for k, v in prompts.CLOSE_ENDED_INSTRUCTIONS.items())}
)
SELECT pair_id, question_type, system, CASE WHEN (conv_id + turn) % 2 = 0
         THEN 'Question: ' || question || chr(10) || chr(10) || 'Context: ' || answer ELSE question END AS asked
FROM pairs, kinds""",
    "generate_failures": """
SELECT md5(text) AS content_md5, CASE WHEN length(text) % 11 = 0 THEN 'error' ELSE 'reply ' || length(text) END AS reply,
       CAST(CASE WHEN length(text) % 11 = 0 THEN 5 WHEN length(text) % 13 = 0 THEN 2 ELSE 1 END AS INTEGER) AS attempts
FROM (SELECT DISTINCT text FROM documents WHERE text IS NOT NULL)""",
    "generate_stub": f"""
WITH {SQL_REPLIES}
SELECT dataset, query_id, model, use_rag, reply, CAST(1 AS INTEGER) AS attempts FROM replies""",
    "clean_and_match": f"""
WITH {SQL_REPLIES} SELECT dataset, query_id, model, use_rag, answer, prediction, correct FROM matched""",
    "accuracy_by_model": f"WITH {SQL_REPLIES} SELECT * FROM accuracies",
    "leaderboard": f"""
WITH {SQL_REPLIES}
SELECT model, use_rag, max(CASE WHEN dataset = 'english' THEN accuracy END) AS english,
       max(CASE WHEN dataset = 'other' THEN accuracy END) AS other FROM accuracies GROUP BY model, use_rag""",
    "retrieval_gain": f"""
WITH {SQL_REPLIES}, sides AS (
  SELECT dataset, model, max(CASE WHEN use_rag THEN accuracy END) AS with_retrieval,
         max(CASE WHEN NOT use_rag THEN accuracy END) AS without_retrieval FROM accuracies GROUP BY dataset, model
)
SELECT *, round(with_retrieval - without_retrieval, 5) AS gain FROM sides""",
    "experiment_grid": """
WITH sizes AS (SELECT lang AS dataset, count(*) AS questions FROM documents WHERE lang IS NOT NULL GROUP BY lang),
datasets AS (
  SELECT dataset, CASE dataset WHEN 'en' THEN 'mc' WHEN 'fr' THEN 'yesno' ELSE 'ynm' END AS question_type, questions FROM sizes
)
SELECT dataset, question_type, model, use_rag, questions
FROM datasets, (SELECT unnest(['tuned', 'base']) AS model), (SELECT unnest([true, false]) AS use_rag)
UNION ALL
SELECT dataset, question_type, mode, true, questions FROM datasets, (SELECT unnest(['semantic', 'keyword']) AS mode)""",
    "model_score": f"""
WITH {SQL_PAIRS}
SELECT pair_id, round(least(length(answer), length(question)) / greatest(length(answer), length(question), 1), 6)
  AS model_score FROM pairs""",
}

SQL["generate_budget"] = SQL["generate_stub"]
