"""Dataset preparation: raw collections to chat messages and question/answer pairs.

Every function returns rows with ``id`` (where the collection has one), ``question``, ``answer`` and ``messages``;
:func:`write_prepared` turns them into the training and test files.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qaloom import prompts
from qaloom.functions.chat import chat_field, to_chat
from qaloom.functions.text import (
    context_then_question,
    first_answer,
    join_snippets,
    paper_url,
    reference_answers,
    render_options,
    text_or,
    title_and_abstract,
    user_content,
)
from qaloom.operators.numbering import exact_split, global_index
from qaloom.sources.readers import ORDER_COLUMNS
from qaloom.session import broadcast_if_small
from qaloom.sources.writers import corpus_records, write_chat_jsonl, write_qa_csv


def filter_labels(df: DataFrame, label: str, allowed: tuple[str, ...]) -> DataFrame:
    """Rows whose label is one of the allowed texts, case-sensitive; a missing label drops out."""
    return df.where(F.col(label).isin(*allowed))


def _row_id() -> Column:
    """Ids count the input from 1 before any filter, so they have gaps."""
    return (F.col("position") + 1).cast("bigint").alias("id")


def yes_no_qa(
    questions: DataFrame,
    include_context: bool = False,
    prefix_train: bool = False,
    system: str = prompts.YES_NO_SYSTEM,
) -> DataFrame:
    """Yes/no questions of a bundle; test rows carry their snippets as context."""
    kept = filter_labels(questions, "exact_answer", ("yes", "no"))
    context = join_snippets("snippets") if include_context else None
    return kept.select(
        _row_id(),
        F.col("body").alias("question"),
        F.col("exact_answer").alias("answer"),
        to_chat(system, user_content("body", context, prefix_train), "exact_answer").alias("messages"),
    )


def article_qa(entries: DataFrame, system: str = prompts.YES_NO_MAYBE_SYSTEM) -> DataFrame:
    """Yes/no/maybe questions over articles that require reasoning."""
    kept = entries.where(
        (F.col("reasoning_required_pred") == "yes") & F.col("final_decision").isin("yes", "no", "maybe")
    )
    return kept.select(
        _row_id(),
        text_or("QUESTION").alias("question"),
        F.col("final_decision").alias("answer"),
        to_chat(system, context_then_question("CONTEXTS", "QUESTION"), "final_decision").alias("messages"),
    )


def multiple_choice_qa(lines: DataFrame, system: str = prompts.MULTIPLE_CHOICE_SYSTEM) -> DataFrame:
    """Multiple-choice questions; ``question`` stays bare, ``question_with_options`` is what the chat asks."""
    asked = render_options("question", "options")
    return lines.select(
        "question",
        asked.alias("question_with_options"),
        F.col("answer_idx").alias("answer"),
        to_chat(system, asked, "answer_idx").alias("messages"),
    )


def prepare_close_ended(
    yes_no_train: DataFrame,
    yes_no_test: DataFrame,
    article_train: DataFrame,
    article_test: DataFrame,
    choice_splits: dict[str, DataFrame],
) -> dict[tuple[str, str], DataFrame]:
    """The three close-ended sets in one call, by (dataset, split); yes/no questions carry the prefix here."""
    unified = {"prefix_train": True, "system": prompts.YES_NO_SYSTEM_UNIFIED}
    prepared = {
        ("yesno", "train"): yes_no_qa(yes_no_train, False, **unified).drop("id"),
        ("yesno", "test"): yes_no_qa(yes_no_test, True, **unified).drop("id"),
        ("ynm", "train"): article_qa(article_train),
        ("ynm", "test"): article_qa(article_test).drop("id"),
    }
    for split, lines in choice_splits.items():
        prepared["mc", split] = multiple_choice_qa(lines)
    return prepared


def expert_answers(questions: DataFrame, system: str = prompts.EXPERT_SYSTEM) -> DataFrame:
    """Long-form answers of a bundle: the first ideal answer of every question that has one."""
    answer = first_answer("ideal_answer")
    kept = questions.withColumn("_answer", answer).where(F.col("body").isNotNull() & F.col("_answer").isNotNull())
    return kept.select(
        _row_id(),
        F.col("body").alias("question"),
        F.col("_answer").alias("answer"),
        to_chat(system, "body", "_answer").alias("messages"),
    )


def article_answers(entries: DataFrame, system: str = prompts.YES_NO_MAYBE_SYSTEM) -> DataFrame:
    """Long-form answers of the articles decided with yes."""
    kept = entries.where(F.col("final_decision") == "yes")
    question, answer = text_or("QUESTION"), text_or("LONG_ANSWER")
    return kept.select(
        _row_id(), question.alias("question"), answer.alias("answer"), to_chat(system, question, answer).alias("messages")
    )


def _filled_chats(lines: DataFrame, answer: Column, system: str) -> DataFrame:
    asked = lines.select("NLM_SUMMARY", answer.alias("_answer"), *ORDER_COLUMNS)
    kept = asked.where((F.col("NLM_SUMMARY") != "") & (F.col("_answer") != ""))
    return kept.select(to_chat(system, "NLM_SUMMARY", "_answer").alias("messages"), *ORDER_COLUMNS)


def unpack_pairs(chats: DataFrame, *extra: str) -> DataFrame:
    """Question and answer of every conversation."""
    return chats.select(
        *extra,
        chat_field("messages", "user").alias("question"),
        chat_field("messages", "assistant").alias("answer"),
        "messages",
    )


def consumer_train(sources: list[DataFrame], system: str = prompts.EXPLAIN_SYSTEM) -> DataFrame:
    """Consumer questions of several ordered line scans, one after the other, numbered after the filter."""
    chats = [
        _filled_chats(lines, F.col("ANSWER"), system).withColumn("_source", F.lit(i)) for i, lines in enumerate(sources)
    ]
    united = reduce(DataFrame.unionByName, chats)
    numbered = global_index(united, ["_source", *ORDER_COLUMNS])
    return unpack_pairs(numbered.withColumn("id", F.col("idx") + 1), "id")


def consumer_test(lines: DataFrame, system: str = prompts.EXPLAIN_SYSTEM) -> DataFrame:
    """Consumer test questions; several reference answers become one text."""
    return unpack_pairs(_filled_chats(lines, reference_answers("REFERENCE_ANSWERS"), system))


def medication_qa(table: DataFrame, seed: int = 42, system: str = prompts.EXPERT_SYSTEM) -> DataFrame:
    """Question/answer table, shuffled and split 90/10 with ids per split (``split``, ``id``)."""
    kept = table.select("Question", "Answer").dropna(subset=["Question", "Answer"])
    chats = kept.select(
        to_chat(system, "Question", "Answer").alias("messages"),
        F.concat("Question", F.lit("\n"), "Answer").alias("_key"),
    )
    mixed = exact_split(chats, "_key", prompts.TRAIN_FRACTION, seed)
    return unpack_pairs(mixed.withColumnRenamed("split_id", "id"), "split", "id")


def passage_qa(passages: DataFrame, system: str = prompts.EXPLAIN_SYSTEM) -> DataFrame:
    """Passages or queries as chats; the text doubles as a dummy answer. Ids are kept for documents and queries."""
    return passages.select(
        "id",
        F.col("text").alias("question"),
        F.col("text").alias("answer"),
        to_chat(system, "text", "text").alias("messages"),
    )


def judged_corpus(metadata: DataFrame, doc_ids: DataFrame) -> DataFrame:
    """Corpus rows whose id was judged, with their article address; repeated rows survive."""
    ids = broadcast_if_small(doc_ids.select(F.col("doc_id").alias("cord_uid")))
    kept = metadata.join(ids, "cord_uid", "left_semi")
    return kept.withColumn("url", paper_url("pmc_json_files", "pdf_json_files", "s2_id"))


def judged_corpus_records(metadata: DataFrame, doc_ids: DataFrame) -> DataFrame:
    return corpus_records(judged_corpus(metadata, doc_ids), "cord_uid", "title", "abstract", "url")


def judged_corpus_texts(metadata: DataFrame, doc_ids: DataFrame) -> DataFrame:
    """``id, title`` rows for chunked upload; the title column also carries the abstract."""
    kept = judged_corpus(metadata, doc_ids)
    return kept.select(F.col("cord_uid").alias("id"), title_and_abstract("title", "abstract").alias("title"))


def restrict_to_corpus(qrels: DataFrame, doc_ids: DataFrame) -> DataFrame:
    """Optional: judgments of documents in the corpus only."""
    return qrels.join(broadcast_if_small(doc_ids.select("doc_id")), "doc_id", "left_semi")


def write_prepared(
    prepared: DataFrame, folder: str, name: str, with_id: bool = True, compression: str = "none"
) -> None:
    """``{name}.jsonl`` with the chats and ``{name}.csv`` with the pairs, the id on training sets only.

    Files repeat each text as often as the chat does. ``compression="gzip"`` saves most of their room; a compressed file
    is read by one task, so there should be several.
    """
    write_chat_jsonl(prepared, f"{folder}/{name}.jsonl", compression=compression)
    columns = ["id", "question", "answer"] if with_id else ["question", "answer"]
    write_qa_csv(prepared, f"{folder}/{name}.csv", columns, compression=compression)


def write_passage_tables(
    train: DataFrame,
    test: DataFrame,
    queries: DataFrame,
    folder: str,
    system: str = prompts.EXPLAIN_SYSTEM,
    compression: str = "none",
) -> None:
    """Passages (``id, text``) as training set, test documents and test queries, each with files of its own.

    Training files keep the ids, the other two have none; ``query_ids.csv`` keeps the ids of the queries for scoring.
    """
    write_prepared(passage_qa(train, system), folder, "train", compression=compression)
    write_prepared(passage_qa(test, system), folder, "test", with_id=False, compression=compression)
    asked = passage_qa(queries, system)
    write_prepared(asked, folder, "test_queries", with_id=False, compression=compression)
    write_qa_csv(asked, f"{folder}/query_ids.csv", ["id", "question"], compression=compression)
