"""Sinks. Every writer takes a DataFrame and a folder and writes from the executors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qaloom import prompts
from qaloom.functions.text import filled_or
from qaloom.operators.numbering import chunk_ids


def _csv(writer):
    """CSV that reads back unchanged: doubled quotes, and no trimming of field ends."""
    return (
        writer.option("header", True)
        .option("escape", '"')
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
    )


def write_chat_jsonl(df: DataFrame, path: str, mode: str = "overwrite", compression: str = "none") -> None:
    """One ``{"messages": […]}`` object per line."""
    df.select("messages").write.mode(mode).option("ignoreNullFields", False).json(path, compression=compression)


def write_qa_csv(
    df: DataFrame, path: str, columns: Sequence[str] | None = None, mode: str = "overwrite", compression: str = "none"
) -> None:
    """QA pairs as CSV with a header and no index column."""
    _csv(df.select(*(columns or df.columns)).write.mode(mode)).csv(path, compression=compression)


def corpus_records(df: DataFrame, doc_id: str, title: str, text: str, url: str) -> DataFrame:
    """Corpus records with defaults for a missing title or text and the address under ``metadata``."""
    return df.select(
        F.col(doc_id).alias("_id"),
        filled_or(title, prompts.UNKNOWN_TITLE).alias("title"),
        filled_or(text, prompts.NO_ABSTRACT).alias("text"),
        F.struct(F.col(url).alias("url")).alias("metadata"),
    )


def write_corpus_jsonl(records: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One corpus record per line."""
    records.select("_id", "title", "text", "metadata").write.mode(mode).json(path)


def write_chunked(
    df: DataFrame,
    path: str,
    order_by: Sequence[Column | str],
    size: int = prompts.CHUNK_ROWS,
    mode: str = "overwrite",
) -> None:
    """Consecutive ``size``-row parts as CSV under ``part=1``, ``part=2``, …, one bounded task per part."""
    parts = chunk_ids(df, order_by, size)
    placed = parts.repartition("part").sortWithinPartitions("part", "idx").drop("idx")
    _csv(placed.write.mode(mode).partitionBy("part")).csv(path)


def write_results(
    df: DataFrame,
    path: str,
    run_columns: Sequence[str] = ("task", "dataset", "model", "use_rag"),
    mode: str = "overwrite",
) -> None:
    """Result rows as Parquet, partitioned by the run they belong to, with the run date as a column.

    With dynamic partition overwrite a re-run replaces its own partitions only.
    """
    stamped = df.withColumn("run_date", F.date_format(F.current_date(), "yyyyMMdd"))
    writer = stamped.write.mode(mode).option("partitionOverwriteMode", "dynamic")
    writer.partitionBy(*run_columns).parquet(path)
