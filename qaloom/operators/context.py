"""Retrieved passages as prompt context."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qaloom import prompts
from qaloom.operators.skew import fetch


def rag_context(
    queries: DataFrame,
    hits: DataFrame,
    corpus: DataFrame,
    k: int = prompts.TOP_K,
    doc_id: str = "doc_id",
    content: str = "text",
) -> DataFrame:
    """``queries`` with a ``context`` column: the contents of the top ``k`` hits, best first, one blank line apart.

    A hit that is not in the corpus is left out, a missing content is an empty text, and a query without any
    hit gets the fixed notice. Only k passages per query are ever gathered.
    """
    passages = corpus.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(content), F.lit("")).alias("_content"))
    shown = fetch(hits.where(F.col("rank") <= k).select("query_id", "doc_id", "rank"), passages, "doc_id", "query_id")
    ranked = F.sort_array(F.collect_list(F.struct("rank", "_content")))
    joined = F.array_join(F.transform(ranked, lambda p: p["_content"]), "\n\n")
    contexts = shown.groupBy("query_id").agg(joined.alias("context"))
    filled = F.coalesce("context", F.lit(prompts.NO_CONTEXT))
    return queries.join(contexts, "query_id", "left").withColumn("context", filled)
