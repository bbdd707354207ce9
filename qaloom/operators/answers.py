"""Close-ended answers: exact match and accuracy."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qaloom.functions.text import clean_response, fold_answer

RUN = ("dataset", "model", "use_rag")


def exact_match(prediction: Column | str, gold: Column | str) -> Column:
    """1 where both texts are present and equal, else 0."""
    prediction, gold = (F.col(c) if isinstance(c, str) else c for c in (prediction, gold))
    return F.coalesce((prediction == gold).cast("int"), F.lit(0))


def score_close_ended(rows: DataFrame, reply: str = "reply", gold: str = "answer") -> DataFrame:
    """Add the normalized ``answer`` and ``prediction`` and the ``correct`` flag; a missing gold answer stays in."""
    folded = rows.withColumn("prediction", clean_response(reply)).withColumn("answer", fold_answer(gold))
    return folded.withColumn("correct", exact_match("prediction", "answer"))


def accuracy(scored: DataFrame, by: Sequence[str] = RUN) -> DataFrame:
    """Share of correct rows per run at five decimals, with the row counts behind it."""
    return scored.groupBy(*by).agg(
        F.count("*").alias("questions"),
        F.sum("correct").cast("bigint").alias("correct"),
        F.count_if(F.col("answer").isNull()).alias("without_gold"),
        F.round(F.avg("correct"), 5).alias("accuracy"),
    )
