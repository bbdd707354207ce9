"""Experiment grids and leaderboards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def each(values: Sequence[object]) -> Column:
    """One row per value of a fixed list."""
    return F.explode(F.array(*[F.lit(v) for v in values]))


def experiment_grid(
    datasets: DataFrame, models: Sequence[str] | str = "models", use_rag: Sequence[bool] = (True, False)
) -> DataFrame:
    """Every dataset with every model (a fixed list, or the name of an array column), with and without retrieval."""
    model = F.explode(F.col(models)) if isinstance(models, str) else each(models)
    return datasets.withColumn("model", model).withColumn("use_rag", each(use_rag))


def retrieval_grid(datasets: DataFrame, modes: Sequence[str] = ("semantic", "keyword")) -> DataFrame:
    """Every dataset in every search mode."""
    return datasets.withColumn("mode", each(modes))


def leaderboard(
    scores: DataFrame,
    columns: Sequence[str],
    value: str = "accuracy",
    by: Sequence[str] = ("model", "use_rag"),
    pivot: str = "dataset",
) -> DataFrame:
    """One row per run and one column per dataset (or metric) of the fixed list ``columns``."""
    return scores.groupBy(*by).pivot(pivot, list(columns)).agg(F.first(value))


def retrieval_gain(scores: DataFrame, value: str = "accuracy", by: Sequence[str] = ("dataset", "model")) -> DataFrame:
    """Value with retrieval, without it, and the difference, per dataset and model."""
    with_rag = F.max(F.when(F.col("use_rag"), F.col(value)))
    without = F.max(F.when(~F.col("use_rag"), F.col(value)))
    return scores.groupBy(*by).agg(
        with_rag.alias("with_retrieval"), without.alias("without_retrieval"), (with_rag - without).alias("gain")
    )


def metrics_long(scores: DataFrame, metrics: Sequence[str], by: Sequence[str]) -> DataFrame:
    """Metric columns as rows ``(metric, value)``."""
    return scores.unpivot([F.col(c) for c in by], [F.col(m) for m in metrics], "metric", "value")
