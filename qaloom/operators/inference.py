"""Batch inference: a user's predict function run over prompts by the tasks."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import replace
from functools import reduce
from typing import Any

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from qaloom import prompts
from qaloom.operators.lanes import Budget, Lane, paced


class RateLimited(Exception):
    """Raised (or returned for one row) by a predict function that has to wait."""


# Takes the input rows of a batch as dicts and the settings; returns one text, or one exception, per row.
Predict = Callable[[list[dict[str, Any]], Mapping[str, Any]], Sequence[Any]]


def _call(rows: list[dict[str, Any]], predict: Predict, settings: Mapping[str, Any]) -> list[Any]:
    """One reply or exception per row. A call that fails as a whole is halved until the rows that fail it stand alone.

    A rate limit holds for the service, so the rows of such a call are not tried again at once.
    """
    try:
        results = list(predict(rows, settings))
        if len(results) != len(rows):
            raise ValueError(f"{len(results)} replies for {len(rows)} prompts")
        return results
    except RateLimited as limit:
        return [limit] * len(rows)
    except Exception as problem:
        if len(rows) == 1:
            return [problem]
        half = len(rows) // 2
        return _call(rows[:half], predict, settings) + _call(rows[half:], predict, settings)


def answer_batch(
    rows: list[dict[str, Any]],
    predict: Predict,
    settings: Mapping[str, Any],
    max_attempts: int,
    on_error: str,
    wait: float,
) -> tuple[list[str], list[int]]:
    """Replies and attempts per row; only failed rows are tried again, and rate limits double the wait.

    A row is charged one attempt per round, however many calls it took to find the rows that fail.
    """
    replies: list[str] = [on_error] * len(rows)
    attempts = [0] * len(rows)
    open_rows = list(range(len(rows)))
    for attempt in range(max_attempts):
        if not open_rows:
            break
        results = _call([rows[i] for i in open_rows], predict, settings)
        limited, failed = False, []
        for i, result in zip(open_rows, results, strict=True):
            attempts[i] += 1
            if isinstance(result, Exception) or result is None:
                failed.append(i)
                limited = limited or isinstance(result, RateLimited)
            else:
                replies[i] = str(result)
        open_rows = failed
        if limited and open_rows and attempt + 1 < max_attempts:
            time.sleep(wait)
            wait *= 2
    return replies, attempts


def generate(
    df: DataFrame,
    predict: Predict,
    inputs: Sequence[str],
    output: str = "reply",
    settings: Mapping[str, Any] = prompts.CLOSE_ENDED_SETTINGS,
    max_attempts: int = 5,
    on_error: str = "error",
    wait: float = 2.0,
    batch_rows: int = 64,
    budget: Budget | None = None,
) -> DataFrame:
    """``df`` with the model's ``output`` and the ``attempts`` it took, ``batch_rows`` prompts per call.

    With a ``budget`` (:mod:`qaloom.operators.lanes`) the rows are dealt to its lanes, whose calls together keep to the
    service's limits, repeated ones included; speculative tasks have to be off. Without one, each task waits for itself.
    Only ``inputs`` are handed to ``predict``. Long-form runs use ``max_attempts=1, on_error=""``. The result is
    computed again whenever it is read: write it (see :func:`generate_to_table`) before scoring.
    """
    fixed = dict(settings)
    names = list(inputs)
    if budget:
        # Where the cluster has cores for it, a lane is several tasks, each with its part of the lane's slots and tokens.
        budget = replace(budget, lanes=budget.lanes * max(1, df.sparkSession.sparkContext.defaultParallelism // budget.lanes))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call = paced(predict, Lane(TaskContext.get().partitionId(), budget)) if budget else predict
        for batch in batches:
            rows = batch[names].to_dict("records")
            replies: list[str] = []
            attempts: list[int] = []
            for start in range(0, len(rows), batch_rows):
                some = answer_batch(rows[start : start + batch_rows], call, fixed, max_attempts, on_error, wait)
                replies += some[0]
                attempts += some[1]
            yield batch.assign(**{output: replies, "attempts": attempts})

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields]
    dealt = df.repartition(budget.lanes) if budget else df
    return dealt.mapInPandas(run, ", ".join([*fields, f"`{output}` string", "attempts int"]))


def generate_to_table(
    df: DataFrame, predict: Predict, inputs: Sequence[str], keys: Sequence[str], path: str, waves: int = 1, **options: Any
) -> DataFrame:
    """Run :func:`generate` for the rows whose keys are not in the table at ``path`` yet, append, and read it all.

    The rows are asked in ``waves`` by the hash of their keys, and each wave is committed by itself: a restarted job
    repeats no call of a wave that ended. Null keys are keys like any other. Two rows of one key are an error, since a
    restart could not tell them apart.
    """
    spark = df.sparkSession
    twice = df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").limit(1).count()
    if twice:
        raise ValueError(f"the keys {list(keys)} name more than one row")
    wave = F.pmod(F.xxhash64(*keys), F.lit(waves))
    for number in range(waves):
        todo = df.where(wave == number)
        try:
            done = spark.read.parquet(path).select(*[F.col(key).alias(f"_done_{key}") for key in keys])
        except AnalysisException as missing:
            if "PATH_NOT_FOUND" not in str(missing):
                raise
        else:
            same = [F.col(key).eqNullSafe(F.col(f"_done_{key}")) for key in keys]
            todo = todo.join(done, reduce(Column.__and__, same), "left_anti")
        generate(todo, predict, inputs, **options).write.mode("append").parquet(path)
    return spark.read.parquet(path)


def model_score(
    df: DataFrame,
    scorer: Callable[[Sequence[str], Sequence[str]], Sequence[float]],
    candidate: str = "prediction",
    reference: str = "answer",
    output: str = "model_score",
) -> DataFrame:
    """A learned score per row from a user's batch scorer ``(references, candidates) -> floats``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            scores = scorer(batch[reference].tolist(), batch[candidate].tolist())
            yield batch.assign(**{output: [float(s) for s in scores]})

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields]
    return df.mapInPandas(run, ", ".join([*fields, f"`{output}` double"]))
