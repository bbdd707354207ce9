"""Judged rankings and the metrics over them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from qaloom import prompts

METRICS = ("dcg", "ndcg", "mrr", "precision", "recall", "f1", "map")

QUERY = ("query_id",)

# Scores are compared at this many decimals: sums differ in the last digits between partitionings.
SCORE_DECIMALS = 6


# Spark limits the rows of a group in every task only below this k; from there on a group is cut into parts first.
OWN_LIMIT = 1_000
PARTS = 64


def top_k(
    df: DataFrame, k: int, by: Sequence[str], score: str = "score", tie: str = "doc_id", rank: str = "rank"
) -> DataFrame:
    """Best ``k`` rows per group, ranked by rounded score and then by id, for a group of any size.

    For a small ``k`` Spark limits every task to ``k`` rows per group before the shuffle. For a large one, the group
    is cut into parts by the hash of the id, each part keeps its best ``k``, and these meet.
    """
    order = F.round(score, SCORE_DECIMALS).desc(), F.col(tie).asc()
    if k >= OWN_LIMIT:
        parts = df.withColumn("_part", F.pmod(F.xxhash64(tie), F.lit(PARTS)))
        placed = parts.withColumn("_nth", F.row_number().over(Window.partitionBy(*by, "_part").orderBy(*order)))
        df = placed.where(F.col("_nth") <= k).drop("_nth", "_part")
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(rank) <= k)


def first_judgments(
    qrels: DataFrame, order: Column | str | None = None, query: Sequence[str] = QUERY
) -> DataFrame:
    """One judgment per (query, document): the first in ``order``.

    Without an order there is no first one, so a pair that is judged more than once is an error then.
    """
    if order is None:
        only = F.when(F.count("*") == 1, F.max("relevance"))
        chosen = only.otherwise(F.raise_error(F.lit("a pair is judged twice; name the column that orders the judgments")).cast("int"))
    else:
        chosen = F.min_by("relevance", F.col(order) if isinstance(order, str) else order)
    return qrels.groupBy(*query, "doc_id").agg(chosen.alias("relevance"))


def judge_hits(
    hits: DataFrame, qrels: DataFrame, order: Column | str | None = None, query: Sequence[str] = QUERY
) -> DataFrame:
    """Attach the judged relevance to every hit, the first in ``order``; an unjudged document counts 0."""
    judged = hits.join(first_judgments(qrels, order, query), [*query, "doc_id"], "left")
    return judged.withColumn("relevance", F.coalesce("relevance", F.lit(0)))


def grade_counts(qrels: DataFrame, query: Sequence[str] = QUERY) -> DataFrame:
    """Judgments per query and grade, counted before they are shuffled."""
    return qrels.groupBy(*query, "relevance").agg(F.count("*").alias("judgments"))


def ideal_ranking(qrels: DataFrame, k: int | None = None, query: Sequence[str] = QUERY) -> DataFrame:
    """All judgments of a query sorted by falling grade, run-length encoded.

    One row per query and grade with the first and last rank it fills, so a query with very many judgments stays
    as small as its number of grades. ``k`` keeps the grades that reach the first k ranks.
    """
    counted = grade_counts(qrels, query)
    falling = Window.partitionBy(*query).orderBy(F.col("relevance").desc())
    if k is not None:
        # Every grade fills at least one rank, so the k best grades cover the first k ranks.
        counted = counted.withColumn("_nth", F.row_number().over(falling)).where(F.col("_nth") <= k).drop("_nth")
    last = F.sum("judgments").over(falling.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return counted.withColumn("last_rank", last).withColumn(
        "first_rank", F.col("last_rank") - F.col("judgments") + 1
    )


def _discount_sum(upto: Column, k: int) -> Column:
    """Sum of 1/log2(i+1) for i = 1..min(upto, k), read from a k-entry literal table."""
    table = [F.lit(0.0)]
    total = F.lit(0.0)
    for i in range(1, k + 1):
        total = total + F.lit(1.0) / F.log2(F.lit(float(i + 1)))
        table.append(total)
    return F.get(F.array(*table), F.least(upto, F.lit(k)).cast("int"))


def ideal_profile(qrels: DataFrame, k: int = prompts.TOP_K, query: Sequence[str] = QUERY) -> DataFrame:
    """Per query: ideal DCG at k, number of judgments, number of relevant judgments."""
    gain = F.col("relevance") * (
        _discount_sum(F.col("last_rank"), k) - _discount_sum(F.col("first_rank") - 1, k)
    )
    best = ideal_ranking(qrels, k, query).groupBy(*query).agg(F.sum(gain).alias("ideal_dcg"))
    relevant = F.sum(F.when(F.col("relevance") > 0, F.col("judgments")).otherwise(F.lit(0)))
    sizes = grade_counts(qrels, query).groupBy(*query).agg(
        F.sum("judgments").alias("judged"), relevant.alias("relevant")
    )
    return best.join(sizes, list(query))


def ranking_metrics(
    judged: DataFrame,
    profile: DataFrame,
    queries: DataFrame,
    k: int = prompts.TOP_K,
    recall_denominator: str = "judged",
    ap_denominator: str = "found",
    keys: Sequence[str] = QUERY,
) -> DataFrame:
    """DCG, NDCG, reciprocal rank, P, R, F1 and AP at k for every row of ``queries``.

    ``judged`` holds ``keys``, ``rank`` and ``relevance``; ``queries`` holds ``keys``; ``profile`` comes from
    :func:`ideal_profile`. Recall divides by all judgments and AP by the hits found; ``"relevant"`` switches either
    to the relevant judgments. All values but DCG are scaled by 100. NDCG of a query whose ideal gain is zero is
    NULL, so averages skip it; a query without judgments scores 0.
    """
    keys = list(keys)
    query = [key for key in keys if key in profile.columns]
    hit = F.col("relevance") > 0
    running = Window.partitionBy(*keys).orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    shown = judged.where(F.col("rank") <= k).withColumn("_found", F.sum(hit.cast("int")).over(running))
    per_query = shown.groupBy(*keys).agg(
        F.sum(F.col("relevance") / F.log2(F.col("rank") + 1)).alias("dcg"),
        F.min(F.when(hit, F.col("rank"))).alias("_first"),
        F.count_if(hit).alias("_hits"),
        F.sum(F.when(hit, F.col("_found") / F.col("rank"))).alias("_precisions"),
    )
    rows = queries.select(*keys).join(per_query, keys, "left").join(profile, query, "left")
    zero = F.lit(0.0)
    hits = F.coalesce("_hits", F.lit(0))
    recall_base = {"judged": F.col("judged"), "relevant": F.col("relevant")}[recall_denominator]
    ap_base = {"found": F.col("_hits"), "relevant": F.col("relevant")}[ap_denominator]
    dcg = F.coalesce("dcg", zero)
    precision = hits / F.lit(k)
    recall = F.coalesce(F.try_divide(hits, recall_base), zero)
    f1 = F.coalesce(F.try_divide(2 * precision * recall, precision + recall), zero)
    ndcg = F.when(F.col("judged").isNull(), zero).otherwise(F.try_divide(dcg, F.col("ideal_dcg")))
    return rows.select(
        *keys,
        dcg.alias("dcg"),
        (ndcg * 100).alias("ndcg"),
        (F.coalesce(F.lit(1.0) / F.col("_first"), zero) * 100).alias("mrr"),
        (precision * 100).alias("precision"),
        (recall * 100).alias("recall"),
        (f1 * 100).alias("f1"),
        (F.coalesce(F.try_divide(F.col("_precisions"), ap_base), zero) * 100).alias("map"),
    )


def with_average(scores: DataFrame, by: Sequence[str] = (), label: str = "Average") -> DataFrame:
    """Add the macro average of every run as one more row, in a single pass over the scores."""
    by = list(by)
    grouped = scores.withColumn("query_id", F.col("query_id").cast("string")).groupingSets(
        [[*by, "query_id"], by], *by, "query_id"
    )
    rows = grouped.agg(F.grouping("query_id").alias("_all"), *[F.avg(m).alias(m) for m in METRICS])
    query = F.when(F.col("_all") == 1, F.lit(label)).otherwise(F.col("query_id"))
    return rows.select(*by, query.alias("query_id"), *METRICS)


def evaluate_ranking(
    hits: DataFrame,
    qrels: DataFrame,
    queries: DataFrame,
    k: int = prompts.TOP_K,
    modes: Sequence[str] | None = None,
    judgment_order: Column | str | None = None,
    average: bool = True,
    query: Sequence[str] = QUERY,
    **options: str,
) -> DataFrame:
    """Judge hits, score every query, and append the averages.

    ``queries`` are all queries that count: one without hits scores zero. With ``modes`` there is one run per search
    mode (a column of ``hits``), with ``query=("dataset", "query_id")`` one per dataset; all runs share one pass.
    """
    runs = [c for c in query if c != "query_id"]
    wanted = queries.select(*query)
    if modes is not None:
        runs = [*runs, "mode"]
        wanted = wanted.select(*query, F.explode(F.array(*[F.lit(m) for m in modes])).alias("mode"))
    judged = judge_hits(hits, qrels, judgment_order, query)
    profile = ideal_profile(qrels, k, query)
    scores = ranking_metrics(judged, profile, wanted, k, keys=[*runs, "query_id"], **options)
    return with_average(scores, runs) if average else scores
