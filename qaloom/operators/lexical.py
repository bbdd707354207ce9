"""Lexical search: BM25 over a postings table, exact top-k."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from qaloom import prompts
from qaloom.functions.text import terms
from qaloom.operators.blockmax import BlockIndex, block_scores, impact, open_index, store_index, weight
from qaloom.operators.ranking import top_k
from qaloom.operators.skew import hot_keys, salted_join
from qaloom.session import broadcast_if_small, fits_broadcast, is_small, measure, stage

# Postings read per query, and documents per result place completed, to find a bound on the k-th best score.
SEED_POSTINGS = 2_000
SEED_FACTOR = 5
# The plain join of query terms and postings is taken while it emits no more pairs than this per core.
DIRECT_PAIRS_PER_CORE = 5_000_000
# A task adds up no more contributions of query terms to documents than about this many, for a table of any size.
PAIRS_PER_TASK = 1 << 20
# The commonest terms of a query are put off while together they reach at most this share of the bound.
PUT_OFF_SHARE = 0.5
# Pruning keeps this margin, wider than the decimals at which scores are compared.
MARGIN = 1e-5

# Every document has one posting under this term (no real term is empty); its frequency is the document length.
LENGTH_TERM = ""


@dataclass(frozen=True)
class LexicalIndex:
    """Postings ``(term, doc_id, length, tf)`` as a table, with the two corpus figures BM25 needs."""

    postings: DataFrame
    documents: int
    mean_length: float

    def impact(self) -> Column:
        """Length-normalized term frequency of a posting, without the weight of the term."""
        return impact(F.col("tf"), F.col("length"), self.mean_length)

    def idf(self, df: Column) -> Column:
        return weight(self.documents, df)


def _open_index(postings: DataFrame) -> LexicalIndex:
    figures = (
        postings.where(F.col("term") == LENGTH_TERM)
        .agg(F.count("*").alias("documents"), F.avg("length").alias("mean_length"))
        .first()
    )
    return LexicalIndex(postings, figures["documents"], float(figures["mean_length"] or 0.0))


def bm25_index(
    corpus: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    vocabulary: DataFrame | None = None,
    path: str | None = None,
) -> LexicalIndex | BlockIndex:
    """Tokenize the corpus once into a postings table.

    With a ``vocabulary`` (``term``) that is small, other terms are dropped before anything is shuffled; document
    lengths always count every term. Terms are combined per document before the shuffle. With a ``path``, which must
    not exist, the index of all terms is stored there in blocks, of which a search unpacks those that it needs.
    """
    if path is not None:
        return store_index(corpus, path, doc_id, text)
    tokenized = corpus.select(F.col(doc_id).alias("doc_id"), F.coalesce(terms(text), F.array()).alias("_terms"))
    measured = tokenized.select(
        "doc_id", F.size("_terms").alias("length"), F.concat(F.array(F.lit(LENGTH_TERM)), "_terms").alias("_terms")
    )
    # The list is never empty. The outer form keeps Spark from testing that by tokenizing once more.
    occurrences = measured.select("doc_id", "length", F.explode_outer("_terms").alias("term"))
    if vocabulary is not None and is_small(vocabulary):
        kept = vocabulary.select(F.explode(F.array(F.col("term"), F.lit(LENGTH_TERM))).alias("term")).distinct()
        occurrences = occurrences.join(F.broadcast(kept), "term", "left_semi")
    postings = occurrences.groupBy("term", "doc_id").agg(F.count("*").alias("tf"), F.max("length").alias("length"))
    return _open_index(stage(postings, "postings"))


def open_bm25_index(spark: SparkSession, path: str) -> BlockIndex:
    """An index written earlier by :func:`bm25_index` with a ``path``."""
    return open_index(spark, path)


def term_statistics(index: LexicalIndex | BlockIndex, vocabulary: DataFrame | None = None) -> DataFrame:
    """Per term (of a ``vocabulary``): documents, occurrences, weight, and the largest impact a document reaches."""
    if isinstance(index, BlockIndex):
        known = index.statistics
        return known if vocabulary is None else known.join(broadcast_if_small(vocabulary.select("term")), "term", "left_semi")
    postings = index.postings.where(F.col("term") != LENGTH_TERM)
    if vocabulary is not None:
        postings = postings.join(broadcast_if_small(vocabulary.select("term")), "term", "left_semi")
    counted = (
        postings.groupBy("term")
        .agg(
            F.count("*").alias("df"),
            F.sum("tf").alias("occurrences"),
            F.max(index.impact()).alias("top_impact"),
        )
    )
    return counted.withColumn("idf", index.idf(F.col("df")))


def query_terms(queries: DataFrame, query_id: str = "query_id", query: str = "query") -> DataFrame:
    """Terms of every query with their number of occurrences in it."""
    exploded = queries.select(F.col(query_id).alias("query_id"), F.explode(terms(query)).alias("term"))
    return exploded.groupBy("query_id", "term").agg(F.count("*").alias("qtf"))


def bm25_search(
    queries: DataFrame,
    corpus: DataFrame | LexicalIndex | BlockIndex,
    k: int = prompts.TOP_K,
    query_id: str = "query_id",
    query: str = "query",
    doc_id: str = "doc_id",
    text: str = "text",
    direct: bool | None = None,
) -> DataFrame:
    """Top ``k`` documents per query: ``query_id, doc_id, score, rank``.

    Joining every query term with its postings emits all pairs of a query and a document that share a word. Their
    number is known from the document frequencies, and while it is small for the cluster (or with ``direct``) the
    plain join is the fastest way.

    Beyond that the join is pruned, with the same result. Some documents found by each query's rarest terms are
    scored in full; their k-th best score bounds the result from below. A query's commonest terms are put off as
    long as their largest possible contributions sum to no more than a share of the bound. Documents are scored
    by the other terms, and only those that can still reach the bound are completed with the terms put off.

    A stored index is searched by its blocks (:mod:`qaloom.operators.blockmax`), with the same result again.
    """
    wanted = stage(query_terms(queries, query_id, query), "query-terms")
    if isinstance(corpus, BlockIndex):
        return top_k(block_scores(wanted, corpus, k), k, ["query_id"]).select("query_id", "doc_id", "score", "rank")
    vocabulary = stage(wanted.select("term").distinct(), "vocabulary")
    if isinstance(corpus, LexicalIndex):
        index = corpus
        statistics = term_statistics(index, vocabulary)
    else:
        index = bm25_index(corpus, doc_id, text, vocabulary)
        statistics = term_statistics(index)

    # A common word is a term of very many queries.
    statistics = stage(statistics, "term-statistics")
    if is_small(statistics):
        joined = wanted.join(F.broadcast(statistics), "term")
    else:
        askers = hot_keys(wanted.groupBy("term").agg(F.count("*").alias("rows")), "term", "rows")
        joined = salted_join(wanted, statistics, "term", "query_id", askers)
    weighted = joined.select(
        "query_id",
        "term",
        "df",
        (F.col("qtf") * F.col("idf")).alias("weight"),
        (F.col("qtf") * F.col("idf") * F.col("top_impact")).alias("most"),
    )
    weighted = stage(weighted, "query-weights")
    n_weights, n_bytes = measure(weighted)
    small = fits_broadcast(n_weights, n_bytes)
    hot = None if small else hot_keys(weighted.groupBy("term").agg(F.max("df").alias("df")), "term", "df")
    postings = index.postings.where(F.col("term") != LENGTH_TERM).select(
        "term", "doc_id", index.impact().alias("impact")
    )

    contribution = F.sum(F.col("weight") * F.col("impact")).alias("score")

    def matched_scores(some_weights: DataFrame, *more: Column) -> DataFrame:
        """Scores of the documents that hold some of the given query terms (with ``df``), by these terms.

        The document frequencies tell how many contributions the join emits. Where one task should not hold them, the
        postings are dealt by document first, so that each task adds up whole documents. All postings of a term meet
        all its queries: a broadcast if all weights are small, else a salted shuffle join.
        """
        emitted = some_weights.agg(F.sum("df").alias("rows")).first()["rows"] or 0
        tasks = _tasks(emitted)
        some_weights = some_weights.drop("df")
        if small:
            held = postings
            if tasks > 1:
                asked = F.broadcast(some_weights.select("term").distinct())
                held = postings.join(asked, "term", "left_semi").repartition(tasks, "doc_id")
            joined = held.join(F.broadcast(some_weights), "term")
        else:
            joined = salted_join(postings, some_weights, "term", "doc_id", hot)
            joined = joined.repartition(tasks, "query_id", "doc_id") if tasks > 1 else joined
        return joined.groupBy("query_id", "doc_id").agg(contribution, *more)

    def looked_up(pairs: DataFrame, some_weights: DataFrame, few: bool) -> DataFrame:
        """Contributions of the given terms to the given (query, document) pairs."""
        if small:
            wanted_postings = pairs.join(F.broadcast(some_weights), "query_id")
        else:
            pairs = stage(pairs, "pairs")
            many = hot_keys(pairs.groupBy("query_id").agg(F.count("*").alias("rows")), "query_id", "rows")
            wanted_postings = salted_join(pairs, some_weights, "query_id", "doc_id", many)
        return (F.broadcast(wanted_postings) if few else wanted_postings).join(postings, ["term", "doc_id"])

    if direct is None:
        pairs = weighted.agg(F.sum("df").alias("pairs")).first()["pairs"] or 0
        direct = pairs <= DIRECT_PAIRS_PER_CORE * wanted.sparkSession.sparkContext.defaultParallelism
    if direct:
        scores = matched_scores(weighted.select("query_id", "term", "weight", "df"))
        return top_k(scores, k, ["query_id"]).select("query_id", "doc_id", "score", "rank")

    rarest = Window.partitionBy("query_id").orderBy("df", "term")
    upto = rarest.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seeds = (
        weighted.withColumn("_read", F.sum("df").over(upto))
        .where((F.col("_read") <= SEED_POSTINGS) | (F.col("_read") == F.col("df")))
        .select("query_id", "term", "weight", "df")
    )
    n_seeds = SEED_FACTOR * k
    seed_pairs = top_k(matched_scores(seeds), n_seeds, ["query_id"])
    few_seeds = fits_broadcast(n_weights * n_seeds, n_bytes * n_seeds)
    seed_terms = looked_up(seed_pairs.select("query_id", "doc_id"), weighted.select("query_id", "term", "weight"), few_seeds)
    bounds = _kth_score(seed_terms.groupBy("query_id", "doc_id").agg(contribution), k)

    commonest = Window.partitionBy("query_id").orderBy(F.col("df").desc(), "term")
    running = commonest.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    reach = F.sum(F.when(F.col("put_off"), F.col("most"))).over(Window.partitionBy("query_id"))
    marked = (
        weighted.join(bounds, "query_id", "left")
        .withColumn("bound", F.coalesce("bound", F.lit(0.0)) - F.lit(MARGIN))
        .withColumn("put_off", F.sum("most").over(running) <= F.col("bound") * F.lit(PUT_OFF_SHARE))
        .withColumn("floor", F.col("bound") - F.coalesce(reach, F.lit(0.0)))
    )
    marked = stage(marked.select("query_id", "term", "weight", "df", "put_off", "floor"), "query-plan")

    generating = marked.where(~F.col("put_off")).drop("put_off")
    partial = matched_scores(generating, F.max("floor").alias("floor")).where(F.col("score") >= F.col("floor"))
    partial = stage(partial.select("query_id", "doc_id", "score"), "partial-scores")
    remaining = marked.where("put_off").select("query_id", "term", "weight")
    n_pairs, pair_bytes = measure(partial)
    longest = remaining.groupBy("query_id").agg(F.count("*").alias("n")).agg(F.max("n").alias("n")).first()["n"] or 0
    few = fits_broadcast(n_pairs * longest, pair_bytes * longest)
    completed = looked_up(partial.select("query_id", "doc_id"), remaining, few).select(
        "query_id", "doc_id", (F.col("weight") * F.col("impact")).alias("score")
    )
    summands, tasks = partial.unionByName(completed), _tasks(n_pairs * (1 + longest))
    summands = summands.repartition(tasks, "query_id", "doc_id") if tasks > 1 else summands
    totals = summands.groupBy("query_id", "doc_id").agg(F.sum("score").alias("score"))
    return top_k(totals, k, ["query_id"]).select("query_id", "doc_id", "score", "rank")


def _tasks(rows: int) -> int:
    """Tasks that so many contributions are dealt to."""
    return -(-rows // PAIRS_PER_TASK)


def _kth_score(scores: DataFrame, k: int) -> DataFrame:
    """The k-th best score of every query that has as many: no document of the top k scores less."""
    return top_k(scores, k, ["query_id"]).where(F.col("rank") == k).select("query_id", F.col("score").alias("bound"))
