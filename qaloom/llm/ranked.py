"""Ranked lexical search over impact vectors in buckets of equal length, with integer scores.

A document's impact at a term is the whole number that the term adds to the score of a query that holds it, so a score is
the inner product of the document's impact vector with the query's 0/1 vector. Vectors hold the terms of the queries
only. They are ordered by length (Euclidean norm) and scanned in buckets, longest first:

* By Cauchy-Schwarz a bucket whose longest vector times the root of the query's terms is below the query's k-th best
  score cannot add to its result, and neither can one whose largest impacts at the query's terms add up to less.
* Inside a bucket the query's commonest terms are put off as long as they cannot reach the k-th best score alone. The other
  terms' lists give partial sums; what a document lacks is bounded by the largest impacts of the terms put off and by
  Cauchy-Schwarz on the rest of its vector. Documents that cannot reach the k-th best score are dropped.
* The survivors are scored again from their whole vectors, in integers.

The first scan covers the longest vectors only. Its k-th best scores start the second, and with them the shortest vector
that can matter is known before anything is read.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from qaloom.llm.common import sent, slices
from qaloom.llm.tokens import NO_TERM, tokens
from qaloom.session import stage

TOP = 10
# Pairs of a query and its terms that are searched for together; more are searched in several blocks.
QUERY_TERMS = 1 << 20
# Vectors of the first scan; vectors of a bucket, and entries at which it is full before.
SEED_VECTORS = 16_384
BUCKET = 4_096
BUCKET_ENTRIES = 1 << 21
# Room for rounding where bounds are compared; survivors are scored exactly.
MARGIN = 1 - 1e-9
NO_ID = (1 << 63) - 1


def term_sets(queries: DataFrame, query_id: str, text: str) -> DataFrame:
    """``query, term`` (a hash) once for each term of each query; rows of equal id are one query."""

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = 0
            for part in slices(batch.column(1).cast(pa.binary()).to_pylist()):
                found, at = tokens(part, NO_TERM)
                who = np.repeat(np.arange(done, done + len(part)), np.diff(at))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(who)), pa.array(found.view(np.int64))], names=["query", "term"])
                done += len(part)

    rows = queries.select(F.col(query_id).cast("long").alias("query"), F.col(text).alias("text")).where("query IS NOT NULL")
    return rows.mapInArrow(terms, "query long, term long").distinct()


def profiles(docs: DataFrame, vocabulary: Callable[[], np.ndarray]) -> DataFrame:
    """``doc_id, n, at, tf``: terms of every document with repeats, and its terms of the sorted vocabulary with their counts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary()
        for batch in batches:
            done = 0
            for part in slices(batch.column(1).cast(pa.binary()).to_pylist()):
                n = len(part)
                found, at = tokens(part, NO_TERM)
                own, who = found[:0].astype(np.int64), found[:0].astype(np.int64)
                if len(known):
                    place = np.minimum(np.searchsorted(known, found), len(known) - 1)
                    hit = known[place] == found
                    own, who = place[hit], np.repeat(np.arange(n), np.diff(at))[hit]
                pairs, tf = np.unique(who * max(1, len(known)) + own, return_counts=True)
                offsets = pa.array(np.searchsorted(pairs, np.arange(n + 1) * max(1, len(known))).astype(np.int32))
                columns = [batch.column(0).slice(done, n), pa.array(np.diff(at).astype(np.int64))]
                columns += [pa.ListArray.from_arrays(offsets, pa.array((pairs % max(1, len(known))).astype(np.int32)))]
                columns += [pa.ListArray.from_arrays(offsets, pa.array(tf.astype(np.int32)))]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n", "at", "tf"])
                done += n

    return docs.mapInArrow(count, "doc_id long, n long, at array<int>, tf array<int>")


class Impacts:
    """Turns terms and counts into impacts: weights of the terms, and the two figures of the collection."""

    def __init__(self, weights: np.ndarray, documents: int, occurrences: int):
        self.weights, self.documents, self.occurrences = weights, documents, occurrences

    def of(self, n: np.ndarray, lists: pa.Array, tf: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Offsets, terms and impacts of vectors."""
        offsets = lists.offsets.to_numpy().astype(np.int64) - lists.offsets[0].as_py()
        at, times = lists.flatten().to_numpy(), tf.flatten().to_numpy().astype(np.int64)
        m = 100 - 90 + (90 * n * self.documents) // max(1, self.occurrences)
        m = np.repeat(m, np.diff(offsets))
        return offsets, at, self.weights[at] * ((1_000_000_000 * times) // (1000 * times + 8 * m))


class Bucket:
    """Vectors of similar length, by document and by term."""

    def __init__(self, ids: np.ndarray, norms: np.ndarray, offsets: np.ndarray, at: np.ndarray, impacts: np.ndarray):
        self.ids, self.norms, self.offsets, self.at, self.impacts = ids, norms, offsets, at, impacts
        self.longest = float(norms.max(initial=0))
        order = np.argsort(at, kind="stable")
        self.docs = np.repeat(np.arange(len(ids)), np.diff(offsets))[order]
        self.by_term, sorted_ = impacts[order].astype(np.float64), at[order]
        self.terms, self.begins = np.unique(sorted_, return_index=True)
        self.ends = np.append(self.begins[1:], len(sorted_))
        self.largest = np.maximum.reduceat(self.by_term, self.begins) if len(sorted_) else np.empty(0)

    def candidates(self, wanted: np.ndarray, least: float) -> np.ndarray:
        """Vectors that can reach ``least`` with the wanted terms: all that do, and few others."""
        place = np.searchsorted(self.terms, wanted)
        place = place[place < len(self.terms)]
        place = place[np.isin(self.terms[place], wanted, assume_unique=True)] if len(place) else place
        top = self.largest[place]
        if not len(place) or min(top.sum(), math.sqrt(len(place)) * self.longest) < least:
            return place[:0]
        order = np.argsort(self.begins[place] - self.ends[place], kind="stable")  # the longest lists first
        place, top = place[order], np.cumsum(top[order])
        alone = np.minimum(top, np.sqrt(np.arange(1, len(place) + 1)) * self.longest)
        put_off = int(np.searchsorted(alone >= least, True))
        lists = [slice(b, e) for b, e in zip(self.begins[place[put_off:]], self.ends[place[put_off:]], strict=True)]
        docs = np.concatenate([self.docs[x] for x in lists])
        values = np.concatenate([self.by_term[x] for x in lists])
        sums = np.bincount(docs, values, len(self.ids))
        if put_off:
            squares = np.bincount(docs, values * values, len(self.ids))
            rest = np.sqrt(np.maximum(self.norms**2 * (1 + 1e-12) - squares, 0) * put_off)
            bound = sums + np.minimum(rest, top[put_off - 1])
        else:
            bound = sums
        return np.flatnonzero((sums > 0) & (bound >= least))

    def scores(self, some: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        """Exact scores of some vectors."""
        sizes = np.diff(self.offsets)[some]
        begins = np.cumsum(sizes) - sizes
        entries = np.arange(sizes.sum()) + np.repeat(self.offsets[some] - begins, sizes)
        impacts = np.where(wanted[self.at[entries]], self.impacts[entries], 0)
        return np.add.reduceat(impacts, begins) if len(some) else np.empty(0, np.int64)


class Search:
    """The best ``k`` documents of every query over buckets as they come."""

    def __init__(self, queries: dict[int, np.ndarray], least: dict[int, int], k: int, vocabulary: int):
        self.queries, self.k, self.size = queries, k, vocabulary
        self.least = {q: max(1, least.get(q, 1)) for q in queries}
        self.best: dict[int, tuple[np.ndarray, np.ndarray]] = {q: (np.empty(0, np.int64),) * 2 for q in queries}
        self.scored = self.met = 0

    def add(self, bucket: Bucket) -> None:
        wanted = np.zeros(self.size, bool)
        for query, terms in self.queries.items():
            least = self.least[query]
            if math.sqrt(len(terms)) * bucket.longest < least * MARGIN:
                continue
            self.met += 1
            some = bucket.candidates(terms, least * MARGIN)
            if not len(some):
                continue
            wanted[terms] = True
            scores = bucket.scores(some, wanted)
            wanted[terms] = False
            self.scored += len(some)
            keep = scores >= least
            scores, ids = (np.concatenate(x) for x in zip(self.best[query], (scores[keep], bucket.ids[some[keep]]), strict=True))
            order = np.lexsort((ids, -scores))[: self.k]
            self.best[query] = scores[order], ids[order]
            if len(order) == self.k:
                self.least[query] = max(least, int(scores[order[-1]]))


def rank(
    queries: DataFrame, docs: DataFrame, k: int = TOP, query_id: str = "item_id", query: str = "text", doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``query, rank, doc_id, score``: the ``k`` documents with the highest scores above 0 of every query, ties by smaller id.

    Null and empty texts have no terms. Queries without id take no part, and those that share an id are one query with the terms
    of all. Documents that repeat, or share an id, are documents of their own; those without id come last among equal
    scores. Ids are whole numbers; other columns are not read.
    """
    asked = stage(term_sets(queries, query_id, query), "query-terms")
    blocks = max(1, -(-asked.count() // QUERY_TERMS))
    docs = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID)).alias("doc_id"), F.col(text).alias("text"))
    parts = [_rank_block(asked.where(F.pmod(F.xxhash64("query"), F.lit(blocks)) == b), docs, k) for b in range(blocks)]
    found = reduce(DataFrame.union, parts)
    return found.select("query", "rank", F.nullif(F.col("doc_id"), F.lit(NO_ID)).alias("doc_id"), "score")


def _best(found: DataFrame, k: int) -> DataFrame:
    order = W.partitionBy("query").orderBy(F.desc("score"), "doc_id")
    return found.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k)


def _rank_block(asked: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    spark = asked.sparkSession
    pairs = asked.toArrow()
    vocabulary, place = np.unique(pairs["term"].to_numpy().view(np.uint64), return_inverse=True)
    own = pairs["query"].to_numpy()
    order = np.lexsort((place, own))
    ids, begins = np.unique(own[order], return_index=True)
    wanted = {int(q): terms for q, terms in zip(ids, np.split(place[order], begins[1:]), strict=False)}

    found = stage(profiles(docs, sent(spark, vocabulary)), "profiles")
    figures = found.agg(F.count(F.when(F.col("n") > 0, 1)).alias("documents"), F.coalesce(F.sum("n"), F.lit(0)).alias("occurrences")).first()
    n = figures["documents"]
    # One row per term of the vocabulary at most.
    df = np.zeros(len(vocabulary), np.int64)
    for row in found.select(F.explode("at").alias("at")).groupBy("at").agg(F.count("*").alias("df")).collect():
        df[row["at"]] = row["df"]
    weights = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * x + 1))) for x in df.tolist()], np.int64)
    impacts = sent(spark, Impacts(weights, n, figures["occurrences"]))

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = impacts().of
        for batch in batches:
            offsets, _, values = of(batch.column(1).to_numpy(), batch.column(2), batch.column(3))
            sums = np.concatenate([[0.0], np.cumsum(values.astype(np.float64) ** 2)])
            # Lengths are rounded up to single precision, so they bound their vectors.
            norms = np.nextafter(np.sqrt(np.diff(sums[offsets])).astype(np.float32), np.float32(np.inf)).astype(np.float64)
            yield pa.RecordBatch.from_arrays([pa.array(norms), *batch.columns], names=["norm", *batch.schema.names])

    vectors = found.where(F.size("at") > 0).mapInArrow(measured, "norm double, doc_id long, n long, at array<int>, tf array<int>")
    # Copies of a document have one length, so their ids spread them.
    vectors = vectors.repartitionByRange(F.desc("norm"), F.xxhash64("doc_id")).sortWithinPartitions(F.desc("norm"))
    vectors = stage(vectors, "vectors")
    n_vectors = vectors.count()
    share = max(0.0, 1 - SEED_VECTORS / max(1, n_vectors))
    cut = vectors.agg(F.percentile_approx("norm", F.lit(share), F.lit(1000)).alias("cut")).first()["cut"] or 0.0
    setup = (wanted, k, len(vocabulary))
    seeds = stage(_scan(vectors.where(F.col("norm") >= cut), sent(spark, (*setup, {})), impacts, k), "seeds")
    least = {row["query"]: row["score"] for row in _best(seeds, k).where(F.col("rank") == k).select("query", "score").collect()}
    # No vector shorter than this reaches the k-th best score of any query.
    shortest = min((least.get(q, 0) / math.sqrt(len(terms)) for q, terms in wanted.items()), default=0.0) * MARGIN
    others = vectors.where((F.col("norm") < cut) & (F.col("norm") >= shortest))
    return _best(seeds.union(_scan(others, sent(spark, (*setup, least)), impacts, k)), k).select("query", "rank", "doc_id", "score")


def _scan(vectors: DataFrame, setup: Callable[[], Any], impacts: Callable[[], Impacts], k: int) -> DataFrame:
    """``query, doc_id, score``: the best ``k`` of every query in every task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (wanted, k, size, least), of = setup(), impacts().of
        search = Search(wanted, least, k, size)
        for batch in batches:
            for part in _buckets(batch):
                offsets, at, values = of(part.column(2).to_numpy(), part.column(3), part.column(4))
                search.add(Bucket(part.column(1).to_numpy(), part.column(0).to_numpy(), offsets, at, values))
        hits = [(q, s, i) for q, (s, i) in search.best.items() if len(s)]
        if hits:
            columns = [np.concatenate([np.full(len(s), q, np.int64) for q, s, _ in hits])]
            columns += [np.concatenate([i for *_, i in hits]), np.concatenate([s for _, s, _ in hits])]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["query", "doc_id", "score"])

    return vectors.mapInArrow(run, "query long, doc_id long, score long")


def _buckets(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Neighbouring vectors of a batch, as many as a bucket holds."""
    offsets = batch.column(3).offsets.to_numpy()
    begin = 0
    while begin < batch.num_rows:
        end = int(np.searchsorted(offsets, offsets[begin] + BUCKET_ENTRIES))
        end = min(max(end - 1, begin + 1), begin + BUCKET, batch.num_rows)
        yield batch.slice(begin, end - begin)
        begin = end
