"""A stored lexical index in blocks of documents, and exact search that skips blocks.

Documents are dealt into blocks of similar length. A stored row holds all postings of a term in one block, with the largest
impact among them. A query's weights times these impacts, added up per block, bound what any document of the block can score;
that needs the small columns of the query's terms only. The blocks with the best bounds are scored first, their k-th best
score is the query's bar, and of the other blocks only those whose bound reaches the bar are unpacked and scored.
A block is scored in one piece for many queries, and only each query's best documents leave it. Common terms that add little are
put off: documents are found by the other terms, in single precision, and those that can still reach the bar are scored in full.
The queries go to every task, and a block's postings are put together once, so no row per query and block is ever made.

Rows lie in folders by the hash of the term, sorted by term and block. The number of folders follows the number of postings, and a
folder has as many files as its rows need.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from qaloom.functions.text import terms
from qaloom.operators.numbering import global_index
from qaloom.operators.skew import hot_keys, salted_join
from qaloom.operators.tiles import best_per_row
from qaloom.session import broadcast_if_small, is_small, stage

# BM25 saturation and length parameters.
K1 = 1.2
B = 0.75

# Documents of a block and the words in them, and postings of a folder. A longer document is a block of its own or shares one.
BLOCK_DOCUMENTS = 2_048
BLOCK_WORDS = 1 << 20
FOLDER_POSTINGS = 1 << 22
# Documents of like length share a block: lengths are told apart by this many steps for each power of two.
LENGTH_STEPS = 4
# A search for no more terms than this names them to the scan.
NAMED_TERMS = 500
# The blocks that are scored first hold so many documents for each place of the result.
SEED_DOCUMENTS = 800
# As many of them at most for each task that looks for them.
FIRST_BLOCKS = 4
# Terms of queries that go to every task at once (48 MB), scores that are held at once (4 MB), and impacts that are looked up at once.
ASKED = 1 << 22
HELD_SCORES = 1 << 20
LOOKED_UP = 1 << 18
# Best scores of the queries that a task holds (16 MB).
HELD_BEST = 1 << 21
# Blocks of a task.
TASK_BLOCKS = 4
# A term of one in so many documents of a block, or more, is common there; as many are taken as have this many scores (4 MB).
COMMON_SHARE = 32
COMMON_CELLS = 1 << 20
# A matrix product adds up as many cells in the time in which one posting is added.
PRODUCT_GAIN = 250
# Common terms are put off up to this share of the bar.
PUT_OFF_SHARE = 0.5
# Twice the relative error of a single-precision number.
SINGLE = 2.0**-23
NOBODY = np.empty(0, np.int64)
# Wider than the decimals at which scores are compared.
MARGIN = 1e-5
# Decimals at which scores are compared.
DECIMALS = 6


def impact(tf: Column, length: Column, mean_length: float) -> Column:
    """Length-normalized term frequency of a posting, without the weight of the term."""
    norm = F.lit(K1) * (F.lit(1 - B) + F.lit(B) * length / F.lit(mean_length or 1.0))
    return tf * F.lit(K1 + 1) / (tf + norm)


def weight(documents: int, df: Column) -> Column:
    """Inverse document frequency of a term."""
    n = F.lit(float(documents))
    return F.log(F.lit(1.0) + (n - df + 0.5) / (df + 0.5))


@dataclass(frozen=True)
class BlockIndex:
    """``blocks``: ``folder, term, block, n, top, docs, tfs, lengths``; ``statistics``: ``term, df, occurrences, top_impact, idf``."""

    blocks: DataFrame
    statistics: DataFrame
    documents: int
    mean_length: float
    folders: int

    def of_terms(self, vocabulary: DataFrame) -> DataFrame:
        """The rows that can hold the terms (a table ``term``): other folders are not read."""
        folders = vocabulary.select(folder_of("term", self.folders).alias("folder")).distinct().limit(self.folders)
        rows = self.blocks.where(F.col("folder").isin([row["folder"] for row in folders.collect()]))
        named = [row["term"] for row in vocabulary.select("term").distinct().limit(NAMED_TERMS + 1).collect()]
        return rows.where(F.col("term").isin(named)) if len(named) <= NAMED_TERMS else rows


def folder_of(term: Column | str, folders: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(folders)).cast("int")


def store_index(corpus: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> BlockIndex:
    """Write the index of a corpus to ``path``, which must not exist, and open it. Ids have to be unique."""
    spark = corpus.sparkSession
    tokenized = corpus.select(F.col(doc_id).alias("doc_id"), F.coalesce(terms(text), F.array()).alias("terms"))
    tokenized = stage(tokenized.withColumn("length", F.size("terms")), "tokenized")
    stratum = F.floor(F.log2(F.col("length") + 1) * LENGTH_STEPS).cast("long")
    # One row for each step of lengths.
    strata = tokenized.groupBy(stratum.alias("stratum")).agg(F.count("*").alias("documents"), F.sum("length").alias("postings")).collect()
    documents = sum(row["documents"] for row in strata)
    postings = sum(row["postings"] for row in strata)
    mean_length = postings / documents if documents else 0.0
    folders = max(1, -(-postings // FOLDER_POSTINGS))
    parts = {row["stratum"]: max(1, -(-row["documents"] // BLOCK_DOCUMENTS), -(-row["postings"] // BLOCK_WORDS)) for row in strata}
    sizes = F.create_map(*[F.lit(x) for pair in parts.items() for x in pair]) if parts else F.lit(None).cast("map<bigint,int>")
    block = stratum * F.lit(1 << 40) + F.pmod(F.xxhash64("doc_id"), sizes[stratum].cast("long"))
    # A document's block is known before its terms are, so a block's postings are put together where its documents meet.
    words = tokenized.where("length > 0").select("doc_id", "length", block.alias("block"), "terms")
    kind = words.schema["doc_id"].dataType.simpleString()
    shape = f"term string, block bigint, n bigint, occurrences bigint, top double, docs array<{kind}>, tfs array<int>, lengths array<int>"
    counted = words.groupBy("block").applyInArrow(lambda rows: _postings(rows, mean_length), shape)
    counted = stage(counted.withColumn("folder", folder_of("term", folders)), "postings")
    # Ranges keep the blocks of a common term apart.
    keys = ["folder", "term", "block"]
    packed = counted.select(*keys, "n", "occurrences", "top", "docs", "tfs", "lengths").repartitionByRange(*keys)
    packed.sortWithinPartitions(*keys).write.partitionBy("folder").parquet(f"{path}/blocks")
    blocks = spark.read.schema(packed.schema).parquet(f"{path}/blocks")
    statistics = blocks.groupBy("term").agg(F.sum("n").alias("df"), F.sum("occurrences").alias("occurrences"), F.max("top").alias("top_impact"))
    statistics.withColumn("idf", weight(documents, F.col("df"))).write.parquet(f"{path}/terms")
    figures = spark.range(1).select(F.lit(documents).alias("documents"), F.lit(mean_length).alias("mean_length"), F.lit(folders).alias("folders"))
    figures.write.parquet(f"{path}/corpus")
    packed.limit(0).write.parquet(f"{path}/shape")
    return open_index(spark, path)


def open_index(spark: SparkSession, path: str) -> BlockIndex:
    """An index written earlier by :func:`store_index`."""
    figures = spark.read.parquet(f"{path}/corpus").first()
    blocks = spark.read.schema(spark.read.parquet(f"{path}/shape").schema).parquet(f"{path}/blocks")
    return BlockIndex(blocks, spark.read.parquet(f"{path}/terms"), figures["documents"], figures["mean_length"], figures["folders"])


def _impacts(tfs: np.ndarray, lengths: np.ndarray, mean_length: float) -> np.ndarray:
    """As :func:`impact`."""
    tfs = tfs.astype(np.float64)
    return tfs * (K1 + 1) / (tfs + K1 * ((1 - B) + B * lengths.astype(np.float64) / (mean_length or 1.0)))


def _postings(rows: pa.Table, mean_length: float) -> pa.Table:
    """One row per term of a block: its postings in the order of the ids."""
    words, number = rows["terms"].combine_chunks(), rows["block"][0]
    known, places = _numbered(rows["doc_id"].combine_chunks())
    row = np.repeat(np.arange(len(words)), pc.list_value_length(words).to_numpy(zero_copy_only=False))
    coded = words.flatten().dictionary_encode()
    key = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64) * len(known) + places[row]
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.concatenate([[True], np.diff(key) != 0]))
    tfs = np.diff(np.append(first, len(key))).astype(np.int32)
    # Rows that share an id are one document, as long as its longest.
    lengths = np.maximum.reduceat(rows["length"].to_numpy()[row[order]], first).astype(np.int32)
    term, place = key[first] // len(known), key[first] % len(known)
    begin = np.flatnonzero(np.concatenate([[True], np.diff(term) != 0]))
    ends = np.append(begin, len(term))
    offsets = pa.array(ends, pa.int32())
    columns = {
        "term": coded.dictionary.take(pa.array(term[begin])),
        "block": pa.array(np.full(len(begin), number.as_py()), pa.int64()),
        "n": pa.array(np.diff(ends), pa.int64()),
        "occurrences": pa.array(np.add.reduceat(tfs.astype(np.int64), begin), pa.int64()),
        "top": pa.array(np.maximum.reduceat(_impacts(tfs, lengths, mean_length), begin)),
        "docs": pa.ListArray.from_arrays(offsets, known.take(pa.array(place))),
        "tfs": pa.ListArray.from_arrays(offsets, pa.array(tfs)),
        "lengths": pa.ListArray.from_arrays(offsets, pa.array(lengths)),
    }
    return pa.table(columns)


def block_scores(wanted: DataFrame, index: BlockIndex, k: int, report: dict[str, int] | None = None) -> DataFrame:
    """``query_id, doc_id, score`` of all documents that can be among the ``k`` best of a query.

    ``wanted`` is a staged table ``query_id, term, qtf``. A ``report`` gets the numbers of blocks of the queries' terms and of those
    that the first bars leave to be scored, both counted once for each query that asks for them.
    """
    vocabulary = stage(wanted.select("term").distinct(), "vocabulary")
    known = index.statistics.join(broadcast_if_small(vocabulary), "term", "left_semi")
    codes = stage(global_index(known.select("term", "idf", "top_impact"), ["term"], "code"), "codes")
    weight_ = F.col("qtf") * F.col("idf")
    asked = _joined(wanted.where("query_id IS NOT NULL"), codes, "query_id").select("query_id", (weight_ * F.col("top_impact")).alias("most"), F.col("code").cast("int").alias("code"), weight_.alias("weight"))
    # The terms that add least come first.
    asked = asked.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("most", "code", "weight"))).alias("terms"))
    asked = stage(asked.select("query_id", F.col("terms.code").alias("codes"), F.col("terms.weight").alias("weights")), "weights")
    rows = _joined(codes.select("term", "code"), index.of_terms(vocabulary), "block").select("code", "block", "top", "docs", "tfs", "lengths")
    kind, mean_length = rows.schema["docs"].dataType.simpleString(), index.mean_length
    shape = f"block bigint, documents int, ids {kind}, codes binary, tops binary, ends binary, places binary, impacts binary"
    blocks = stage(rows.groupBy("block").applyInArrow(lambda block: _block(block, mean_length), shape), "blocks")
    tasks = max(1, -(-blocks.count() // TASK_BLOCKS))
    passes = max(1, -(-(asked.agg(F.sum(F.size("codes")).alias("n")).first()["n"] or 0) // ASKED))
    part, vocabulary_size = F.pmod(F.xxhash64("query_id", F.lit(5)), F.lit(passes)), codes.count()
    found = [_pass(asked.where(part == i), blocks, tasks, vocabulary_size, k, report) for i in range(passes)]
    united = found[0]
    for more in found[1:]:
        united = united.unionByName(more)
    return united


def _block(rows: pa.Table, mean_length: float) -> pa.Table:
    """All postings of a block in one row: its documents by id, its terms by code, and places and impacts term after term."""
    number, rows = rows["block"][0].as_py(), rows.sort_by("code")
    docs, tfs, lengths = (rows[name].combine_chunks() for name in ("docs", "tfs", "lengths"))
    ends = np.concatenate([[0], np.cumsum(pc.list_value_length(docs).to_numpy(zero_copy_only=False))])
    known, places = _numbered(docs.flatten())
    impacts = _impacts(tfs.flatten().to_numpy(zero_copy_only=False), lengths.flatten().to_numpy(zero_copy_only=False), mean_length)
    held = {
        "codes": rows["code"].to_numpy().astype(np.int32),
        "tops": rows["top"].to_numpy().astype(np.float64),
        "ends": ends.astype(np.int64),
        "places": places.astype(np.int32),
        "impacts": impacts,
    }
    ids = pa.ListArray.from_arrays(pa.array([0, len(known)], pa.int32()), known)
    columns = {"block": pa.array([number], pa.int64()), "documents": pa.array([len(known)], pa.int32()), "ids": ids}
    return pa.table(columns | {name: pa.array([x.tobytes()], pa.binary()) for name, x in held.items()})


def _pass(left: DataFrame, blocks: DataFrame, tasks: int, vocabulary_size: int, k: int, report: dict[str, int] | None) -> DataFrame:
    """The search for the queries that go to every task together."""
    spark, asked = left.sparkSession, left.toArrow()
    held = spark.sparkContext.broadcast(_Asked.of(asked, vocabulary_size))
    query_kind = left.schema["query_id"].dataType.simpleString()
    doc_kind = blocks.schema["ids"].dataType.elementType.simpleString()
    shape = f"_row int, query_id {query_kind}, doc_id {doc_kind}, score double"

    def promising(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, best = held.value, None
        for batch in batches:
            for block, documents, codes, tops in _unpacked(batch, np.int32, np.float64):
                bounds = asked.bounds(codes, tops)
                if best is None:
                    best = np.full((3, len(bounds), FIRST_BLOCKS), -np.inf), np.arange(len(bounds))
                (bound, number, size), every = best
                # The block takes the place of the worst that is held, which only starts to matter when all places are taken.
                worst = bound.argmin(axis=1)
                better = every[bounds > np.maximum(bound[every, worst], 0.0)]
                bound[better, worst[better]], number[better, worst[better]], size[better, worst[better]] = bounds[better], block, documents
        if best is not None:
            (bound, number, size), _ = best
            row, place = np.nonzero(bound > 0)
            columns = row.astype(np.int32), number[row, place].astype(np.int64), bound[row, place], size[row, place].astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["_row", "block", "bound", "n"])

    # The bounds need the small columns only.
    heads = blocks.select("block", "documents", "codes", "tops")
    best = Window.partitionBy("_row").orderBy(F.desc("bound"), "block")
    before = F.coalesce(F.sum("n").over(best.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = heads.mapInArrow(promising, "_row int, block bigint, bound double, n int").withColumn("_held", before)
    first = first.where(F.col("_held") < SEED_DOCUMENTS * k).select("_row", "block").toArrow()
    first = _by_block(first["block"].to_numpy(), first["_row"].to_numpy())
    firsts = spark.sparkContext.broadcast(first)

    def seed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nothing = np.full(len(held.value.ids), -np.inf)
        scorer = _Scorer(held.value, k, nothing[:, None][:, :0], nothing)
        for batch in batches:
            yield from scorer.add(batch, lambda block, _: firsts.value.get(block, NOBODY))

    seeds = stage(blocks.repartition(tasks).mapInArrow(seed, shape), "seed-scores")
    place = F.row_number().over(Window.partitionBy("_row").orderBy(F.desc("score")))
    last = seeds.withColumn("_place", place).where(F.col("_place") == k).select("_row", "score").toArrow()
    bar = np.full(asked.num_rows, -np.inf)
    bar[last["_row"].to_numpy()] = last["score"].to_numpy() - MARGIN
    # The k best scores of each query so far, if they are not too many to be held.
    best = np.full((asked.num_rows, k if asked.num_rows * k <= HELD_BEST else 0), -np.inf)
    if best.size:
        first_k = seeds.withColumn("_place", place).where(F.col("_place") <= k).select("_row", "_place", "score").toArrow()
        best[first_k["_row"].to_numpy(), first_k["_place"].to_numpy() - 1] = first_k["score"].to_numpy()
    bars = spark.sparkContext.broadcast((best, bar))

    def left_over(block: int, reached: np.ndarray) -> np.ndarray:
        reached[firsts.value.get(block, NOBODY)] = False
        return np.flatnonzero(reached)

    def rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _Scorer(held.value, k, *(x.copy() for x in bars.value))
        for batch in batches:
            yield from scorer.add(batch, left_over)

    if report is not None:

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for block, _, codes, tops in _unpacked(batch, np.int32, np.float64):
                    terms = held.value.bounds(codes, np.ones(len(codes)), weighted=False)
                    reached = held.value.bounds(codes, tops) >= bars.value[1]
                    reached[firsts.value.get(block, NOBODY)] = True
                    figures = int(terms.sum()), int(terms[reached].sum())
                    yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in figures], names=["blocks", "unpacked"])

        for name, figure in heads.mapInArrow(count, "blocks bigint, unpacked bigint").groupBy().sum().first().asDict().items():
            name = name.removeprefix("sum(").removesuffix(")")
            report[name] = report.get(name, 0) + (figure or 0)
    return seeds.unionByName(blocks.repartition(tasks).mapInArrow(rest, shape)).drop("_row")


def _unpacked(batch: pa.RecordBatch, *kinds: type) -> Iterator[tuple]:
    """The rows of packed blocks, arrays as views of their bytes."""
    first = batch.num_columns - len(kinds)
    for i in range(batch.num_rows):
        plain = [batch.column(c)[i].as_py() for c in range(2)] + [batch.column(c)[i].values for c in range(2, first)]
        yield *plain, *(np.frombuffer(batch.column(first + c)[i].as_buffer(), kind) for c, kind in enumerate(kinds))


def _by_block(blocks: np.ndarray, rows: np.ndarray) -> dict[int, np.ndarray]:
    order = np.lexsort((rows, blocks))
    names, begin = np.unique(blocks[order], return_index=True)
    return dict(zip(names.tolist(), np.split(rows[order], begin[1:]), strict=True)) if len(names) else {}


def _ranges(begin: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All numbers of the ranges that begin at the given numbers and have the given sizes, range after range."""
    ends = np.cumsum(sizes)
    return np.repeat(begin - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


@dataclass
class _Asked:
    """The queries of a pass, and term after term their codes and weights. Queries that share their most asked term are neighbours."""

    ids: pa.Array
    begin: np.ndarray
    codes: np.ndarray
    weights: np.ndarray
    order: np.ndarray
    times: np.ndarray

    @classmethod
    def of(cls, asked: pa.Table, vocabulary_size: int) -> _Asked:
        codes, weights = (pa.concat_arrays(asked[name].chunks) if asked.num_rows else pa.array([], pa.list_(pa.int64())) for name in ("codes", "weights"))
        begin = np.concatenate([[0], np.cumsum(pc.list_value_length(codes).to_numpy(zero_copy_only=False))]).astype(np.int64)
        codes = codes.flatten().to_numpy(zero_copy_only=False).astype(np.int32)
        weights = weights.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        times = np.bincount(codes, minlength=vocabulary_size)
        common = np.maximum.reduceat(times[codes] * np.int64(vocabulary_size) + codes, begin[:-1]) if len(codes) else begin[:-1]
        place = np.empty(len(common), np.int32)
        place[np.argsort(-common, kind="stable")] = np.arange(len(common))
        return cls(asked["query_id"].combine_chunks(), begin, codes, weights, place, times)

    def bounds(self, codes: np.ndarray, tops: np.ndarray, weighted: bool = True) -> np.ndarray:
        """What a document of the block can score for every query, at most; or the number of its terms in the block."""
        if not len(self.codes):
            return np.zeros(0)
        top = np.zeros(len(self.times))
        top[codes] = tops
        each = top[self.codes]
        return np.add.reduceat(each * self.weights if weighted else each, self.begin[:-1])


class _Scorer:
    """Scores packed blocks for the queries that want them.

    ``bar`` is what a hit has to reach. It rises with the ``k`` best scores so far, where these are held.
    """

    def __init__(self, asked: _Asked, k: int, best: np.ndarray, bar: np.ndarray):
        self.asked, self.k, self.best, self.bar = asked, k, best, bar
        self.local = np.full(len(asked.times), -1, np.int32)

    def add(self, batch: pa.RecordBatch, choose: Callable[[int, np.ndarray], np.ndarray]) -> Iterator[pa.RecordBatch]:
        asked = self.asked
        for number, documents, ids, codes, tops, ends, places, impacts in _unpacked(batch, np.int32, np.float64, np.int64, np.int32, np.float64):
            bounds = asked.bounds(codes, tops)
            rows = choose(number, (bounds > 0) & (bounds >= self.bar))
            if not len(rows):
                continue
            rows = rows[np.argsort(asked.order[rows])]
            self.local[codes] = np.arange(len(codes))
            block = _Postings(documents, tops, ends, places, impacts, asked.times[codes])
            for some in np.array_split(rows, -(-len(rows) * documents // HELD_SCORES)):
                row, place, score = self._best(some, block)
                columns = [pa.array(row, pa.int32()), asked.ids.take(pa.array(row)), ids.take(pa.array(place)), pa.array(score)]
                yield pa.RecordBatch.from_arrays(columns, names=["_row", "query_id", "doc_id", "score"])
            self.local[codes] = -1

    def _best(self, rows: np.ndarray, block: _Postings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows, places and scores of the best ``k`` documents of a block for some queries."""
        asked, n, m = self.asked, block.documents, len(rows)
        sizes = asked.begin[rows + 1] - asked.begin[rows]
        entry = _ranges(asked.begin[rows], sizes)
        query, term, weight = np.repeat(np.arange(m), sizes), self.local[asked.codes[entry]], asked.weights[entry]
        query, term, weight = query[term >= 0], term[term >= 0], weight[term >= 0]
        terms = np.bincount(query, minlength=m)
        bar = self.bar[rows]
        slack = MARGIN + np.maximum(bar, 0) * (terms + 4) * SINGLE
        # The common terms that add least are put off as long as they add no more than a share of the bar.
        column = block.column[term]
        most = np.where(column >= 0, weight * block.tops[term], 0.0)
        before = np.concatenate([[0.0], np.cumsum(most)])
        added = before[1:] - before[np.concatenate([[0], np.cumsum(terms)])[query]]
        off = (column >= 0) & (added <= PUT_OFF_SHARE * bar[query])
        rest = np.bincount(query[off], most[off], minlength=m)
        # The others are added up, in one product where many queries ask for terms of many documents.
        now = ~off
        uses = np.bincount(column[now & (column >= 0)], minlength=len(block.common))
        taken = uses * block.sizes[block.common] > m * n // PRODUCT_GAIN
        product = now & (column >= 0)
        product[product] = taken[column[product]]
        if taken.any():
            matrix = np.zeros((m, int(taken.sum())), np.float32)
            matrix[query[product], (np.cumsum(taken) - 1)[column[product]]] = weight[product]
            scores = matrix @ (block.dense if taken.all() else block.dense[taken])
        else:
            scores = np.zeros((m, n), np.float32)
        flat = scores.reshape(-1)
        block.scatter(flat, query[now & ~product], term[now & ~product], weight[now & ~product])
        least = bar - rest - slack
        if (unbarred := np.flatnonzero(np.isneginf(bar))).size:
            least[unbarred] = -np.inf
            if n > self.k:
                nth = np.partition(scores[unbarred], n - self.k, axis=1)[:, n - self.k].astype(np.float64)
                least[unbarred] = nth * (1 - (terms[unbarred] + 4) * 2 * SINGLE) - MARGIN
        # What has none of the terms that were added up can still be a hit where the bar is next to nothing.
        least = np.where(rest > 0, least, np.maximum(least, np.finfo(np.float32).tiny))
        found = np.flatnonzero((scores >= least.astype(np.float32)[:, None]).reshape(-1))
        partial = flat[found].astype(np.float64)
        query_found = found // n
        if off.any() and len(found):
            partial += block.looked_up(found, n, query[off], term[off], weight[off], m)
        kept = partial >= np.where(np.isneginf(bar), -np.inf, bar - slack)[query_found]
        # What is less than the k-th best by more than the error of both is not among the best.
        found, partial, query_found = found[kept], partial[kept], query_found[kept]
        order = np.lexsort((-partial, query_found))
        hits = np.bincount(query_found, minlength=m)
        nth = (np.cumsum(hits) - hits)[hits > self.k] + self.k - 1
        least = np.full(m, -np.inf)
        least[hits > self.k] = partial[order][nth] * (1 - 2 * (terms[hits > self.k] + 4) * SINGLE) - MARGIN
        found = found[partial >= least[query_found]]
        exact = block.exact(found, n, query, term, weight, m)
        found, exact = found[exact > 0], exact[exact > 0]
        query_found, place = found // n, found % n
        best = best_per_row(query_found, np.round(exact, DECIMALS), place, self.k)
        query_found, place, exact = query_found[best], place[best], exact[best]
        reached = exact >= bar[query_found]
        query_found, place, exact = query_found[reached], place[reached], exact[reached]
        self._raise(rows, query_found, exact)
        return rows[query_found], place, exact

    def _raise(self, rows: np.ndarray, query: np.ndarray, scores: np.ndarray) -> None:
        """Raise the bars of the queries by the scores that were found for them, best first."""
        if not self.best.shape[1]:
            return
        hits = np.bincount(query, minlength=len(rows))
        own = np.flatnonzero(hits)
        new = np.full((len(own), self.k), -np.inf)
        new[np.repeat(np.arange(len(own)), hits[own]), _ranges(np.zeros(len(own), np.int64), hits[own])] = scores
        own = rows[own]
        new = np.concatenate([self.best[own], new], axis=1)
        self.best[own] = np.partition(new, self.k, axis=1)[:, self.k :]
        self.bar[own] = np.maximum(self.bar[own], self.best[own].min(axis=1) - MARGIN)


class _Postings:
    """A block's postings: ``common`` terms also as rows of a matrix with a column per document."""

    def __init__(self, documents: int, tops: np.ndarray, ends: np.ndarray, places: np.ndarray, impacts: np.ndarray, times: np.ndarray):
        self.documents, self.tops, self.ends, self.places, self.impacts = documents, tops, ends, places, impacts
        self.sizes = np.diff(ends)
        common = np.flatnonzero((self.sizes * COMMON_SHARE >= documents) & (times > 0))
        most = max(1, COMMON_CELLS // documents)
        if len(common) > most:
            common = np.sort(common[np.argpartition(-(times * self.sizes)[common], most)[:most]])
        self.common = common
        self.column = np.full(len(self.sizes), -1, np.int64)
        self.column[common] = np.arange(len(common))
        self.dense = np.zeros((len(common), documents), np.float32)
        some = _ranges(ends[common], self.sizes[common])
        self.dense[np.repeat(np.arange(len(common)), self.sizes[common]), places[some]] = impacts[some]
        # Postings lie by term and place.
        self.key = np.repeat(np.arange(len(self.sizes)) * documents, self.sizes) + places

    def scatter(self, flat: np.ndarray, query: np.ndarray, term: np.ndarray, weight: np.ndarray) -> None:
        """Add the postings of the queries' terms to their scores, a million at a time."""
        sizes = self.sizes[term]
        total = np.cumsum(sizes)
        parts = np.searchsorted(total, np.arange(1, -(-int(total[-1]) // HELD_SCORES)) * HELD_SCORES) if len(total) else ()
        for some in np.split(np.arange(len(term)), parts):
            if len(some):
                at = _ranges(self.ends[term[some]], sizes[some])
                cells = np.repeat(query[some] * self.documents, sizes[some]) + self.places[at]
                np.add.at(flat, cells, (np.repeat(weight[some], sizes[some]) * self.impacts[at]).astype(np.float32))

    def looked_up(self, found: np.ndarray, n: int, query: np.ndarray, term: np.ndarray, weight: np.ndarray, m: int) -> np.ndarray:
        """What common terms add to the scores that were found, up to single precision."""
        counts = np.bincount(query, minlength=m)
        begin, column, added = np.cumsum(counts) - counts, self.column[term], np.zeros(len(found))
        for some in _slices(counts[found // n]):
            own = found[some] // n
            entry = _ranges(begin[own], counts[own])
            pair = np.repeat(np.arange(len(own)), counts[own])
            values = weight[entry] * self.dense[column[entry], (found[some] % n)[pair]]
            added[some] = np.bincount(pair, values, minlength=len(own))
        return added

    def exact(self, found: np.ndarray, n: int, query: np.ndarray, term: np.ndarray, weight: np.ndarray, m: int) -> np.ndarray:
        """Whole scores in doubles."""
        counts = np.bincount(query, minlength=m)
        begin, scores = np.cumsum(counts) - counts, np.zeros(len(found))
        for some in _slices(counts[found // n]):
            own = found[some] // n
            entry = _ranges(begin[own], counts[own])
            pair = np.repeat(np.arange(len(own)), counts[own])
            key = term[entry].astype(np.int64) * n + (found[some] % n)[pair]
            at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
            values = np.where(self.key[at] == key, weight[entry] * self.impacts[at], 0.0)
            scores[some] = np.bincount(pair, values, minlength=len(own))
        return scores


def _slices(sizes: np.ndarray) -> Iterator[slice]:
    """Neighbours that have about a quarter of a million entries together."""
    total = np.cumsum(sizes)
    cuts = np.unique(np.searchsorted(total, np.arange(1, -(-int(total[-1]) // LOOKED_UP)) * LOOKED_UP)) if len(total) else np.empty(0, np.int64)
    edges = np.concatenate([[0], cuts, [len(sizes)]])
    yield from (slice(int(a), int(b)) for a, b in zip(edges[:-1], edges[1:], strict=True) if a < b)


def _joined(asked: DataFrame, table: DataFrame, spread: str) -> DataFrame:
    """Join on the term; a common word has many rows on either side."""
    if is_small(asked):
        return table.join(F.broadcast(asked), "term")
    if spread in table.columns:
        return salted_join(table, asked, "term", spread, hot_keys(table.groupBy("term").agg(F.count("*").alias("rows")), "term", "rows"))
    return salted_join(asked, table, "term", spread, hot_keys(asked.groupBy("term").agg(F.count("*").alias("rows")), "term", "rows"))


def _numbered(ids: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The different ids in ascending order, null first, and the place of each id among them."""
    coded = ids.dictionary_encode(null_encoding="encode")
    order = pc.array_sort_indices(coded.dictionary, null_placement="at_start")
    place = np.empty(len(order), np.int64)
    place[order.to_numpy()] = np.arange(len(order))
    return coded.dictionary.take(order), place[coded.indices.to_numpy()]
