"""Language-model scores by a probabilistic suffix tree over words.

The tokens of a text are its words, A-Z as a-z, and one end. The root of the tree holds the smoothed shares of all
training tokens. A run of up to ``depth`` words is a state if some token follows it with a probability that differs by
a factor of at least ``ratio`` from the one after the run without its first word (the divergence test); with a state all
its suffixes are states. Only runs that occur at least ``LEAST`` times are tested, in a corpus of any size. A state's distribution discounts the tokens that followed at least ``least`` times and gives
the rest to the distribution of its suffix. A token is scored in the state of the longest suffix of what precedes it.

Words are counted first, then pairs of frequent words by hash, so that windows end where a pair is rare. Longer runs take one shuffle for all lengths: each token is sent once, with those
that follow it in frequent pairs, packed by the hash of the first two words, so all runs that begin with them meet; two words that are
both very common are dealt by three. A task drops rare runs before it returns rows. The logarithm of a token's probability is that at the root, plus one summand for each suffix of its context
that is a state (the weight that it passes down), plus one for each run with the token that is held in a state (its gain over
the passed-down probability). So a text scores the sum of fixed values of its runs, and scoring is one join of runs
with values: the commonest go to all tasks, a filter of fixed size drops runs without a value, and for the rest many texts
ask together. Each run is asked for once, packed with others, and so are the values, which come back in the order of the asks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qaloom.llm.common import mix, sent, slices
from qaloom.llm.tokens import WHITE, tokens
from qaloom.session import free_shuffles, settle, stage, staged_so_far

# Words of the longest context, and the factor of the test.
DEPTH = 3
RATIO = 2.0
# Occurrences that a context, and a token after it, must have: the same number for every size of the corpus.
LEAST = 16
# What is taken from each count of a state for tokens that it does not hold.
DISCOUNT = 0.5
# The values of at most so many runs go to every task, and a filter of so many bits (a power of two) over the others.
HEAD = 1 << 19
FILTER_BITS = 27
# Runs that a task adds up before they leave it.
BUFFER = 1 << 22
# Tokens, or values of runs, that a task packs at once.
PACK = 1 << 20
# Pairs of tokens are counted in cells, at most so many tokens of the corpus for one.
CELL = 1 << 5
# Texts ask together, until they ask for so many runs or are so many.
ASKS, TEXTS = 1 << 21, 1 << 17
# Words with short codes in what is shuffled (16 bits, less the codes for none and for any other word).
CODES = (1 << 16) - 2
# Words that make up at least 1 / ``COMMON`` of all tokens are very common.
COMMON = 1 << 10
# Windows are dealt to so many buckets, or more, so that one stands for at most ``BUCKET`` tokens (both powers of two).
BUCKETS, BUCKET = 1 << 8, 1 << 21

END = np.uint64(0x2545F4914F6CDD1D)


@dataclass(frozen=True)
class SuffixTree:
    """``values``: ``key, n, known, base, score`` of every run that counts; the rest as plain figures.

    ``base`` and ``score`` are logarithms to base 10; those of a token are added to ``unknown``, which every token gets.
    """

    values: DataFrame
    depth: int
    train_tokens: int
    unknown: float


# --- runs of tokens inside tasks --------------------------------------------------------------------------------------


def _runs(texts: list[bytes], longest: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Keys of the runs of 1 to ``longest`` tokens that end at each token, its place in its text, and the text's number."""
    words, at = tokens(texts, WHITE)
    lengths = np.diff(at) + 1
    number = np.repeat(np.arange(len(texts)), lengths)
    first = np.cumsum(lengths) - lengths
    place = np.arange(len(number)) - first[number]
    single = np.empty(len(number), np.uint64)
    ends = place == lengths[number] - 1
    single[ends], single[~ends] = END, words
    keys = [single]
    for order in range(2, longest + 1):
        before = mix(keys[-1] + np.uint64(order))
        longer = single.copy()
        longer[1:] = mix(before[:-1] ^ single[1:])
        keys.append(longer)
    return keys, place, number


def _bits(keys: np.ndarray, bits: int) -> np.ndarray:
    return mix(keys) >> np.uint64(64 - bits)


def _passes(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = _bits(keys, len(bitmap).bit_length() + 5)
    return (bitmap[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) != 0


def _signed(keys: np.ndarray) -> pa.Array:
    return pa.array(keys.view(np.int64))


class _Sums:
    """Adds up counts by key, with further columns that the key determines."""

    def __init__(self, names: list[str]):
        self.names, self.parts, self.held = names, [], 0

    def add(self, keys: np.ndarray, counts: np.ndarray, *more: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.parts.append((keys, counts, *more))
        self.held += len(keys)
        if self.held >= BUFFER:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.held:
            keys, counts, *more = (np.concatenate(x) for x in zip(*self.parts, strict=True))
            order = np.argsort(keys, kind="stable")
            keys = keys[order]
            first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            columns = [_signed(keys[first]), pa.array(np.add.reduceat(counts[order], first))]
            columns += [_signed(x[order[first]]) for x in more]
            yield pa.RecordBatch.from_arrays(columns, names=self.names)
        self.parts, self.held = [], 0


def _texts(column: pa.Array) -> Iterator[list[bytes]]:
    return slices(column.cast(pa.binary()).to_pylist())


def _word_counts(docs: DataFrame) -> DataFrame:
    """``key, n`` of all tokens."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = _Sums(["key", "n"])
        for batch in batches:
            for part in _texts(batch.column(0)):
                (single,), _, _ = _runs(part, 1)
                yield from sums.add(single, np.ones(len(single), np.int64))
        yield from sums.flush()

    return docs.select("text").mapInArrow(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def _extended(keys: np.ndarray, order: int, words: np.ndarray) -> np.ndarray:
    """Keys of runs of ``order`` tokens, from those of the runs without the last token."""
    return mix(mix(keys + np.uint64(order)) ^ words)


class _Windows:
    """Tokens of texts, 0 for a rare one and after each text; they leave as the different windows of up to ``longest``.

    A window is a token with those that follow it, as long as two neighbours pass the filter of pairs. A pair of very common words is sent on its own, to
    be counted, and its windows go where their first three tokens meet.
    """

    NAMES = ("bucket", "rows", "size", "data")

    def __init__(self, longest: int, bits: int, coded: np.ndarray, common: np.ndarray, pairs: np.ndarray):
        self.longest, self.bits, self.common, self.pairs = longest, np.uint64(bits), common, pairs
        order = np.argsort(coded)
        self.coded, self.code = coded[order], (order + 1).astype("<u2")
        self.parts, self.held = [], 0

    def add(self, words: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.parts.append(words)
        self.held += len(words)
        if self.held >= PACK:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        words = np.concatenate([*self.parts, np.zeros(self.longest, np.uint64)])
        self.parts, self.held = [], 0
        at = np.flatnonzero((words[:-1] != 0) & (words[1:] != 0))
        at = at[_passes(self.pairs, _extended(words[at], 2, words[at + 1]))]
        if not len(at):
            return
        linked = np.zeros(len(words), bool)
        linked[at] = True
        length, key = np.ones(len(at), np.uint8), words[at]
        route, common = None, _member(self.common, words[at]) & _member(self.common, words[at + 1])
        for order in range(2, self.longest + 1):
            more = np.flatnonzero((length == order - 1) & linked[at + (order - 2)])
            key[more], length[more] = _extended(key[more], order, words[at[more] + (order - 1)]), order
            if order == 2:
                pairs = key[common]
                route = mix(key)
            if order == 3:
                route[common] = mix(key[common])
        apart = np.flatnonzero(~common | (length > 2))
        at = np.concatenate([at[apart], at[common]])
        length = np.concatenate([length[apart], np.full(len(pairs), 2, np.uint8)])
        key, route = np.concatenate([key[apart], pairs]), np.concatenate([route[apart], mix(pairs)])
        live = np.flatnonzero(words)
        place = np.searchsorted(self.coded, words[live])
        place[place == len(self.coded)] = 0
        code = np.zeros(len(words), "<u2")
        code[live] = CODES + 1
        hit = np.flatnonzero(_member(self.coded, words[live], place))
        code[live[hit]] = self.code[place[hit]]
        # By bucket, the first two tokens and the window, which packs best; equal ones that another parts count apart.
        bucket, left = route >> (np.uint64(64) - self.bits), np.uint64(64) - self.bits
        route = (bucket << left) | (code[at].astype(np.uint64) << (left - np.uint64(16))) | (code[at + 1].astype(np.uint64) << (left - np.uint64(32)))
        order = np.argsort(route | (mix(key) >> (np.uint64(32) + self.bits)))
        key = key[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        counts = np.diff(np.append(first, len(key))).astype("<u4")
        first = order[first]
        at, length, bucket = at[first], length[first], bucket[first].astype(np.int64)
        del key, route, order, first
        codes = np.zeros((self.longest, len(at)), "<u2")
        for column in range(self.longest):
            live = np.flatnonzero(length > column)
            codes[column, live] = code[at[live] + column]
        starts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
        rows, sizes, packed = [], [], []
        for begin, end in zip(starts.tolist(), [*starts[1:].tolist(), len(at)], strict=True):
            own = codes[:, begin:end]
            column, row = np.nonzero(own == CODES + 1)
            data = _planes(own).tobytes() + _planes(counts[begin:end]).tobytes() + words[at[begin + row] + column].astype("<u8").tobytes()
            rows.append(end - begin)
            sizes.append(len(data))
            packed.append(pa.compress(data, codec="zstd", asbytes=True))
        columns = [pa.array(bucket[starts]), pa.array(rows, pa.int64()), pa.array(sizes, pa.int64()), pa.array(packed, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, names=list(self.NAMES))

    @staticmethod
    def unpacked(rows: int, size: int, data: bytes, longest: int, coded: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The tokens of the windows, a row for each place, and how often each window occurs."""
        data = pa.decompress(data, decompressed_size=size, codec="zstd", asbytes=True)
        codes = _unplaned(np.frombuffer(data, np.uint8, 2 * longest * rows).reshape(longest, 2, rows), "<u2")
        counts = _unplaned(np.frombuffer(data, np.uint8, 4 * rows, codes.nbytes).reshape(4, rows), "<u4")
        words = np.concatenate([[np.uint64(0)], coded, np.zeros(CODES + 1 - len(coded), np.uint64)])[codes]
        words[codes == CODES + 1] = np.frombuffer(data, "<u8", -1, codes.nbytes + counts.nbytes)
        return words, counts


def _planes(values: np.ndarray) -> np.ndarray:
    """The first bytes of the values of each row together, then the second ones, and so on."""
    return np.ascontiguousarray(np.moveaxis(np.ascontiguousarray(values)[..., None].view(np.uint8), -1, -2))


def _unplaned(planes: np.ndarray, kind: str | type) -> np.ndarray:
    return np.ascontiguousarray(np.moveaxis(planes, -2, -1)).view(kind)[..., 0]


def _bucket_bits(total: int) -> int:
    return (max(BUCKETS, -(-total // BUCKET)) - 1).bit_length()


def _packed(*columns: np.ndarray) -> bytes:
    return pa.compress(b"".join(_planes(x).tobytes() for x in columns), codec="zstd", asbytes=True)


def _unpacked(rows: int | list[int], data: bytes, *kinds: str | type) -> list[np.ndarray]:
    """Columns of the given types; all have ``rows`` values, or each its own number."""
    rows = rows if isinstance(rows, list) else [rows] * len(kinds)
    widths = [np.dtype(kind).itemsize for kind in kinds]
    ends = np.cumsum([n * width for n, width in zip(rows, widths, strict=True)]).tolist()
    data = np.frombuffer(pa.decompress(data, decompressed_size=ends[-1], codec="zstd", asbytes=True), np.uint8)
    starts = [0, *ends[:-1]]
    return [
        _unplaned(data[begin:end].reshape(width, n), kind) for begin, end, width, n, kind in zip(starts, ends, widths, rows, kinds, strict=True)
    ]


def _member(table: np.ndarray, values: np.ndarray, place: np.ndarray | None = None) -> np.ndarray:
    """Whether the values are in an ascending table."""
    if not len(table):
        return np.zeros(len(values), bool)
    place = np.minimum(np.searchsorted(table, values), len(table) - 1) if place is None else place
    return table[place] == values


def _commonest_first(words: DataFrame) -> np.ndarray:
    found = words.select("key", "n").toArrow()
    return found["key"].to_numpy().view(np.uint64)[np.argsort(-found["n"].to_numpy(), kind="stable")]


def _frequent_runs(docs: DataFrame, words: DataFrame, total: int, longest: int, least: int) -> DataFrame:
    """``length, key, n, ctx, low`` of all runs of 2 to ``longest`` tokens that occur at least ``least`` times.

    ``ctx`` is the run without its last token, ``low`` the one without its first. ``words`` are the frequent tokens.
    """
    spark = docs.sparkSession
    known_ = _bitmap(words)
    pairs_ = _frequent_pairs(docs, known_, total, least)
    coded_ = sent(spark, _commonest_first(words.where(F.col("n") >= _least_of_head(words, CODES))))
    common_ = sent(spark, np.sort(_commonest_first(words.where(F.col("n") * COMMON >= total))))
    bits = _bucket_bits(total)

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, known = _Windows(longest, bits, coded_(), common_(), pairs_()), known_()
        for batch in batches:
            for part in _texts(batch.column(0)):
                yield from held.add(_known_words(part, known))
        yield from held.flush()

    def count(table: pa.Table) -> pa.Table:
        coded, common = coded_(), common_()
        parts = zip(*(table[name].to_pylist() for name in _Windows.NAMES[1:]), strict=True)
        tokens_, counts = zip(*(_Windows.unpacked(*part, longest, coded) for part in parts), strict=True)
        tokens_, counts = np.concatenate(tokens_, axis=1), np.concatenate(counts).astype(np.int64)
        length = (tokens_ != 0).sum(axis=0)
        counted = (length == 2) | ~(_member(common, tokens_[0]) & _member(common, tokens_[1]))
        key, out = tokens_[0], []
        for order in range(2, longest + 1):
            ctx, key = key, _extended(key, order, tokens_[order - 1])
            found = np.flatnonzero(counted if order == 2 else length >= order)
            found = found[np.argsort(key[found])]
            own = key[found]
            first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])[: len(own)])
            n = np.add.reduceat(counts[found], first) if len(first) else counts[:0]
            found, n = found[first[n >= least]], n[n >= least]
            low = tokens_[1, found]
            for shorter in range(2, order):
                low = _extended(low, shorter, tokens_[shorter, found])
            out.append([pa.array(np.full(len(n), order)), _signed(key[found]), pa.array(n), _signed(ctx[found]), _signed(low)])
        names = ["length", "key", "n", "ctx", "low"]
        return pa.concat_tables([pa.table(columns, names=names) for columns in out])

    packed = docs.select("text").mapInArrow(windows, "bucket long, rows long, size long, data binary")
    return packed.groupBy("bucket").applyInArrow(count, "length long, key long, n long, ctx long, low long")


def _bitmap(keys: DataFrame) -> Callable[[], np.ndarray]:
    """A filter of ``FILTER_BITS`` bits over the keys, on its way to the tasks: never more than 2^21 words."""

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.unique(_bits(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64), FILTER_BITS))
            if len(at):
                yield _set_bits(at)

    words = keys.select("key").mapInArrow(bits, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits"))
    return _sent_bits(words, FILTER_BITS)


def _set_bits(at: np.ndarray) -> pa.RecordBatch:
    """``word, bits`` of a bitmap with the bits at these ascending places."""
    word, first = np.unique(at >> np.uint64(6), return_index=True)
    set_ = np.bitwise_or.reduceat(np.uint64(1) << (at & np.uint64(63)), first) if len(word) else at
    return pa.RecordBatch.from_arrays([_signed(word), _signed(set_)], names=["word", "bits"])


def _sent_bits(words: DataFrame, bits: int) -> Callable[[], np.ndarray]:
    found = words.toArrow()
    bitmap = np.zeros(1 << (bits - 6), np.uint64)
    bitmap[found["word"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
    return sent(words.sparkSession, bitmap)


def _frequent_pairs(docs: DataFrame, known_: Callable[[], np.ndarray], total: int, least: int) -> Callable[[], np.ndarray]:
    """A filter that every pair of known tokens with ``least`` occurrences passes, and few others.

    A pair counts in the cell of its hash, so a cell has at least the count of each of its pairs. Cells are as many as the bits of a
    filter, or more, so that there are at most ``CELL`` tokens for one. Ranges of cells leave a task together, packed.
    """
    bits = max(FILTER_BITS, (-(-total // CELL) - 1).bit_length())
    ranges = min(8, bits - 6)

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, parts, held = known_(), [], 0
        for batch in batches:
            for part in _texts(batch.column(0)):
                words = _known_words(part, known)
                at = np.flatnonzero((words[:-1] != 0) & (words[1:] != 0))
                parts.append(_bits(_extended(words[at], 2, words[at + 1]), bits).astype("<u4"))
                held += len(at)
                if held >= ASKS:
                    yield from counted(parts)
                    parts, held = [], 0
        if held:
            yield from counted(parts)

    def counted(parts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        cell = np.sort(np.concatenate(parts))
        first = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
        n = np.diff(np.append(first, len(cell))).astype("<u4")
        cell = cell[first]
        bucket = (cell >> np.uint32(bits - ranges)).astype(np.int64)
        starts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
        ends = np.append(starts, len(cell))[1:]
        packed = [
            _packed(np.diff(cell[begin:end], prepend=np.uint32(0)), n[begin:end]) for begin, end in zip(starts.tolist(), ends.tolist(), strict=True)
        ]
        columns = [pa.array(bucket[starts]), pa.array(ends - starts), pa.array(packed, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, names=["bucket", "rows", "cells"])

    def frequent(table: pa.Table) -> pa.Table:
        start = table["bucket"][0].as_py() << (bits - ranges)
        counts = np.zeros(1 << (bits - ranges), np.int64)
        for rows, data in zip(table["rows"].to_pylist(), table["cells"].to_pylist(), strict=True):
            steps, n = _unpacked(rows, data, "<u4", "<u4")
            counts[np.cumsum(steps, dtype=np.int64) - start] += n
        return pa.Table.from_batches([_set_bits((np.flatnonzero(counts >= least) + start).astype(np.uint64))])

    packed = docs.select("text").mapInArrow(cells, "bucket long, rows long, cells binary")
    return _sent_bits(packed.groupBy("bucket").applyInArrow(frequent, "word long, bits long"), bits)


def _known_words(texts: list[bytes], known: np.ndarray) -> np.ndarray:
    """The tokens of the texts, 0 for one that does not pass, before each text and at the end."""
    (single,), place, _ = _runs(texts, 1)
    single[~_passes(known, single)] = 0
    return np.append(np.insert(single, np.flatnonzero(place == 0), np.uint64(0)), np.uint64(0))


# --- the tree ---------------------------------------------------------------------------------------------------------


def train(
    docs: DataFrame, text: str = "text", depth: int = DEPTH, least: int = LEAST, ratio: float = RATIO, root_share: float = 0.0
) -> SuffixTree:
    """The tree of all rows of ``docs``. A null text is an empty one, which is an end alone; without rows all is unknown.

    Repeated rows count each time. Only ``text`` is read. A caller may ask for more occurrences than ``least`` by a share of the
    root of all tokens.
    """
    since = staged_so_far(docs.sparkSession)
    docs = docs.select(F.coalesce(F.col(text), F.lit("")).alias("text"))
    words = stage(_word_counts(docs), "words")
    seen = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    size = seen["n"] + 0.5 * (seen["v"] + 1)
    least = max(least, int(root_share * seen["n"] ** 0.5))
    levels = {1: words.where(F.col("n") >= least).withColumn("n_ctx", F.lit(seen["n"]))}
    found = stage(_frequent_runs(docs, levels[1], seen["n"], depth + 1, least), "runs")
    free_shuffles(docs.sparkSession)
    for order in range(2, depth + 2):
        runs = found.where(F.col("length") == order)
        levels[order] = stage(_with_shorter(runs, levels[order - 1]), f"runs-{order}")
    contexts, gains = _states(levels, depth, ratio, size)
    # A run is a context for the token after it and, with its last token, an entry of a shorter one.
    valued = stage(contexts.union(gains).groupBy("key").agg(F.sum("value").alias("value")), "values")
    unknown = float(np.log10(0.5 / size))
    # Only a frequent word has a value of its own, so the others are not joined.
    rare = words.where(F.col("n") < least).withColumn("value", F.lit(None).cast("double"))
    singles = levels[1].select("key", "n").join(valued, "key", "left").union(rare).withColumn("base", F.log10((F.col("n") + 0.5) / F.lit(size)) - F.lit(unknown))
    singles = singles.select("key", "n", F.lit(1).alias("known"), "base", (F.col("base") + F.coalesce("value", F.lit(0.0))).alias("score"))
    longer = levels[2].select("key", "n")
    for order in range(3, depth + 2):
        longer = longer.union(levels[order].select("key", "n"))
    longer = longer.join(valued, "key").select("key", "n", F.lit(0).alias("known"), F.lit(0.0).alias("base"), F.col("value").alias("score"))
    return SuffixTree(settle(singles.union(longer), "tree", since), depth, seen["n"], unknown)


def _with_shorter(runs: DataFrame, shorter: DataFrame) -> DataFrame:
    """Adds ``n_ctx``, the occurrences of the context, and ``low_n, low_ctx``, those of the run without its first token."""
    ctx = shorter.select(F.col("key").alias("ctx"), F.col("n").alias("n_ctx"))
    low = shorter.select(F.col("key").alias("low"), F.col("n").alias("low_n"), F.col("n_ctx").alias("low_ctx"))
    return runs.join(ctx, "ctx").join(low, "low").select("key", "ctx", "low", "n", "n_ctx", "low_n", "low_ctx")


def _states(levels: dict[int, DataFrame], depth: int, ratio: float, size: float) -> tuple[DataFrame, DataFrame]:
    """``key, value`` of all states (what they pass down) and of all tokens held in states (their gains)."""
    states: dict[int, DataFrame] = {}
    for length in range(depth, 0, -1):
        entries = levels[length + 1]
        quotient = (F.col("n") / F.col("n_ctx")) / (F.col("low_n") / F.col("low_ctx"))
        found = entries.where((quotient >= ratio) | (quotient <= 1 / ratio)).select(F.col("ctx").alias("key"))
        if length < depth:
            longer = levels[length + 1].join(states[length + 1], "key", "left_semi")
            found = found.union(longer.select(F.col("low").alias("key")))
        states[length] = stage(found.distinct(), f"states-{length}")
    contexts, gains = [], []
    for length in range(1, depth + 1):
        held = levels[length + 1].join(states[length].withColumnRenamed("key", "ctx"), "ctx", "left_semi")
        own = (F.col("n") - F.lit(DISCOUNT)) / F.col("n_ctx")
        below = (F.col("low_n") + 0.5) / F.lit(size) if length == 1 else (F.col("low_n") - F.lit(DISCOUNT)) / F.col("low_ctx")
        held = held.select("key", "ctx", own.alias("own"), below.alias("below"))
        rest = (1 - F.sum("own")) / F.greatest(1 - F.sum("below"), F.lit(1e-12))
        passed = stage(held.groupBy("ctx").agg(F.log10(rest).alias("passed")), f"passed-{length}")
        contexts.append(passed.select(F.col("ctx").alias("key"), F.col("passed").alias("value")))
        gain = F.log10("own") - F.log10("below") - F.col("passed")
        gains.append(held.join(passed, "ctx").select("key", gain.alias("value")))
    out = []
    for tables in (contexts, gains):
        united = tables[0]
        for table in tables[1:]:
            united = united.union(table)
        out.append(united)
    return out[0], out[1]


# --- scores -----------------------------------------------------------------------------------------------------------


def _least_of_head(values: DataFrame, most: int) -> int:
    """The smallest number of occurrences that no more than ``most`` runs reach."""
    step = F.floor(F.log2("n") * 8)
    steps = values.groupBy(step.alias("step")).agg(F.count("*").alias("rows"), F.min("n").alias("n")).orderBy(F.desc("step")).collect()
    reached, least = 0, 1 << 62
    for row in steps:
        reached += row["rows"]
        if reached > most:
            break
        least = row["n"]
    return least


class _Asks:
    """Runs that the texts of a part ask for: they leave as one row, each run once in the order of the keys, packed.

    ``runs`` holds the keys, ``askers`` how many texts ask for each run, which ones and how often, ``texts`` what is known of the texts.
    """

    SCHEMA = "part long, n_tokens long, n_runs long, n_askers long, runs binary, askers binary, texts binary"

    def __init__(self):
        self.texts, self.parts, self.n, self.held = [], [], 0, 0

    def add(self, texts: pa.RecordBatch, keys: np.ndarray, who: np.ndarray) -> Iterator[pa.RecordBatch]:
        """``who`` counts the rows of ``texts``; a run that a text holds more than once is there as often."""
        order = np.lexsort((who, keys))
        keys, who = keys[order], who[order]
        first = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]) | (who[1:] != who[:-1])])[: len(keys)])
        times = np.diff(np.append(first, len(keys))).astype("<u4")
        self.texts.append(texts)
        self.parts.append((keys[first], (who[first] + self.n).astype("<u4"), times))
        self.n, self.held = self.n + texts.num_rows, self.held + len(first)
        if self.held >= ASKS or self.n >= TEXTS:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.n:
            return
        texts = pa.Table.from_batches(self.texts)
        keys, who, times = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        self.texts, self.parts, self.n, self.held = [], [], 0, 0
        order = np.argsort(keys, kind="stable")
        keys, who, times = keys[order], who[order], times[order]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])[: len(keys)])
        asking = np.diff(np.append(first, len(keys))).astype("<u4")
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, texts.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            out.write_table(texts.combine_chunks())
        row = {"part": texts["row"][0].as_py(), "n_tokens": pa.compute.sum(texts["n_tokens"]).as_py(), "n_runs": len(first), "n_askers": len(keys)}
        row |= {"runs": _packed(_steps(keys[first])), "askers": _packed(asking, who, times), "texts": sink.getvalue().to_pybytes()}
        yield pa.RecordBatch.from_pylist([row])


def _steps(keys: np.ndarray) -> np.ndarray:
    """Ascending keys as the first one and what each is larger by than the one before."""
    return np.diff(keys, prepend=np.uint64(0))


def _by_bucket(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The buckets of ascending keys, where each begins, and where it ends."""
    bucket = (keys >> np.uint64(64 - bits)).astype(np.int64)
    starts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])[: len(keys)])
    return bucket[starts], starts, np.append(starts, len(keys))[1:]


def _answered(parts: DataFrame, values: DataFrame, kind: str) -> DataFrame:
    """The texts of the parts, with the values of all runs that they ask for added to their sums.

    Each run of a part goes once to the bucket of its key, and its values come back in the same order; which texts ask for it is
    not sent to the buckets.
    """
    bits = _bucket_bits(parts.agg(F.coalesce(F.sum("n_tokens"), F.lit(0))).first()[0])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, rows, data in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                keys = np.cumsum(*_unpacked(rows, data, np.uint64), dtype=np.uint64)
                bucket, starts, ends = _by_bucket(keys, bits)
                data = [_packed(_steps(keys[begin:end])) for begin, end in zip(starts.tolist(), ends.tolist(), strict=True)]
                columns = [pa.array(bucket), pa.array(np.full(len(starts), part)), pa.array(starts), pa.array(ends - starts), pa.array(data, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["bucket", "part", "start", "rows", "data"])

    def give(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for batch in batches:
            rows.append(batch)
            held += batch.num_rows
            if held >= PACK:
                yield given(rows)
                rows, held = [], 0
        if held:
            yield given(rows)

    def given(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        keys, n, gain = (x.to_numpy() for x in pa.Table.from_batches(rows).columns)
        order = np.argsort(keys.view(np.uint64))
        keys, n, gain = keys.view(np.uint64)[order], n[order], gain[order]
        bucket, starts, ends = _by_bucket(keys, bits)
        held = [
            _packed(_steps(keys[begin:end]), n[begin:end], gain[begin:end]) for begin, end in zip(starts.tolist(), ends.tolist(), strict=True)
        ]
        return pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(ends - starts), pa.array(held, pa.binary())], names=["bucket", "rows", "held"])

    def answer(asks: pa.Table, values: pa.Table) -> pa.Table:
        out = []
        if len(values) and len(asks):
            held = [_unpacked(rows, x, np.uint64, np.int64, np.float64) for rows, x in zip(values["rows"].to_pylist(), values["held"].to_pylist(), strict=True)]
            known_keys = np.concatenate([np.cumsum(x[0], dtype=np.uint64) for x in held])
            order = np.argsort(known_keys)
            known_keys, held = known_keys[order], [np.concatenate(x)[order] for x in list(zip(*held, strict=True))[1:]]
            for part, start, rows, data in zip(*(asks[name].to_pylist() for name in ("part", "start", "rows", "data")), strict=True):
                keys = np.cumsum(*_unpacked(rows, data, np.uint64), dtype=np.uint64)
                at = np.searchsorted(known_keys, keys)
                at[at == len(known_keys)] = 0
                hit = _member(known_keys, keys, at)
                if hit.any():
                    out.append((part, start, rows, _packed(*(np.where(hit, x[at], np.zeros(1, x.dtype)) for x in held))))
        columns = list(zip(*out, strict=True)) or [(), (), (), ()]
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
        return pa.table([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], names=["part", "start", "rows", "data"])

    def add(parts: pa.Table, found: pa.Table) -> pa.Table:
        n_runs, n_askers, askers, texts = (parts[name][0].as_py() for name in ("n_runs", "n_askers", "askers", "texts"))
        texts = pa.ipc.open_stream(texts).read_all()
        n, gain = np.zeros(n_runs, np.int64), np.zeros(n_runs)
        for start, rows, data in zip(*(found[name].to_pylist() for name in ("start", "rows", "data")), strict=True):
            n[start : start + rows], gain[start : start + rows] = _unpacked(rows, data, np.int64, np.float64)
        asking, who, times = _unpacked([n_runs, n_askers, n_askers], askers, "<u4", "<u4", "<u4")
        base = np.log10(2 * n + 1)
        sums = [np.bincount(who, np.repeat(x, asking) * times, len(texts)) for x in (n > 0, base, base + gain)]
        columns = [texts[name] for name in ("row", "doc_id", "n_tokens")] + [pa.array(texts["known"].to_numpy() + sums[0].astype(np.int64))]
        columns += [pa.array(texts[name].to_numpy() + x) for name, x in zip(("base", "score"), sums[1:], strict=True)]
        return pa.table(columns, names=["row", "doc_id", "n_tokens", "n_known", "base_score", "score"])

    asks = parts.select("part", "n_runs", "runs").mapInArrow(ask, "bucket long, part long, start long, rows long, data binary")
    # A word is worth (n + 0.5) / size against 0.5 / size at the root, which follows from n; most words have no more than that.
    values = values.select("key", F.when(F.col("known") == 1, F.col("n")).otherwise(0).alias("n"), (F.col("score") - F.col("base")).alias("gain")).mapInArrow(give, "bucket long, rows long, held binary")
    found = asks.groupBy("bucket").cogroup(values.groupBy("bucket")).applyInArrow(answer, "part long, start long, rows long, data binary")
    schema = f"row long, doc_id {kind}, n_tokens long, n_known long, base_score double, score double"
    parts = parts.select("part", "n_runs", "n_askers", "askers", "texts")
    return parts.groupBy("part").cogroup(found.groupBy("part")).applyInArrow(add, schema)


def score(docs: DataFrame, tree: SuffixTree, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``row, doc_id, n_tokens, n_known, base_score, score`` of every row: logarithms to base 10 of the text's probability.

    ``base_score`` is that at the root alone. A null text is empty and holds one token, the end. Rows may repeat, and share
    or lack ids; other columns are not read.
    """
    spark = docs.sparkSession
    free_shuffles(spark)
    least = _least_of_head(tree.values, HEAD)
    head = tree.values.where(F.col("n") >= least).toArrow()
    order = np.argsort(head["key"].to_numpy().view(np.uint64))
    common = {name: head[name].to_numpy()[order] for name in ("key", "known", "base", "score")}
    common["key"] = common["key"].view(np.uint64)
    tail = tree.values.where(F.col("n") < least)
    # With a run its shorter endings have values, so a run is looked at only if the one without its first word passes.
    common_, valued = sent(spark, common), _bitmap(tree.values.where("known = 0"))
    depth, unknown = tree.depth, tree.unknown

    def profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, bitmap, asks = common_(), valued(), _Asks()
        for batch in batches:
            done = 0
            for part in _texts(batch.column(2)):
                n = len(part)
                keys, place, number = _runs(part, depth + 1)
                sums = {"known": np.zeros(n), "base": np.zeros(n), "score": np.zeros(n)}
                asked, passed = [], np.arange(len(place))
                for length, runs in enumerate(keys):
                    if length:
                        passed = passed[place[passed] >= length]
                        passed = passed[_passes(bitmap, runs[passed])]
                    own, left = runs[passed], passed
                    if len(held["key"]):
                        at = np.minimum(np.searchsorted(held["key"], own), len(held["key"]) - 1)
                        hit = held["key"][at] == own
                        for name, total in sums.items():
                            if length == 0 or name == "score":
                                total += np.bincount(number[passed[hit]], held[name][at[hit]], n)
                        left, own = passed[~hit], own[~hit]
                    asked.append((own, number[left]))
                size = np.bincount(number, minlength=n)
                columns = [batch.column(0).slice(done, n), batch.column(1).slice(done, n), pa.array(size.astype(np.int64))]
                columns += [pa.array(sums["known"].astype(np.int64)), pa.array(sums["base"] + unknown * size)]
                columns += [pa.array(sums["score"] + unknown * size)]
                yield from asks.add(pa.RecordBatch.from_arrays(columns, names=names), *(np.concatenate(x) for x in zip(*asked, strict=True)))
                done += n
        yield from asks.flush()

    names = ["row", "doc_id", "n_tokens", "known", "base", "score"]
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return _answered(stage(rows.mapInArrow(profile, _Asks.SCHEMA), "profiles"), tail, kind)
