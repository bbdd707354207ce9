"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from qaloom.session import broadcast_if_small, stage

# ASCII white space: the same set that ``bytes.split()`` cuts at.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"

# Rows that are numbered together.
SLICE_ROWS = 10_000


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sent(spark: SparkSession, value: Any) -> Callable[[], Any]:
    """A broadcast of a value whose class travels with it: workers need no copy of this package."""
    held = spark.sparkContext.broadcast(cloudpickle.dumps(value))
    return lambda: pickle.loads(held.value)


def n_words(text: str | Column) -> Column:
    """Number of words of a text; 0 for null. Counts the places where a word ends."""
    text = F.col(text) if isinstance(text, str) else text
    blank = F.translate(text, "\t\n\x0b\x0c\r", "     ")
    squeezed = F.trim(F.regexp_replace(blank, " +", " "))
    spaces = F.length(squeezed) - F.length(F.translate(squeezed, " ", ""))
    return F.coalesce(F.when(squeezed == "", 0).otherwise(spaces + 1), F.lit(0)).cast("long")


def hidden(df: DataFrame) -> DataFrame:
    """``df`` with all columns under names that no operator uses: column ``c`` becomes ``_in_c``."""
    return df.select(*[F.col(f"`{c}`").alias(f"_in_{c}") for c in df.columns])


def shown(columns: list[str]) -> list[Column]:
    """The given columns of a table that was :func:`hidden`, under their own names."""
    return [F.col(f"`_in_{c}`").alias(c) for c in columns]


def numbered(rows: DataFrame, key: str, name: str) -> DataFrame:
    """``rows`` with ``name``: the numbers 0, 1, 2, … among the rows of equal ``key``, in no particular order.

    Keys are not null. The rows are staged once and counted in slices of at most ``SLICE_ROWS`` rows that lie
    together, so a key that holds most rows is many groups, and no window sees more of it than a slice.
    """
    placed = rows.withColumn("_at", F.monotonically_increasing_id())
    placed = stage(placed.withColumn("_slice", F.floor(F.col("_at") / SLICE_ROWS)), "equal")
    before = W.partitionBy(key).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    counts = placed.groupBy(key, "_slice").agg(F.count("*").alias("_n"))
    starts = stage(counts.select(key, "_slice", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start")), "starts")
    nth = F.row_number().over(W.partitionBy(key, "_slice").orderBy("_at")) - 1
    placed = placed.withColumn("_nth", nth).join(broadcast_if_small(starts), [key, "_slice"])
    return placed.withColumn(name, (F.col("_start") + F.col("_nth")).cast("long")).select(*rows.columns, name)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once: a function of an array computes again what it takes from outside."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def running(values: Column, combine: Callable[[Column, Column], Column]) -> Column:
    """``combine`` (with 0 as the neutral number) of the first 1, 2, 3, … numbers of an array, as bigints.

    Lists grow by copying, so the array is cut into about as many parts as a part has numbers, and what the parts come to
    is combined with what stands before them: a list of ``n`` numbers costs about ``n`` times its root.
    """
    zero, none = F.lit(0).cast("long"), F.expr("cast(array() as array<bigint>)")

    def simple(numbers: Column) -> Column:
        return F.aggregate(numbers, none, lambda out, x: F.concat(out, F.array(combine(F.coalesce(F.get(out, F.size(out) - 1), zero), x.cast("long")))))

    def cut(numbers: Column) -> Column:
        return let(
            F.greatest(F.lit(16), F.sqrt(F.size(numbers)).cast("int")),
            lambda width: F.transform(
                F.sequence(F.lit(0), F.floor((F.size(numbers) - 1) / width).cast("int")), lambda i: simple(F.slice(numbers, i * width + 1, width))
            ),
        )

    def joined(parts: Column) -> Column:
        # Nothing stands before the first part, and what the last one comes to is not needed.
        ends = F.transform(F.slice(parts, F.lit(1), F.size(parts) - 1), lambda p: F.get(p, F.size(p) - 1))
        before = simple(F.concat(F.array(zero), ends))
        return F.flatten(F.zip_with(parts, before, lambda part, start: F.transform(part, lambda x: combine(start, x))))

    return let(values, lambda numbers: F.when(F.size(numbers) > 0, let(cut(numbers), joined)).otherwise(none))


def running_sums(values: Column) -> Column:
    return running(values, lambda a, b: a + b)


# --- word shingles as 64-bit values (inside tasks) --------------------------------------------------------------------

_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer, element by element."""
    x = x + _MIX[0]
    x ^= x >> np.uint64(30)
    x *= _MIX[1]
    x ^= x >> np.uint64(27)
    x *= _MIX[2]
    x ^= x >> np.uint64(31)
    return x


_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[32, *range(9, 14)]] = True
_LOW_BYTES = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
# Bytes of text that are hashed at once; a longer text is a slice of its own.
SLICE = 500_000


def hashed_runs(data: bytes, separator: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the longest runs of bytes that separate nothing, and where they begin.

    ``data`` ends with nine bytes that are of no run. A run is read eight bytes at a time, and each step is a bijection
    of what came before, so runs of up to eight bytes and equal length never share a hash.
    """
    values = np.frombuffer(data, np.uint8)
    apart = separator[values]
    apart[-9:] = True
    edges = np.flatnonzero(apart[1:] != apart[:-1]) + 1
    if not apart[0]:
        edges = np.concatenate([[0], edges])
    starts, ends = edges[0::2], edges[1::2]
    eight = np.ndarray(len(values) - 7, "<u8", values, strides=(1,))
    at, left = starts, ends - starts
    hashes = mix(left.astype(np.uint64))
    live = np.arange(len(starts))
    while len(live):
        hashes[live] = mix(hashes[live] ^ (eight[at] & _LOW_BYTES[np.minimum(left, 8)]))
        more = left > 8
        live, at, left = live[more], at[more] + 8, left[more] - 8
    return hashes, starts


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of the texts, and where the words of each text begin, with the end."""
    hashes, starts = hashed_runs(b" ".join([*texts, bytes(9)]), _IS_SPACE)
    return hashes, np.searchsorted(starts, np.cumsum([0, *(len(t) + 1 for t in texts)]))


def shingle_sets(texts: list[bytes | None], size: int) -> list[np.ndarray]:
    """Per text the distinct shingles of ``size`` words, as ascending 64-bit hashes; A-Z count as a-z.

    A text with fewer words is one shingle; one that is null or has no word has none.
    """
    return [np.unique(found) for part in slices(texts) for found, _ in _slice_shingles(part, size, None)]


def weighed_shingle_sets(
    texts: list[bytes | None], size: int, weigh: Callable[[np.ndarray], np.ndarray]
) -> list[tuple[np.ndarray, np.ndarray]]:
    """Like ``shingle_sets``, with the sums of the weights of the shingles' words."""
    out = []
    for part in slices(texts):
        for found, weights in _slice_shingles(part, size, weigh):
            tokens, first = np.unique(found, return_index=True)
            out.append((tokens, weights[first]))
    return out


def slices(texts: list[bytes | None]) -> Iterator[list[bytes]]:
    """Neighbouring texts of about ``SLICE`` bytes together, null as empty; a longer text stands alone."""
    part: list[bytes] = []
    room = SLICE
    for text in texts:
        if part and len(text or b"") > room:
            yield part
            part, room = [], SLICE
        part.append(text or b"")
        room -= len(part[-1]) + 1
    if part:
        yield part


def _slice_shingles(
    texts: list[bytes], size: int, weigh: Callable[[np.ndarray], np.ndarray] | None
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All shingles of each text in their order, with their weights."""
    words, at = word_hashes([text.lower() for text in texts])
    weights = weigh(words) if weigh else np.zeros(len(words))

    def shingles(values: np.ndarray, own: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        n = len(values) - width + 1
        mixed, sums = np.full(n, width, np.uint64), np.zeros(n)
        for i in range(width):
            mixed = mix(mixed ^ values[i : n + i])
            sums += own[i : n + i]
        return mixed, sums

    every, sums = shingles(words, weights, size) if len(words) >= size else (words[:0], weights[:0])
    for begin, end in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if end - begin >= size:
            yield every[begin : end - size + 1], sums[begin : end - size + 1]
        elif end > begin:
            yield shingles(words[begin:end], weights[begin:end], end - begin)
        else:
            yield words[:0], weights[:0]
