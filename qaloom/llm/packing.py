"""Variable-capacity best-fit packing of documents into training sequences of several permitted lengths."""

from __future__ import annotations

import re
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qaloom.llm.common import numbered
from qaloom.session import broadcast_if_small, stage

# Permitted sequence lengths in words, and what a sequence costs beside its length.
CAPACITIES = (512, 1024, 2048)
OVERHEAD = 32
# Bytes of text in a shard. A shard is packed by itself, so its size bounds the memory of a task.
SHARD_BYTES = 16_000_000
# Tasks that shards are dealt to; a task with several packs one after the other.
MOST_TASKS = 50_000
SEPARATOR = "\n\n"

_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def _reach(free: int, counts: dict[int, int], present: int) -> int:
    """Words of ``free`` that remaining sizes fill, each time the largest that fits.

    ``counts`` has the remaining sizes, and ``present`` a bit for each size that remains.
    """
    filled, most = 0, free
    while below := present & ((1 << most + 1) - 2):
        size = below.bit_length() - 1
        taken = min(counts[size], (free - filled) // size) * size
        filled += taken
        most = min(size - 1, free - filled)
    return filled


def best_fit(sizes: Sequence[int], capacities: Sequence[int], overhead: int = OVERHEAD) -> list[tuple[int, list[int]]]:
    """Bins as ``(capacity, positions in sizes)``. No size is above the largest capacity.

    Sizes are placed from large to small, each into the open bin that it fills best (the older one of equals). Where
    none has room, a bin of that permitted length is opened whose cost, length plus overhead, is least per word that
    this size and the remaining ones, the largest that fits first, fill it with; the smaller one of equals. At last
    every bin shrinks to the smallest permitted length that holds its contents.
    """
    capacities = sorted(capacities)
    counts = Counter(sizes)
    present = sum(1 << size for size in counts)
    room: list[tuple[int, int]] = []
    bins: list[list[int]] = []
    filled: list[int] = []
    for at in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        size = sizes[at]
        counts[size] -= 1
        if not counts[size]:
            present ^= 1 << size
        place = bisect_left(room, (size, -1))
        if place < len(room):
            free, chosen = room.pop(place)
        else:
            fills = {c: size + _reach(c - size, counts, present) for c in capacities if c >= size}
            free = min(fills, key=lambda c: ((c + overhead) / max(1, fills[c]), c))
            chosen = len(bins)
            bins.append([])
            filled.append(0)
        bins[chosen].append(at)
        filled[chosen] += size
        if free > size:
            insort(room, (free - size, chosen))
    return [(next(c for c in capacities if c >= used), own) for used, own in zip(filled, bins, strict=True)]


def pieces(docs: DataFrame, longest: int, doc_id: str = "doc_id", text: str = "text", copy: str | None = None) -> DataFrame:
    """``doc_id, first_word, n_words, copy, text``: documents, those of more than ``longest`` words cut into several.

    The pieces of a document hold all its words, and the white space between the words of a piece. A text without
    words has no piece. ``copy`` names a number that the pieces of a document keep, 0 if there is none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, first, count, copies, parts = [], [], [], [], []
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            for doc, value, nth in zip(batch.column(0).to_pylist(), texts, batch.column(2).to_pylist(), strict=True):
                n = len(value.split()) if value else 0
                if 0 < n <= longest:
                    ids.append(doc), first.append(0), count.append(n), copies.append(nth), parts.append(value)
                elif n:
                    spans = [m.span() for m in _WORD.finditer(value)]
                    for begin in range(0, n, longest):
                        end = min(n, begin + longest)
                        ids.append(doc), first.append(begin), count.append(end - begin), copies.append(nth)
                        parts.append(value[spans[begin][0] : spans[end - 1][1]])
            columns = [pa.array(values, pa.int64()) for values in (ids, first, count, copies)]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(parts, pa.binary()).cast(pa.string())], names=["doc_id", "first_word", "n_words", "copy", "text"]
            )

    number = (F.col(copy) if copy else F.lit(0)).cast("long")
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), number.alias("copy"))
    return rows.mapInArrow(run, "doc_id long, first_word long, n_words long, copy long, text string")


def pack(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    capacities: Sequence[int] = CAPACITIES,
    overhead: int = OVERHEAD,
    shard_bytes: int = SHARD_BYTES,
) -> DataFrame:
    """One row per sequence: ``bin_id, capacity, n_words, doc_ids, first_words, piece_words, text``.

    The three lists name the pieces of the sequence in their order; ``text`` joins them by an empty line. Every word of
    every document is in one sequence. Documents are dealt to shards by the hash of their rows, so the
    result does not depend on the order or the files of the input; rows of equal id and text are interchangeable, and
    are numbered so that their copies go to all shards. A null or empty text has nothing to pack. A row without id is packed with a null in ``doc_ids``. Other columns are not read.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).where(F.octet_length("text") > 0)
    rows = rows.withColumn("row", F.xxhash64("doc_id", "text"))
    distinct = rows.groupBy("row").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes"))
    size, most = distinct.agg(F.sum("bytes"), F.max("n")).first()
    shards = max(1, -(-(size or 0) // shard_bytes))
    lengths = sorted(capacities)
    copied = rows.withColumn("copy", F.lit(0).cast("long"))
    if (most or 0) > 1:
        repeated = broadcast_if_small(stage(distinct.where("n > 1").select("row"), "repeated"))
        equal = numbered(rows.join(repeated, "row", "left_semi"), "row", "copy")
        copied = copied.join(repeated, "row", "left_anti").unionByName(equal)

    def run(shard: pd.DataFrame) -> pd.DataFrame:
        shard = shard.sort_values(["key", "doc_id", "first_word"], kind="stable")
        count = shard["n_words"].to_numpy()
        ids = [None if pd.isna(x) else int(x) for x in shard["doc_id"]]
        first, texts = shard["first_word"].tolist(), shard["text"].tolist()
        number = int(shard["shard"].iloc[0])
        rows = []
        for at, (capacity, own) in enumerate(best_fit(count.tolist(), lengths, overhead)):
            rows.append(
                (
                    number << 32 | at, capacity, int(count[own].sum()), [ids[i] for i in own], [first[i] for i in own],
                    [int(count[i]) for i in own], SEPARATOR.join(texts[i] for i in own),
                )
            )
        return pd.DataFrame(rows, columns=["bin_id", "capacity", "n_words", "doc_ids", "first_words", "piece_words", "text"])

    key = F.xxhash64("doc_id", "first_word", "text")
    placed = pieces(copied, lengths[-1], copy="copy").withColumn("key", key)
    dealt = F.when(F.col("copy") > 0, F.xxhash64("key", "copy")).otherwise(F.xxhash64("key"))
    placed = placed.withColumn("shard", F.pmod(dealt, F.lit(shards))).repartition(min(shards, MOST_TASKS), "shard")
    schema = (
        "bin_id long, capacity long, n_words long, doc_ids array<long>, first_words array<long>, piece_words array<long>, text string"
    )
    return placed.groupBy("shard").applyInPandas(run, schema)
