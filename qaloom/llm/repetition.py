"""Quality rules on repetition within a text, by suffix arrays over its words.

The suffixes of the texts of a slice are sorted by prefix doubling, texts apart. The longest prefix that a suffix shares
with a neighbour in that order is the longest repeat that begins there: the value of the innermost interval of longest
common prefixes that holds it. The spans of these maximal repeats are united.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qaloom.llm.common import slices, word_hashes

# Words of a window whose second occurrence counts as repetition, and the limits of the base rules.
WINDOW = 8
LEAST_WORDS = 20
MOST_REPEATED = 30
# Repeats of fewer words are no matter; more than this share of the words in repeats, or a longer repeat, is too much.
LEAST_REPEAT = 6
MOST_COVERED = 0.3
LONGEST_REPEAT = 100

_SPACE = b"\x20\x09\x0a\x0b\x0c\x0d"
_SYMBOLS = b"#*$%&|<>"


def longest_repeats(words: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """For every word the length of the longest run of words from there on that its text holds twice.

    ``begins`` has the place of the first word of each text, and the end.
    """
    n = len(words)
    if not n:
        return np.zeros(0, np.int64)
    sizes = np.diff(begins)
    text = np.repeat(np.arange(len(sizes)), sizes)
    left = np.repeat(begins[1:], sizes) - np.arange(n)

    def ranked(order: np.ndarray, fresh: np.ndarray, base: np.ndarray) -> np.ndarray:
        """The place at which the group of each element of ``order`` begins: ``base`` plus its offset."""
        first = np.maximum.accumulate(np.where(fresh, np.arange(len(order)), 0))
        return base + first

    order = np.lexsort((words, text))
    fresh = np.concatenate([[True], (words[order][1:] != words[order][:-1]) | (text[order][1:] != text[order][:-1])])
    rank = np.empty(n, np.int32)
    rank[order] = ranked(order, fresh, np.zeros(n, np.int64))
    levels = []
    active = order[~(fresh & np.append(fresh[1:], True))]
    step = 1
    while len(active):
        levels.append((step, rank))
        after = np.where(left[active] > step, rank[np.minimum(active + step, n - 1)] + 1, 0)
        again = np.lexsort((after, rank[active]))
        active, after = active[again], after[again]
        old = rank[active]
        group = np.concatenate([[True], old[1:] != old[:-1]])
        fresh = group | np.concatenate([[True], after[1:] != after[:-1]])
        start = np.maximum.accumulate(np.where(group, np.arange(len(active)), 0))
        rank = rank.copy()
        rank[active] = ranked(active, fresh, old - start)
        active = active[~(fresh & np.append(fresh[1:], True))]
        step *= 2
    suffixes = np.empty(n, np.int64)
    suffixes[rank] = np.arange(n)
    one, two = suffixes[:-1].copy(), suffixes[1:].copy()
    shared = np.zeros(n - 1, np.int64)
    near = np.flatnonzero(text[one] == text[two])
    for step, rank in reversed(levels):
        a, b = one[near], two[near]
        inside = (a < n) & (b < n)
        inside[inside] &= text[a[inside]] == text[b[inside]]
        same = near[inside][rank[a[inside]] == rank[b[inside]]]
        one[same] += step
        two[same] += step
        shared[same] += step
    best = np.zeros(n, np.int64)
    np.maximum.at(best, suffixes[:-1], shared)
    np.maximum.at(best, suffixes[1:], shared)
    return best


def _covered(longest: np.ndarray, least: int, most: int | None = None) -> np.ndarray:
    """Which words lie in a repeat of at least ``least`` words (of its first ``most``)."""
    at = np.flatnonzero(longest >= least)
    change = np.zeros(len(longest) + 1, np.int64)
    np.add.at(change, at, 1)
    np.add.at(change, at + (longest[at] if most is None else most), -1)
    return np.cumsum(change[:-1]) > 0


def _spans(covered: np.ndarray) -> list[dict[str, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], covered.astype(np.int8), [0]])))
    return [{"start": int(a), "end": int(b)} for a, b in zip(edges[::2], edges[1::2], strict=True)]


_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "covered_words", "longest_repeat")


def _measure(texts: list[bytes]) -> Iterator[tuple]:
    words, begins = word_hashes(texts)
    longest = longest_repeats(words, begins)
    repeated, covered = _covered(longest, WINDOW, WINDOW), _covered(longest, LEAST_REPEAT)
    for text, begin, end in zip(texts, begins[:-1].tolist(), begins[1:].tolist(), strict=True):
        chars = len(text.translate(None, _SPACE).decode("utf-8", "surrogatepass"))
        lines = [line for line in text.split(b"\n") if line.strip()]
        own = covered[begin:end]
        yield (
            end - begin,
            chars,
            len(text) - len(text.translate(None, _SYMBOLS)),
            len(lines) - len(set(lines)),
            int(repeated[begin:end].sum()),
            int(own.sum()),
            int(longest[begin:end].max(initial=0)),
            _spans(own) if own.any() else [],
        )


def quality(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Counts and verdict of every document, each row alone and over its whole text.

    ``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept``, and
    ``covered_words, longest_repeat, repeat_spans`` of the repeats (ranges of words). ``kept`` is false if the base rules
    fail, if repeats cover more than ``MOST_COVERED`` of the words, or if one is longer than ``LONGEST_REPEAT`` words. A
    null or empty text has no words and fails. Other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            rows = [row for part in slices(texts) for row in _measure(part)]
            columns = [pa.array([row[i] for row in rows], pa.int64()) for i in range(len(_COUNTS))]
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            spans = pa.array([row[-1] for row in rows], kind)
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns, spans], names=["doc_id", *_COUNTS, "repeat_spans"])

    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = ", ".join([f"doc_id {kind}", *(f"{c} long" for c in _COUNTS), "repeat_spans array<struct<start:long,end:long>>"])
    found = docs.mapInArrow(run, schema)
    failed = (F.col("n_words") < LEAST_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MOST_REPEATED)
    fine = (F.col("covered_words") <= F.col("n_words") * MOST_COVERED) & (F.col("longest_repeat") <= LONGEST_REPEAT)
    found = found.withColumn("base_failed", failed)
    return found.withColumn("kept", ~F.col("base_failed") & fine)
