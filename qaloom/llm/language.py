"""Language identification by prediction by partial matching (PPM).

Every language has a tree of byte contexts of up to three bytes with the counts of the bytes that followed. A byte
is coded in the longest context that was seen; where it did not follow there, the coder pays the escape and goes on
in the next shorter context, in which the bytes of the longer one are excluded (method C). The counts are frozen
after training, so a byte's cost depends on its context alone and the code lengths of a text are exact sums. The
shortest code names the language.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qaloom.llm.common import sent

ORDER = 3
# A text starts in this context.
START = b"\n" * ORDER
# Code lengths are whole multiples of 1/UNIT bit, so that sums do not depend on their order.
UNIT = 1 << 16
# Bytes that are scored at once in a task.
SLICE = 1_000_000
# Bytes of text that a task copies, scores and hands back at once.
HELD = 1 << 21
# Bytes of training text per language. The sample is drawn by a hash of the text and holds whole texts, each once.
SAMPLE_BYTES = 2_000_000
# The sizes of texts are summed in so many steps for each power of two of the hash.
STEPS = 16
UNKNOWN = "und"


def _low(order: int) -> np.uint32:
    """Mask of the lowest ``order + 1`` bytes."""
    return np.uint32((1 << 8 * (order + 1)) - 1)


def _counted(values: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys, where = np.unique(values, return_inverse=True)
    return keys, np.bincount(where, weights, len(keys)).astype(np.int64)


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of ``wanted`` in the sorted ``keys`` and whether they are there."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


def _grams(stream: bytes) -> np.ndarray:
    """Every run of ``ORDER + 1`` bytes as one number."""
    values = np.frombuffer(stream, np.uint8).astype(np.uint32)
    n = len(values) - ORDER
    out = values[:n]
    for i in range(1, ORDER + 1):
        out = out << np.uint32(8) | values[i : n + i]
    return out


class ContextTree:
    """One language: per order the contexts with their totals, and the counts of context and byte."""

    def __init__(self, grams: np.ndarray, counts: np.ndarray):
        self.symbols, self.contexts = [], []
        for order in range(ORDER + 1):
            keys, n = _counted(grams & _low(order), counts)
            of = keys >> np.uint32(8)
            names, first = np.unique(of, return_index=True)
            distinct = np.diff(np.append(first, len(of)))
            total = np.add.reduceat(n, first) if len(first) else np.empty(0, np.int64)
            # What the bytes of this context count in the next shorter one.
            taken = np.zeros(len(names), np.int64)
            if order and len(first):
                shorter, below = self.symbols[order - 1]
                taken = np.add.reduceat(below[_find(shorter, keys & _low(order - 1))[0]], first)
            self.symbols.append((keys, n))
            self.contexts.append((names, total, distinct, taken))

    def bits(self, grams: np.ndarray) -> np.ndarray:
        """Code length in bits of the last byte of every gram after the bytes before it."""
        out = np.zeros(len(grams))
        left = np.arange(len(grams))
        gone_n, gone_d = np.zeros(len(grams), np.int64), np.zeros(len(grams), np.int64)
        for order in range(ORDER, -1, -1):
            key = grams[left] & _low(order)
            names, total, distinct, taken = self.contexts[order]
            at, seen = _find(names, key >> np.uint32(8))
            if not len(names):
                continue
            n = np.where(seen, total[at] - gone_n[left], 0)
            d = np.where(seen, distinct[at] - gone_d[left], 0)
            keys, counts = self.symbols[order]
            place, hit = _find(keys, key)
            cost = np.zeros(len(left))
            escape = seen & ~hit & (d > 0)
            cost[hit] = np.log2((n + d)[hit] / counts[place[hit]])
            cost[escape] = np.log2((n + d)[escape] / d[escape])
            out[left] += cost
            gone_n[left], gone_d[left] = np.where(seen, taken[at], 0), np.where(seen, distinct[at], 0)
            left = left[~hit]
        known = self.contexts[0][2]
        out[left] += np.log2(max(1, 256 - int(known[0]) if len(known) else 256))
        return out


class PpmModel:
    """The trees of all languages, with the costs of all grams of the training texts ready in one table."""

    def __init__(self, counts: pd.DataFrame):
        self.languages = sorted(counts["lang"].unique(), key=lambda x: x.encode())
        self.trees = []
        for language in self.languages:
            own = counts[counts["lang"] == language]
            self.trees.append(ContextTree(own["gram"].to_numpy(np.int64).astype(np.uint32), own["n"].to_numpy(np.int64)))
        seen = counts.groupby("gram")["n"].sum().sort_index()
        self.grams = seen.index.to_numpy(np.int64).astype(np.uint32)
        self.costs = self.cost(self.grams)
        # A slot names one gram of those that hash to it, the commonest; the others are searched.
        self.slots = np.zeros(1 << 20, np.int32)
        common = np.argsort(seen.to_numpy(), kind="stable")
        self.slots[self._slot(self.grams[common])] = common

    @staticmethod
    def _slot(grams: np.ndarray) -> np.ndarray:
        return grams * np.uint32(2654435761) >> np.uint32(12)

    def _places(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Columns of ``costs`` for the grams, and which grams have none."""
        at = self.slots[self._slot(grams)]
        other = np.flatnonzero(self.grams[at] != grams)
        place, known = _find(self.grams, grams[other])
        at[other] = place
        return at, other[~known]

    def cost(self, grams: np.ndarray) -> np.ndarray:
        """Row per language of whole code lengths."""
        return np.array([np.rint(tree.bits(grams) * UNIT).astype(np.int64) for tree in self.trees])

    def lengths(self, texts: list[bytes]) -> np.ndarray:
        """Row per text and column per language: code lengths of whole texts, in slices of bounded size."""
        out = np.zeros((len(texts), len(self.trees)), np.int64)
        pieces: list[tuple[int, bytes]] = []
        size = 0
        for row, text in enumerate(texts):
            for start in range(0, len(text), SLICE):
                before = START if start == 0 else text[start - ORDER : start]
                pieces.append((row, before + text[start : start + SLICE]))
                size += len(pieces[-1][1])
                if size >= SLICE:
                    self._add(pieces, out)
                    pieces, size = [], 0
        if pieces:
            self._add(pieces, out)
        return out

    def _add(self, pieces: list[tuple[int, bytes]], out: np.ndarray) -> None:
        grams = _grams(b"".join(p for _, p in pieces))
        n = len(grams)
        # Grams that reach over the border of two pieces belong to the lead-in of the second: they cost nothing.
        sizes = np.array([len(p) for _, p in pieces])
        begins = np.cumsum(sizes) - sizes
        at, missing = self._places(grams)
        strange, where = np.unique(grams[missing], return_inverse=True)
        at[missing] = len(self.grams) + where
        table = np.concatenate([self.costs, self.cost(strange)], axis=1)
        ends = np.minimum(begins + sizes - ORDER, n)
        cuts = np.column_stack([begins, ends]).ravel()
        rows = [row for row, _ in pieces]
        for language, costs in enumerate(table):
            paid = np.zeros(n + 1, np.int64)
            np.take(costs, at, out=paid[:n])
            sums = np.add.reduceat(paid, cuts)[::2]
            np.add.at(out[:, language], rows, sums)


def count_grams(sample: DataFrame, text: str, lang: str) -> DataFrame:
    """``lang, gram, n``: the four-byte grams of whole texts, counted in tasks before they are summed."""

    def counted(language: str, streams: list[np.ndarray]) -> pd.DataFrame:
        keys, counts = np.unique(np.concatenate(streams), return_counts=True)
        return pd.DataFrame({"lang": language, "gram": keys.astype(np.int64), "n": counts})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for language, texts in batch.groupby("lang")["text"]:
                streams: list[np.ndarray] = []
                for value in texts:
                    stream = START + value.encode("utf-8", "surrogatepass")
                    for start in range(0, len(stream) - ORDER, SLICE):
                        streams.append(_grams(stream[start : start + SLICE + ORDER]))
                        if sum(map(len, streams)) >= SLICE:
                            yield counted(language, streams)
                            streams = []
                if streams:
                    yield counted(language, streams)

    rows = sample.select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"))
    found = rows.mapInPandas(run, "lang string, gram long, n long")
    return found.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def training_sample(
    docs: DataFrame, usable: Column, text: str = "text", lang: str = "lang", sample_bytes: int = SAMPLE_BYTES
) -> DataFrame:
    """``lang, text``: different whole labelled texts of the smallest hashes, ``sample_bytes`` per language or a little more.

    All texts of a language that has less. Texts are measured and drawn without their copies, so no text is more than
    one, however often it is repeated. A text longer than the bound is drawn only where a language has no other. A
    language label that is null teaches nothing.
    """
    labelled = docs.where(usable & F.col(lang).isNotNull() & F.col(text).isNotNull())
    labelled = labelled.select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"))
    size = F.octet_length("text")
    labelled = labelled.select("*", F.shiftrightunsigned(F.xxhash64("text", F.lit(1)), 1).alias("draw"), (size > sample_bytes).alias("long"))
    texts = labelled.groupBy("lang", "draw", "long").agg(F.max(size).alias("size"))
    # Steps grow with the hash, so that one step adds a small part of what the smaller hashes hold, in any table.
    step = F.floor(F.log2(F.col("draw") + 1.0) * STEPS).alias("step")
    steps = texts.groupBy("lang", "long", step).agg(F.sum("size").alias("size"), F.max("draw").alias("last")).collect()
    held: dict[str, tuple[int, bool, int]] = {}
    for row in sorted(steps, key=lambda r: (r["long"], r["last"])):
        size, long, _ = held.get(row["lang"], (0, row["long"], 0))
        if size < sample_bytes and long == row["long"]:
            held[row["lang"]] = size + row["size"], long, row["last"]
    drawn = F.lit(False)
    for name, (_, long, last) in held.items():
        drawn = F.when(F.col("lang") == name, (F.col("long") == long) & (F.col("draw") <= last)).otherwise(drawn)
    return labelled.where(drawn).select("lang", "text").distinct()


def train(docs: DataFrame, usable: Column, text: str = "text", lang: str = "lang", sample_bytes: int = SAMPLE_BYTES) -> PpmModel:
    """Learn a context tree per language. The model is no larger than the sample, so the driver can hold it."""
    return PpmModel(count_grams(training_sample(docs, usable, text, lang, sample_bytes), "text", "lang").toPandas())


def identify(docs: DataFrame, model: PpmModel, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``, each row alone and over its whole text.

    ``score`` is the posterior of the best language under equal priors. A text that is null or has no letter, and
    every text if nothing was learned, is ``und`` with score 0. Equal lengths go to the smaller name by code point.
    Columns of ``docs`` with these names are replaced; nothing else is read.
    """
    docs = docs.drop("lang_pred", "score")
    schema = docs.select("*", F.lit("").alias("lang_pred"), F.lit(0.0).alias("score")).schema
    held = sent(docs.sparkSession, model)
    # The text itself is among the columns and goes to the tasks once.
    lettered, place = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)).alias("_lettered"), docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held()
        names = np.array([*model.languages, UNKNOWN], object)
        for whole in batches:
            for batch in parts(whole):
                texts = batch.column(place).cast(pa.binary())
                best, score = np.full(len(texts), len(names) - 1), np.zeros(len(texts))
                rows = np.flatnonzero(batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False) & bool(model.languages))
                if len(rows):
                    lengths = model.lengths(texts.take(pa.array(rows)).to_pylist())
                    best[rows] = lengths.argmin(axis=1)
                    extra = (lengths - lengths.min(axis=1, keepdims=True)) / UNIT
                    score[rows] = 1 / np.exp2(-np.minimum(extra, 1000)).sum(axis=1)
                own = [batch.column(i) for i in range(batch.num_columns - 1)]
                yield pa.RecordBatch.from_arrays([*own, pa.array(names[best], pa.string()), pa.array(score)], names=schema.names)

    def parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        """Neighbouring rows of about ``HELD`` bytes of text together; a longer text stands alone."""
        sizes = pc.fill_null(pc.binary_length(batch.column(place)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        number = (np.cumsum(sizes) - sizes) // HELD
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(number)) + 1, [len(number)]]).tolist()
        for begin, end in zip(cuts[:-1], cuts[1:], strict=True):
            yield batch.slice(begin, end - begin)

    return docs.select("*", lettered).mapInArrow(run, schema)
