"""Passages that stand word for word in texts: automata over bounded blocks of passages, run once per text."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qaloom.functions.text import words
from qaloom.operators.skew import fetch
from qaloom.session import broadcast_if_small, stage

# Passages of an automaton, and characters of all its passages; more passages are looked for in several blocks.
BLOCK_PASSAGES = 50_000
BLOCK_CHARACTERS = 1 << 24
# An automaton knows so many characters of a passage: its end, where passages that begin alike differ.
PART = 48


class Automaton:
    """The parts of a block of passages with failure links, and the passages themselves to confirm a find."""

    def __init__(self, passages: list[str]):
        self.passages = passages
        by_part: dict[str, list[int]] = {}
        self.empty = [i for i, p in enumerate(passages) if not p]
        for i, passage in enumerate(passages):
            if passage:
                by_part.setdefault(passage[-PART:], []).append(i)
        self.links = ahocorasick.Automaton()
        for part, whose in by_part.items():
            self.links.add_word(part, whose)
        if by_part:
            self.links.make_automaton()

    def found(self, text: str) -> list[int]:
        """The passages that the text contains, each once; an empty passage is in every text."""
        hits = set(self.empty)
        if len(self.links):
            for end, whose in self.links.iter(text):
                for i in whose:
                    passage = self.passages[i]
                    if i not in hits and (len(passage) <= PART or text.endswith(passage, 0, end + 1)):
                        hits.add(i)
        return sorted(hits)


def containing_parts(passages: DataFrame, documents: DataFrame) -> DataFrame:
    """``query_id, doc_id``: documents whose text contains a passage (``query_id, passage``), by automata.

    The texts are read once for each block of passages and are not shuffled. Null passages and texts are in nothing.
    """
    asked = stage(passages.where("passage IS NOT NULL").select("query_id", "passage"), "passages")
    size = asked.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("passage")), F.lit(0)).alias("characters")).first()
    blocks = max(1, -(-size["n"] // BLOCK_PASSAGES), -(-size["characters"] // BLOCK_CHARACTERS))
    block = F.pmod(F.xxhash64("query_id", "passage"), F.lit(blocks))
    return reduce(DataFrame.unionByName, [_in_block(asked.where(block == b), documents) for b in range(blocks)])


def _in_block(asked: DataFrame, documents: DataFrame) -> DataFrame:
    wanted = asked.toArrow()
    texts = wanted["passage"].to_pylist()
    held = asked.sparkSession.sparkContext.broadcast((texts, wanted["query_id"].combine_chunks()))
    kinds = {"query_id": asked.schema["query_id"].dataType.simpleString(), "doc_id": documents.schema["doc_id"].dataType.simpleString()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passages, ids = held.value
        automaton = Automaton(passages)
        for batch in batches:
            found = [automaton.found(text) for text in batch.column(1).to_pylist()]
            which = pa.array([i for hits in found for i in hits], pa.int64())
            where = pa.array([d for d, hits in enumerate(found) for _ in hits], pa.int64())
            yield pa.RecordBatch.from_arrays([ids.take(which), batch.column(0).take(where)], names=["query_id", "doc_id"])

    texts = documents.select("doc_id", "text").where("text IS NOT NULL")
    return texts.mapInArrow(run, f"query_id {kinds['query_id']}, doc_id {kinds['doc_id']}")


def containing(passages: DataFrame, documents: DataFrame) -> DataFrame:
    """``query_id, doc_id``: documents whose text contains a passage (``query_id, passage``), for passages of any number.

    A containing document holds every inner word of the passage as a word of its own, so the passage's rarest inner
    word finds all candidates by an equi-join, and containment is then checked on the texts. Documents are cut into
    words once. A passage of fewer than three words has no inner word; automata look for such passages in every text.
    """
    split = passages.where("passage IS NOT NULL").withColumn("_words", words("passage"))
    long = split.where(F.size("_words") >= 3)
    inner = F.slice("_words", F.lit(2), F.size("_words") - 2)
    passage_words = long.select("query_id", F.explode(F.array_distinct(inner)).alias("word"))
    vocabulary = broadcast_if_small(stage(passage_words.select("word").distinct(), "vocabulary"))
    document_words = documents.select("doc_id", F.explode(F.array_distinct(words("text"))).alias("word"))
    known = stage(document_words.join(vocabulary, "word", "left_semi"), "known-words")
    frequency = known.groupBy("word").agg(F.count("*").alias("df"))
    anchors = (
        passage_words.join(frequency, "word", "left")
        .groupBy("query_id")
        .agg(F.min_by("word", F.struct(F.coalesce("df", F.lit(0)).alias("df"), F.col("word"))).alias("word"))
    )
    candidates = known.join(broadcast_if_small(stage(anchors, "anchors")), "word").select("query_id", "doc_id")
    found = fetch(candidates, documents, "doc_id", "query_id").join(long.select("query_id", "passage"), "query_id")
    found = found.where(F.contains("text", "passage")).select("query_id", "doc_id")
    short = stage(split.where(F.size("_words") < 3).select("query_id", "passage"), "short-passages")
    return found if short.isEmpty() else found.unionByName(containing_parts(short, documents))
