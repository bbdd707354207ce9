"""Large single files read by many tasks, where records can span any number of byte ranges.

Spark's text source deals a file out in ranges and cuts each at a separator byte. Whether a separator ends a record depends on
everything before it in the file: on the quotes that are open and, in JSON, on the depth. So a file is read twice. First every
range is summed up for each state in which it might begin, a few figures per range, and these are composed along the file. Then
every range is cut into records from its true state. Records that end in the range in which they began are complete; the others
are put together from their fragments, at most two of which come from a range.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator, Sequence
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from qaloom.session import stage

Paths = str | Sequence[str]


class CsvCutter:
    """Records of quoted CSV: a line break outside quotes ends one. The state is whether a quote is open."""

    separator = "\n"
    start = False

    @staticmethod
    def summary(pieces: Iterator[str]) -> Any:
        return sum(piece.count('"') for piece in pieces) % 2 == 1

    @staticmethod
    def after(state: bool, summary: Any) -> bool:
        return state != summary

    @staticmethod
    def inside(state: bool) -> bool:
        return True

    @staticmethod
    def records(pieces: Iterator[str], state: bool) -> Iterator[tuple[list[str], int, bool]]:
        """``(parts, elements, ended)`` of each record; the last one may not have ended."""
        held: list[str] = []
        for piece in pieces:
            held += [piece, "\n"]
            state ^= piece.count('"') % 2 == 1
            if not state:
                yield held[:-1], 1, True
                held = []
        yield held, 0, False


class JsonCutter:
    """Elements of a container of a root object: the root itself, or the array that is one of its fields.

    The text is cut behind closing braces, and a record ends with an object that is an element; elements that are no
    objects come with the next one or with the end of the container. The state is ``(in a string, depth, last name or
    text at depth 1)``. The field's name must not hold a closing brace.
    """

    separator = "}"
    start = (False, 0, None)
    TOKEN = re.compile(r'\\.|["{}\[\],]', re.S)

    def __init__(self, field: str | None):
        self.field, self.level = field, 1 if field is None else 2

    def summary(self, pieces: Iterator[str]) -> Any:
        """Whether quotes are odd; for a start outside and inside a string: change of depth, least depth, last text there and above."""
        depth, least, last, above = [0, 0], [0, 0], [None, None], [None, None]
        odd = 0
        for piece in pieces:
            piece += "}"
            opened = None
            for token in self.TOKEN.finditer(piece):
                mark = token.group()
                if mark == '"':
                    # The range that began outside a string has one open after odd quotes, the other after even ones.
                    texts = {least[1 - odd]: last, least[1 - odd] + 1: above}.get(depth[1 - odd])
                    if texts is not None:
                        texts[1 - odd] = piece[opened : token.end()] if opened is not None else ""
                    opened = token.start()
                    odd = 1 - odd
                elif mark in "{[":
                    depth[odd] += 1
                elif mark in "}]":
                    depth[odd] -= 1
                    if depth[odd] < least[odd]:
                        least[odd], last[odd], above[odd] = depth[odd], None, last[odd]
        return odd, depth, least, last, above

    @staticmethod
    def after(state: tuple[bool, int, str | None], summary: Any) -> tuple[bool, int, str | None]:
        quoted, depth, name = state
        odd, change, least, last, above = summary
        case = int(quoted)
        # The range that opens or closes the root goes one deeper than its fields.
        found = {1: last[case], 0: above[case]}.get(depth + least[case])
        name = name if found is None else found
        return quoted != bool(odd), depth + change[case], name

    def inside(self, state: tuple[bool, int, str | None]) -> bool:
        return state[1] >= self.level and (self.field is None or self._named(state[2]))

    def _named(self, text: str | None) -> bool:
        try:
            return text is not None and json.loads(text) == self.field
        except ValueError:
            return False

    def records(self, pieces: Iterator[str], state: tuple[bool, int, str | None]) -> Iterator[tuple[list[str], int, bool]]:
        (quoted, depth, name), inside = state, self.inside(state)
        held: list[str] = []
        elements = 0
        for piece in pieces:
            piece += "}"
            begin, opened = 0, None
            for token in self.TOKEN.finditer(piece):
                mark = token.group()
                if mark == '"':
                    if quoted and depth == 1:
                        name = piece[opened : token.end()] if opened is not None else ""
                    quoted, opened = not quoted, token.start()
                elif quoted:
                    continue
                elif mark == ",":
                    elements += inside and depth == self.level
                elif mark in "{[":
                    depth += 1
                    if not inside and depth == self.level and (self.field is None or self._named(name)):
                        inside, held, elements, begin = True, [], 1, token.end()
                elif mark in "}]":
                    depth -= 1
                    if inside and depth == self.level and mark == "}":
                        yield [*held, piece[begin : token.end()]], elements, True
                        held, elements, begin = [], 0, token.end()
                    elif inside and depth < self.level:
                        yield [*held, piece[begin : token.start()]], elements, True
                        inside, held, elements = False, [], 0
            if inside:
                held.append(piece[begin:])
        yield held, elements, False


def read_records(spark: SparkSession, path: Paths, cutter: CsvCutter | JsonCutter) -> DataFrame:
    """``_file, _range, _part, _at, text``: all records, in the order of these columns.

    ``_range`` is where the range begins in which a record ends, ``_part`` is 0 for one that began in an earlier range, and ``_at``
    counts elements of the range before it.
    """
    pieces = spark.read.option("lineSep", cutter.separator).text(path)
    pieces = pieces.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("range"), F.col("value"))

    def sum_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (file, begin), texts in _by_range(batches):
            summary = json.dumps(cutter.summary(texts))
            yield pa.RecordBatch.from_pylist([{"file": file, "range": begin, "summary": summary}])

    # One row per range of the input.
    summaries = pieces.mapInArrow(sum_up, "file string, range long, summary string").collect()
    states: dict[tuple[str, int], Any] = {}
    state, last = None, None
    for row in sorted(summaries, key=lambda r: (r["file"], r["range"])):
        state, last = cutter.start if row["file"] != last else state, row["file"]
        states[row["file"], row["range"]] = state
        state = cutter.after(state, json.loads(row["summary"]))
    held = spark.sparkContext.broadcast(states)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (file, begin), texts in _by_range(batches):
            state = held.value[file, begin]
            # Whether the record being read began in an earlier range.
            torn, at, rows = begin > 0 and cutter.inside(state), 0, []
            for parts, elements, ended in cutter.records(texts, state):
                whole = ended and not torn
                rows.append({"_file": file, "_range": begin, "_part": 1 if whole else 0, "_at": at if whole else 0, "_ends": ended, "_torn": torn, "text": "".join(parts)})
                at += elements if whole else 0
                torn = torn and not ended
                if len(rows) >= 1_000:
                    yield pa.RecordBatch.from_pylist(rows, schema=arrow)
                    rows = []
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    arrow = pa.schema([("_file", pa.string()), ("_range", pa.int64()), ("_part", pa.int32()), ("_at", pa.int64()), ("_ends", pa.bool_()), ("_torn", pa.bool_()), ("text", pa.string())])
    found = pieces.mapInArrow(cut, "_file string, _range long, _part int, _at long, _ends boolean, _torn boolean, text string")
    found = stage(found, "records")
    whole = found.where("_part = 1").select("_file", "_range", "_part", "_at", "text")
    # At most two fragments of a range: the end of a record that began before it, and the beginning of one that ends after it.
    order = Window.partitionBy("_file").orderBy("_range", F.desc("_torn"))
    number = F.sum(F.col("_ends").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    torn = found.where("_part = 0").withColumn("_number", F.coalesce(number, F.lit(0)))
    part = F.struct("_range", ~F.col("_torn"), "text")
    joined = torn.groupBy("_file", "_number").agg(F.max("_range").alias("_range"), F.max("_ends").alias("_ends"), F.sort_array(F.collect_list(part)).alias("parts"))
    joined = joined.select("_file", "_range", F.lit(0).alias("_part"), F.lit(0).cast("long").alias("_at"), F.array_join("parts.text", "").alias("text"))
    return whole.union(joined.where(F.trim("text") != ""))


def _by_range(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], Iterator[str]]]:
    """The pieces of each range of a task, which come one after the other."""
    current: list[Any] = [None, None]

    def rows() -> Iterator[tuple[tuple[str, int], str]]:
        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(3)]
            for file, begin, value in zip(*columns, strict=True):
                yield (file, begin), value

    source = rows()
    current = [*next(source, (None, None))]

    def pieces(key: tuple[str, int]) -> Iterator[str]:
        while current[0] == key:
            yield current[1]
            current[:] = next(source, (None, None))

    while current[0] is not None:
        key = current[0]
        texts = pieces(key)
        yield key, texts
        for _ in texts:
            pass

