"""Secret scans: fixed patterns, and strings that look random rather than like identifiers.

Two Markov models of characters are trained from labelled strings: values that the fixed patterns caught against
ordinary words. A string of letters, digits and the like whose log-likelihood ratio, per character, is high enough is
reported as a further span.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qaloom.llm.common import hidden, let, running, running_sums, shown

# The kinds in the order in which spans that start together are listed, their patterns, the group
# that a length is asked of, and that length.
KINDS = (
    ("assign", r"""(?i:(?:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 8),
    ("access", r"AKIA[A-Z0-9]+", 0, 16),
    ("hex", r"[0-9a-f]+", 0, 32),
)
# The same spans as the patterns above, found faster: a run that is too short has no part that is long enough.
_QUICK = {"access": r"AKIA[A-Z0-9]{12,}", "hex": r"[0-9a-f]{32,}"}
# Strings that the models judge, if they hold a letter.
CANDIDATE = r"(?<![A-Za-z0-9_+])[A-Za-z0-9_+]{16,}"
# Code points of a text that are rewritten at once.
CHUNK = 4_096
SYMBOLS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_+"
# A span needs this mean log-likelihood ratio per step, in nats.
RATIO = 0.5
PLACEHOLDER = "[SECRET]"

_SPAN = "struct<start:int,end:int,rank:int,kind:string,value:string>"


def _matches(text: Column, kind: str, rank: int, pattern: str) -> Column:
    """Spans of all matches from left to right; positions in code points, the end exclusive."""

    def span(value: Column, end: Column) -> Column:
        begin = end - F.length(value)
        return F.struct(
            begin.cast("int").alias("start"), end.cast("int").alias("end"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), value.alias("value")
        )

    def placed(found: Column) -> Column:
        between = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found))
        ends = running_sums(F.zip_with(found, between, lambda m, g: F.length(m) + F.length(g)))
        return F.when(F.size(found) > 0, F.zip_with(found, ends, span)).otherwise(F.expr(f"cast(array() as array<{_SPAN}>)"))

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), placed)


def _fixed_spans(text: Column, kind: str, rank: int, pattern: str, group: int, least: int) -> Column:
    """Spans of a fixed pattern; matches that are too short are dropped after they were matched."""
    spans = _matches(text, kind, rank, _QUICK.get(kind, pattern))
    if kind in _QUICK:
        return spans
    return F.filter(spans, lambda s: F.length(F.regexp_extract(s["value"], pattern, group)) >= least)


def labelled_strings(docs: DataFrame, text: str = "text") -> DataFrame:
    """``value, random``: the labelled strings of all documents.

    Random are long runs of hexadecimal digits and access keys that stand alone, ordinary are words of ASCII
    letters, digits and underscores that are neither.
    """
    word = F.regexp_extract_all(F.col(text), F.lit(r"(?<![\p{L}\p{N}_])[A-Za-z][A-Za-z0-9_]{5,30}(?![\p{L}\p{N}_])"), F.lit(0))
    secret = F.regexp_extract_all(
        F.col(text), F.lit(r"(?<![A-Za-z0-9])(?:AKIA[A-Z0-9]{12,}|[0-9a-f]{32,})(?![A-Za-z0-9])"), F.lit(0)
    )
    ordinary = docs.select(F.explode(word).alias("value"), F.lit(False).alias("random")).where(~F.col("value").rlike("^AKIA[A-Z0-9]{12}"))
    return docs.select(F.explode(secret).alias("value"), F.lit(True).alias("random")).union(ordinary)


def train(docs: DataFrame, text: str = "text") -> list[float] | None:
    """Log-likelihood ratio of every step between two symbols, row by row; None if a class has no string at all.

    Every string of every document counts, so a class is learned however rare it is. The counts are summed in tasks
    first and are at most two times the square of the alphabet, whatever the size of the input.
    """
    step = F.explode(F.regexp_extract_all("value", F.lit("(?=(..))"), F.lit(1))).alias("step")
    steps = labelled_strings(docs, text).select("random", step)
    counts = {(r["random"], r["step"]): r["n"] for r in steps.groupBy("random", "step").agg(F.count("*").alias("n")).collect()}
    if {label for label, _ in counts} != {True, False}:
        return None
    ratios = []
    for a in SYMBOLS:
        sums = {label: sum(counts.get((label, a + b), 0) for b in SYMBOLS) + len(SYMBOLS) for label in (True, False)}
        for b in SYMBOLS:
            odds = {label: (counts.get((label, a + b), 0) + 1) / sums[label] for label in (True, False)}
            ratios.append(math.log(odds[True] / odds[False]))
    return ratios


def _ratio(value: Column, ratios: list[float]) -> Column:
    """Mean log-likelihood ratio per step of a string over ``SYMBOLS``."""
    table = F.array(*[F.lit(round(x, 6)) for x in ratios])
    chars = F.split(value, "")
    place = F.transform(chars, lambda c: F.instr(F.lit(SYMBOLS), c) - 1)
    steps = F.zip_with(F.slice(place, F.lit(1), F.size(place) - 1), F.slice(place, F.lit(2), F.size(place) - 1),
                       lambda a, b: F.element_at(table, a * len(SYMBOLS) + b + 1))
    return F.aggregate(steps, F.lit(0.0), lambda acc, x: acc + x) / F.size(steps)


def _rewritten(text: Column, spans: Column, opened, covered) -> Column:
    """``text`` with other text in place of disjoint spans: ``opened(length)`` where one begins, ``covered(length)`` for the
    part of one that began in an earlier chunk.

    A text is cut into chunks, and a chunk is put together from its own spans, so that the work follows the text.
    """

    def rewrite(chunk: Column, i: Column, known: Column) -> Column:
        begin, size, of = i * CHUNK, F.length(chunk), known["of"]
        reach = F.aggregate(
            F.filter(known["crossing"], lambda s: (s["start"] < begin) & (s["end"] > begin)), F.lit(0), lambda acc, s: F.greatest(acc, s["end"] - begin)
        )
        first = F.array_position(of, i).cast("int")
        count = F.size(of) - F.array_position(known["back"], i).cast("int") + 2 - first
        own = F.slice(known["spans"], F.greatest(first, F.lit(1)), F.when(first > 0, count).otherwise(0))

        def step(state: Column, s: Column) -> Column:
            start, end = s["start"] - begin, F.least(s["end"] - begin, size)
            gap = F.substring(chunk, state["at"] + 1, start - state["at"])
            return F.struct(end.alias("at"), F.concat(state["out"], gap, opened(end - start)).alias("out"))

        head = let(F.least(reach, size), lambda n: F.struct(n.alias("at"), covered(n).alias("out")))
        return F.aggregate(own, head, step, lambda state: F.concat(state["out"], F.substring(chunk, state["at"] + 1, size)))

    def known(cuts: Column) -> Column:
        of = F.transform(cuts, lambda s: F.floor(s["start"] / CHUNK).cast("int"))
        # No more than one span crosses the border of two chunks.
        crossing = F.filter(cuts, lambda s: F.floor((s["end"] - 1) / CHUNK) > F.floor(s["start"] / CHUNK))
        return F.struct(cuts.alias("spans"), of.alias("of"), F.reverse(of).alias("back"), crossing.alias("crossing"))

    chunks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))
    return let(let(spans, known), lambda k: F.array_join(F.transform(chunks, lambda chunk, i: rewrite(chunk, i, k)), ""))


def _united(spans: str) -> Column:
    """Runs of overlapping spans, which are ordered by start, as one span each.

    A run begins with a span that starts where all before it have ended, and ends with the largest end before the next.
    """
    spans = F.col(spans)

    def runs(ends: Column) -> Column:
        marked = F.zip_with(spans, F.concat(F.array(F.lit(0).cast("long")), ends), lambda s, e: F.struct(s["start"].alias("start"), e.alias("before")))
        firsts = F.filter(F.slice(marked, F.lit(1), F.size(spans)), lambda x: x["start"] >= x["before"])
        return let(firsts, lambda own: F.zip_with(own, lasts(own, ends), lambda f, e: F.struct(f["start"].alias("start"), e.cast("int").alias("end"))))

    def lasts(firsts: Column, ends: Column) -> Column:
        return F.concat(F.transform(F.slice(firsts, F.lit(2), F.size(firsts)), lambda x: x["before"]), F.array(F.array_max(ends)))

    return let(running(F.transform(spans, lambda s: s["end"]), F.greatest), runs)


def scan(docs: DataFrame, ratios: list[float] | None, text: str = "text") -> DataFrame:
    """``docs`` with ``base`` and ``spans``: spans of the fixed patterns, and those with the models' spans.

    Both are ordered by start and kind. What the spans of the fixed patterns leave of a longer string is judged by itself. A
    null text is an empty one. Columns of ``docs`` that have these names are replaced.
    """
    kept = [c for c in docs.columns if c not in ("base", "spans")]
    rows = hidden(docs).withColumn("value", F.coalesce(F.col(f"`_in_{text}`"), F.lit("")))
    base = F.concat(*[_fixed_spans(F.col("value"), kind, rank, *rest) for rank, (kind, *rest) in enumerate(KINDS)])
    rows = rows.withColumn("base", F.array_sort(base))
    more = F.expr(f"cast(array() as array<{_SPAN}>)")
    if ratios:
        blank = lambda n: F.repeat(F.lit(" "), n)
        rows = rows.withColumn("left", F.when(F.size("base") > 0, _rewritten(F.col("value"), _united("base"), blank, blank)).otherwise(F.col("value")))
        rows = rows.withColumn("more", _matches(F.col("left"), "random", len(KINDS), CANDIDATE))
        judged = F.filter("more", lambda s: s["value"].rlike("[A-Za-z]") & (_ratio(s["value"], ratios) >= RATIO))
        more = F.when(F.size("more") > 0, judged).otherwise(more)
    return rows.select(*shown(kept), "base", F.array_sort(F.concat("base", more)).alias("spans"))


def digest(spans: str) -> Column:
    """``kind:start:end`` of all spans, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redact(docs: DataFrame, ratios: list[float] | None, text: str = "text") -> DataFrame:
    """``docs`` with every span, or run of overlapping spans, replaced by ``PLACEHOLDER``; other texts as they are.

    All other columns come back as they were, whatever their names.
    """
    rows = hidden(docs)
    found = scan(rows.withColumn("value", F.col(f"`_in_{text}`")), ratios, "value")
    clean = _rewritten(F.col("value"), _united("spans"), lambda n: F.lit(PLACEHOLDER), lambda n: F.lit(""))
    found = found.withColumn("clean", F.when(F.size("spans") > 0, clean).otherwise(F.col("value")))
    return found.select(*[F.col("clean").alias(c) if c == text else shown([c])[0] for c in docs.columns])
