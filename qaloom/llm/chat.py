r"""Chat formatting with a grammar that can be read back.

A conversation is the sequence of its turns, and a turn is ``### Role: body</turn>`` and a line feed. A role or body
that holds a control string would be read as something else. So every conversation is rendered, reparsed and compared
with its source; where they differ, the turns that hold control strings are escaped and marked by a backslash before
the colon (``### Role\: body``), and where that is not enough, all turns are. Escaped text has no control string, so
this ends there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qaloom.llm.common import let, running_sums

OPEN, MARK, NAMED, CLOSE = "### ", "\\", ": ", "</turn>\n"
END = "</turn>"
MASKED_ROLE = "assistant"


def escape(text: Column) -> Column:
    """Text without control strings: a backslash before every backslash, and one inside of every control string."""
    for plain, hidden in (("\\", "\\\\"), ("##", "#\\#"), (END, "<\\/turn>"), (NAMED, ":\\ ")):
        text = F.replace(text, F.lit(plain), F.lit(hidden))
    return text


def unescape(text: Column) -> Column:
    """The text that ``escape`` got: a backslash goes, and the character after it stays."""
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _holds_control(turn: Column) -> Column:
    role, text = turn["role"], turn["text"]
    found = F.contains(role, F.lit(NAMED)) | F.endswith(role, F.lit(MARK))
    for control in (OPEN, END):
        found = found | F.contains(role, F.lit(control)) | F.contains(text, F.lit(control))
    return found


def _render(turns: str, escaped) -> Column:
    def turn(t: Column) -> Column:
        plain = F.concat(F.lit(OPEN), t["role"], F.lit(NAMED), t["text"], F.lit(CLOSE))
        hidden = F.concat(F.lit(OPEN), escape(t["role"]), F.lit(MARK + NAMED), escape(t["text"]), F.lit(CLOSE))
        return F.when(escaped(t), hidden).otherwise(plain)

    return F.array_join(F.transform(turns, turn), "")


def parse(formatted: Column) -> Column:
    """``array<struct<role, text, start, end>>`` of a rendered conversation; a null text where it breaks the grammar.

    ``start`` and ``end`` bound the body in the rendered text, in code points, before it is unescaped.
    """
    pieces = F.split(formatted, CLOSE, -1)
    pieces = F.slice(pieces, F.lit(1), F.greatest(F.lit(0), F.size(pieces) - 1))

    def read(piece: Column) -> Column:
        name = F.instr(piece, F.lit(NAMED))
        head = F.substring(piece, F.lit(len(OPEN) + 1), name - 1 - len(OPEN))
        body = F.substring(piece, name + len(NAMED), F.length(piece))
        marked = F.endswith(head, F.lit(MARK))
        role = F.when(marked, unescape(F.substring(head, F.lit(1), F.length(head) - 1))).otherwise(head)
        broken = F.contains(body, F.lit(OPEN)) | F.contains(body, F.lit(END)) | F.contains(head, F.lit(OPEN))
        sound = F.startswith(piece, F.lit(OPEN)) & (name > 0) & ~broken
        text = F.when(sound & marked, unescape(body)).when(sound, body)
        return F.struct(role.alias("role"), text.alias("text"), F.length(body).alias("size"))

    def place(t: Column, after: Column) -> Column:
        end = (after - len(CLOSE)).cast("int")
        return F.struct(t["role"].alias("role"), t["text"].alias("text"), (end - t["size"]).alias("start"), end.alias("end"))

    def placed(pieces: Column) -> Column:
        ends = running_sums(F.transform(pieces, lambda p: F.length(p) + len(CLOSE)))
        return F.zip_with(F.transform(pieces, read), ends, place)

    return let(pieces, placed)


def _same(parsed: str, turns: str) -> Column:
    """Whether a parse gives back the source."""
    return F.expr(f"transform({parsed}, t -> named_struct('role', t.role, 'text', t.text)) <=> {turns}")


def format_chats(
    rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """``conv_id, formatted, loss_spans``: one row per conversation, with the places of the assistant's bodies.

    Turns stand in the order of their number, those without number first; turns of one number by role and text, so
    that repeated rows are repeated turns. A null role or text is an empty one, and rows without ``conv_id`` are
    one conversation. A conversation is one text, and its output one string and one digest, so its rows meet in one task
    and may hold no more than Spark's strings and arrays do: 2 GB rendered, escapes included.
    """
    row = F.struct(
        F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text")
    )
    chats = rows.select(F.col(conv_id).alias("conv_id"), row.alias("row")).groupBy("conv_id").agg(F.sort_array(F.collect_list("row")).alias("rows"))
    chats = chats.select("conv_id", F.transform("rows", lambda r: F.struct(r["role"].alias("role"), r["text"].alias("text"))).alias("turns"))
    chats = chats.withColumn("plain", _render("turns", lambda t: F.lit(False))).withColumn("parsed", parse(F.col("plain")))
    better = F.when(_same("parsed", "turns"), F.col("plain")).otherwise(_render("turns", _holds_control))
    chats = chats.withColumn("better", better).withColumn("parsed", parse(F.col("better")))
    best = F.when(_same("parsed", "turns"), F.col("better")).otherwise(_render("turns", lambda t: F.lit(True)))
    chats = chats.select("conv_id", best.alias("formatted")).withColumn("parsed", parse(F.col("formatted")))
    spans = F.expr(f"transform(filter(parsed, t -> t.role = '{MASKED_ROLE}'), t -> named_struct('start', t.start, 'end', t.end))")
    return chats.select("conv_id", "formatted", spans.alias("loss_spans"))


def read_back(chats: DataFrame) -> DataFrame:
    """``chats`` with ``turns`` as the grammar reads them from ``formatted``, and the ``loss_text`` under ``loss_spans``."""
    chats = chats.withColumn("turns", parse(F.col("formatted")))
    said = F.expr(f"filter(turns, t -> t.role = '{MASKED_ROLE}')")
    places = F.transform(said, lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end")))
    texts = F.transform(said, lambda t: t["text"])
    # Other spans than those of the assistant's turns are looked up one by one.
    masked = F.expr("transform(filter(turns, t -> exists(loss_spans, s -> s.start = t.start AND s.end = t.end)), t -> t.text)")
    return chats.withColumn("loss_text", F.array_join(F.when(places == F.col("loss_spans"), texts).otherwise(masked), ""))
