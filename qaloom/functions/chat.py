"""Conversations and prompts as arrays of ``struct<role, content>``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from qaloom import prompts


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def to_chat(system: str | Column, user: Column | str, assistant: Column | str | None = None) -> Column:
    """System, user and (for training rows) assistant message, in this order."""
    system = F.lit(system) if isinstance(system, str) else system
    turns = [message("system", system), message("user", _col(user))]
    if assistant is not None:
        turns.append(message("assistant", _col(assistant)))
    return F.array(*turns)


def chat_field(messages: Column | str, role: str) -> Column:
    """Content of the first message of a role, or an empty text."""
    content = F.get(F.filter(_col(messages), lambda m: m["role"] == role), F.lit(0))["content"]
    return F.coalesce(content, F.lit(""))


def close_ended_instruction(question_type: Column | str) -> Column:
    """Instruction for a question type; a type outside the catalog stops the query."""
    question_type = _col(question_type)
    chosen = None
    for name, text in prompts.CLOSE_ENDED_INSTRUCTIONS.items():
        hit = question_type == name
        chosen = F.when(hit, F.lit(text)) if chosen is None else chosen.when(hit, F.lit(text))
    problem = F.concat(F.lit("unsupported question type: "), F.coalesce(question_type, F.lit("NULL")))
    return chosen.otherwise(F.raise_error(problem).cast("string"))


def with_context(query: Column, context: Column) -> Column:
    return F.concat(F.lit("Question: "), query, F.lit("\n\nContext: "), context)


def build_prompt(
    query: Column | str,
    context: Column | str,
    use_rag: Column,
    question_type: Column | str | None = None,
) -> Column:
    """Prompt of one question: close-ended when a question type is given, long-form otherwise."""
    query, context = _col(query), _col(context)
    if question_type is None:
        system = F.when(use_rag, F.lit(prompts.LONG_FORM_INSTRUCTION_WITH_CONTEXT)).otherwise(
            F.lit(prompts.LONG_FORM_INSTRUCTION)
        )
    else:
        system = close_ended_instruction(question_type)
    return to_chat(system, F.when(use_rag, with_context(query, context)).otherwise(query))
