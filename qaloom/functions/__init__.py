from qaloom.functions.chat import build_prompt, chat_field, to_chat
from qaloom.functions.text import (
    clean_response,
    fold_answer,
    join_snippets,
    paper_url,
    reference_answers,
    render_options,
    strip_ws,
    terms,
    title_and_abstract,
    truncate_words,
    words,
)

__all__ = [
    "build_prompt",
    "chat_field",
    "clean_response",
    "fold_answer",
    "join_snippets",
    "paper_url",
    "reference_answers",
    "render_options",
    "strip_ws",
    "terms",
    "title_and_abstract",
    "to_chat",
    "truncate_words",
    "words",
]
