"""Scalar text functions. Each takes and returns Columns and stays on the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from qaloom import prompts

# Fixed value: the characters Python's str.strip() and str.split() treat as whitespace.
WHITESPACE = (
    r"[\x{09}-\x{0d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_ws(c: Column | str) -> Column:
    """Remove whitespace of any kind from both ends (``trim`` removes blanks only)."""
    return F.regexp_replace(_col(c), f"^{WHITESPACE}+|{WHITESPACE}+$", "")


def words(c: Column | str) -> Column:
    """Whitespace-separated words, case kept."""
    return F.array_remove(F.split(_col(c), f"{WHITESPACE}+"), "")


def terms(c: Column | str) -> Column:
    """Lower-case runs of letters and digits: the unit of lexical search."""
    return F.array_remove(F.split(F.lower(_col(c)), r"[^\p{L}\p{N}]+"), "")


def ascii_terms(c: Column | str) -> Column:
    """Lower-case runs of ``a-z0-9``: the unit of ROUGE."""
    return F.array_remove(F.split(F.lower(_col(c)), "[^a-z0-9]+"), "")


def truncate_words(c: Column | str, limit: int = prompts.MAX_QUERY_WORDS) -> Column:
    """The first ``limit`` words joined by single blanks."""
    return F.array_join(F.slice(words(c), 1, limit), " ")


def clean_response(c: Column | str) -> Column:
    """Normalize a model reply: citation markers and square brackets go, then strip and lower."""
    without_markers = F.regexp_replace(_col(c), r"\[doc\p{Nd}+\]", "")
    return F.lower(strip_ws(F.regexp_replace(without_markers, r"[\[\]]", "")))


def fold_answer(c: Column | str) -> Column:
    """Normalize a gold answer: strip and lower."""
    return F.lower(strip_ws(c))


def text_or(c: Column | str, default: str = "") -> Column:
    """The value, or ``default`` where it is missing."""
    return F.coalesce(_col(c), F.lit(default))


def filled_or(c: Column | str, default: str) -> Column:
    """The value, or ``default`` where it is missing or empty."""
    return F.coalesce(F.nullif(_col(c), F.lit("")), F.lit(default))


def first_filled(*cols: Column | str) -> Column:
    """The first value that is neither missing nor empty; the last column is taken as it is."""
    head = [F.nullif(_col(c), F.lit("")) for c in cols[:-1]]
    return F.coalesce(*head, _col(cols[-1]))


def render_options(question: Column | str, options: Column | str) -> Column:
    """The question followed by one ``K) text`` line per option, in map order."""
    lines = F.transform(F.map_entries(_col(options)), lambda o: F.concat(F.lit("\n"), o["key"], F.lit(") "), o["value"]))
    return F.concat(_col(question), F.lit("\nOptions:"), F.array_join(lines, ""))


def join_snippets(snippets: Column | str) -> Column:
    """Snippet texts joined by a blank; a missing list gives an empty text."""
    texts = F.transform(_col(snippets), lambda s: F.coalesce(s["text"], F.lit("")))
    return F.coalesce(F.array_join(texts, " "), F.lit(""))


def context_then_question(contexts: Column | str, question: Column | str) -> Column:
    """Context passages, then the question, stripped as one text."""
    joined = F.coalesce(F.array_join(_col(contexts), " "), F.lit(""))
    return strip_ws(F.concat(joined, F.lit(" "), text_or(question)))


def user_content(body: Column | str, context: Column | str | None = None, prefix: bool = True) -> Column:
    """``Question: …`` with an optional ``Context: …`` line, or the bare body."""
    body = _col(body)
    if context is not None:
        return F.concat(F.lit("Question: "), body, F.lit("\nContext: "), _col(context))
    return F.concat(F.lit("Question: "), body) if prefix else body


def reference_answers(answers: Column | str, field: str = "ANSWER") -> Column:
    """Non-empty reference answers, one per line."""
    texts = F.transform(_col(answers), lambda a: a[field])
    return F.coalesce(F.array_join(F.filter(texts, lambda t: t != ""), "\n"), F.lit(""))


def first_answer(raw: Column | str) -> Column:
    """First entry of a list held as VARIANT; a plain text counts as its own only entry, an empty one as missing."""
    raw = _col(raw)
    kind = F.schema_of_variant(raw)
    return F.when(kind.startswith("ARRAY"), F.try_variant_get(raw, "$[0]", "string")).when(
        kind == "STRING", F.nullif(F.try_variant_get(raw, "$", "string"), F.lit(""))
    )


def title_and_abstract(title: Column | str, abstract: Column | str) -> Column:
    return F.concat(text_or(title), F.lit(" "), text_or(abstract))


def paper_url(pmc_files: Column | str, pdf_files: Column | str, s2_id: Column | str) -> Column:
    """Article address from the first parsed file (PMC before PDF), else from the S2 id, else empty."""

    def article(files: Column) -> Column:
        name = F.substring_index(F.substring_index(files, ";", 1), "/", -1)
        bare = F.replace(F.replace(name, F.lit(".json"), F.lit("")), F.lit(".xml"), F.lit(""))
        return F.concat(F.lit(prompts.PMC_URL), bare, F.lit("/"))

    return F.coalesce(
        article(_col(pmc_files)),
        article(_col(pdf_files)),
        F.concat(F.lit(prompts.SEMANTIC_SCHOLAR_URL), _col(s2_id)),
        F.lit(""),
    )
