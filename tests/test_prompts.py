"""The fixed texts, stated once more: the SQL counterparts take them from the code, so nothing else would notice a change."""

from __future__ import annotations

from qaloom import prompts


def test_fixed_texts():
    assert prompts.YES_NO_SYSTEM == (
        "You are a multilingual medical assistant. Answer only with 'yes' or 'no'.  Do not add anything else."
    )
    assert prompts.YES_NO_SYSTEM_UNIFIED == (
        "You are a multilingual medical assistant. Answer only with 'yes' or 'no'. Do not add anything else."
    )
    assert prompts.YES_NO_MAYBE_SYSTEM == (
        "You are a multilingual medical assistant. Answer only with 'yes', 'maybe', or 'no'. Do not add anything else."
    )
    assert prompts.MULTIPLE_CHOICE_SYSTEM == (
        "You are taking the United States Medical Licensing Examination (USMLE). Respond with only one option (A, B, C, D, or E) "
        "based on the question and options provided."
    )
    assert prompts.EXPERT_SYSTEM == "You are a medical and biological expert. Answer the question accurately."
    assert prompts.EXPLAIN_SYSTEM == (
        "You are a multilingual medical assistant. Provide accurate explanations for medical questions in the detected language."
    )
    assert prompts.CLOSE_ENDED_INSTRUCTIONS == {
        "mc": "Answer with A, B, C, or D. Do not add anything else.",
        "yesno": "Answer only with 'yes' or 'no'. Do not add anything else.",
        "ynm": "Answer only with 'yes', 'no', or 'maybe'. Do not add anything else.",
    }
    assert prompts.LONG_FORM_INSTRUCTION == "You are a medical and biological expert. Answer the question accurately."
    assert prompts.LONG_FORM_INSTRUCTION_WITH_CONTEXT == (
        "You are a medical and biological expert. Use the retrieved context to answer the question accurately."
    )
    assert (prompts.NO_CONTEXT, prompts.UNKNOWN_TITLE, prompts.NO_ABSTRACT) == (
        "No relevant documents found.", "Unknown", "No abstract available",
    )
    assert prompts.PMC_URL == "https://www.ncbi.nlm.nih.gov/pmc/articles/"
    assert prompts.SEMANTIC_SCHOLAR_URL == "https://www.semanticscholar.org/paper/"


def test_fixed_numbers():
    assert (prompts.TOP_K, prompts.MAX_QUERY_WORDS, prompts.CHUNK_ROWS, prompts.TRAIN_FRACTION) == (10, 2999, 50_000, 0.9)
    for settings, most in ((prompts.CLOSE_ENDED_SETTINGS, 800), (prompts.LONG_FORM_SETTINGS, 2999)):
        assert settings == {
            "max_tokens": most, "temperature": 0.7, "top_p": 0.95, "frequency_penalty": 0.0, "presence_penalty": 0.0,
        }
