"""Prompt texts and other literals that outputs must reproduce exactly."""

from __future__ import annotations

# System prompts of the training sets.
YES_NO_SYSTEM = "You are a multilingual medical assistant. Answer only with 'yes' or 'no'.  Do not add anything else."
YES_NO_SYSTEM_UNIFIED = (
    "You are a multilingual medical assistant. Answer only with 'yes' or 'no'. Do not add anything else."
)
YES_NO_MAYBE_SYSTEM = (
    "You are a multilingual medical assistant. Answer only with 'yes', 'maybe', or 'no'. Do not add anything else."
)
MULTIPLE_CHOICE_SYSTEM = (
    "You are taking the United States Medical Licensing Examination (USMLE). Respond with only one option "
    "(A, B, C, D, or E) based on the question and options provided."
)
EXPERT_SYSTEM = "You are a medical and biological expert. Answer the question accurately."
EXPLAIN_SYSTEM = (
    "You are a multilingual medical assistant. Provide accurate explanations for medical questions in the detected "
    "language."
)

# Instructions of the evaluation prompts, by question type.
CLOSE_ENDED_INSTRUCTIONS = {
    "mc": "Answer with A, B, C, or D. Do not add anything else.",
    "yesno": "Answer only with 'yes' or 'no'. Do not add anything else.",
    "ynm": "Answer only with 'yes', 'no', or 'maybe'. Do not add anything else.",
}
LONG_FORM_INSTRUCTION = "You are a medical and biological expert. Answer the question accurately."
LONG_FORM_INSTRUCTION_WITH_CONTEXT = (
    "You are a medical and biological expert. Use the retrieved context to answer the question accurately."
)

# Text used when nothing was retrieved or a field is missing.
NO_CONTEXT = "No relevant documents found."
UNKNOWN_TITLE = "Unknown"
NO_ABSTRACT = "No abstract available"

# Article address rules.
PMC_URL = "https://www.ncbi.nlm.nih.gov/pmc/articles/"
SEMANTIC_SCHOLAR_URL = "https://www.semanticscholar.org/paper/"

# Cut-offs and generation settings.
TOP_K = 10
MAX_QUERY_WORDS = 2999
CHUNK_ROWS = 50_000
TRAIN_FRACTION = 0.9
CLOSE_ENDED_SETTINGS = {
    "max_tokens": 800,
    "temperature": 0.7,
    "top_p": 0.95,
    "frequency_penalty": 0.0,
    "presence_penalty": 0.0,
}
LONG_FORM_SETTINGS = {
    "max_tokens": 2999,
    "temperature": 0.7,
    "top_p": 0.95,
    "frequency_penalty": 0.0,
    "presence_penalty": 0.0,
}
