"""Tokens of texts as 64-bit values, for operators that count words inside tasks."""

from __future__ import annotations

import numpy as np

from qaloom.llm.common import hashed_runs

# Bytes that end a word: ASCII white space, and what is neither a letter, a digit nor beyond ASCII.
WHITE = np.zeros(256, bool)
WHITE[[32, *range(9, 14)]] = True
NO_TERM = np.ones(256, bool)
NO_TERM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False


def tokens(texts: list[bytes], separator: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens of the texts, A-Z as a-z, and where the tokens of each text begin, with the end."""
    hashes, starts = hashed_runs(b" ".join([*texts, bytes(9)]).lower(), separator)
    return hashes, np.searchsorted(starts, np.cumsum([0, *(len(t) + 1 for t in texts)]))
