"""Hashes of words and of word windows, in numpy."""

from __future__ import annotations

import numpy as np
import xxhash

#: Words of a shingle.
WIDTH = 5
_STEP, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def window_hashes(words: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """A hash for each run of `width` words, in text order; none for fewer words."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = words[:n].copy()
    for k in range(1, width):
        out *= _STEP
        out += words[k : k + n]
        out ^= out >> np.uint64(29)
    out *= _MIX
    return out ^ (out >> np.uint64(32))


def shingle_set(text: str, width: int = WIDTH) -> np.ndarray:
    """The distinct shingle hashes of a text, ascending, A-Z in lower case; a shorter text is one shingle."""
    words = text.encode("utf-8").lower().split()  # of bytes: A-Z alone, and exactly the six blanks
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < width:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(words))], np.uint64)
    return np.unique(window_hashes(word_hashes(words), width))
