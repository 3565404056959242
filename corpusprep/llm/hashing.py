"""Hashes of words and shingles, for code that runs in Arrow batches."""

from __future__ import annotations

import numpy as np
import xxhash

_CACHE = 1 << 19
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


class WordHashes(dict):
    """64-bit hash of a word, kept for words that come again; the store is emptied when full."""

    def __missing__(self, word: bytes | str) -> int:
        if len(self) >= _CACHE:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def mix(values: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that all bits depend on all bits."""
    values = values ^ (values >> np.uint64(30))
    values = values * _B
    values = values ^ (values >> np.uint64(27))
    values = values * _C
    return values ^ (values >> np.uint64(31))


def word_hashes(words: list, cache: WordHashes) -> np.ndarray:
    return np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))


def shingle_hashes(words: list, width: int, cache: WordHashes) -> np.ndarray:
    """Hashes of the runs of `width` words, in order; a shorter text is one run, no word none."""
    if not words:
        return np.empty(0, np.uint64)
    one = word_hashes(words, cache)
    n = max(1, len(one) - width + 1)
    total = np.zeros(n, np.uint64)
    for k in range(min(width, len(one))):
        total = mix(total * _A + one[k : k + n] + np.uint64(k + 1))
    return total


#: Lower-cases A-Z in UTF-8; `bytes.split` then parts words at the ASCII white space only.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def ascii_words(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(LOWER).split()
