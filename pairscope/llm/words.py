"""Word rules shared by the shingle operators: ASCII-lowered words between ASCII blanks, 64-bit word and shingle hashes."""

from __future__ import annotations

import numpy as np
import xxhash

#: Odd multipliers and shifts of the shingle mixer.
M1, M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
S29, S32 = np.uint64(29), np.uint64(32)


class WordHashes(dict):
    """word -> 64-bit hash; remembers up to `limit` words, which bounds memory and never changes a hash."""

    def __init__(self, limit: int = 50_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(self) < self.limit:
            self[word] = value
        return value

    def of(self, text: bytes) -> np.ndarray:
        """Hashes of the words of a text.  bytes.lower changes A-Z only, bytes.split takes the six ASCII blanks."""
        words = text.lower().split()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k words in order; of the whole sequence where it is shorter; none without words."""
    n = len(words)
    if not n:
        return words
    k = min(k, n)
    acc = np.full(n - k + 1, k, np.uint64)
    for j in range(k):
        acc = (acc ^ (acc >> S29)) * M1 + words[j : n - k + 1 + j]
    acc = (acc ^ (acc >> S32)) * M2
    return acc ^ (acc >> S29)
