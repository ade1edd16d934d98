"""Word shingles of whole texts as sets of 64-bit hashes."""

from __future__ import annotations

import numpy as np
import xxhash

WORDS_KEPT = 300_000
FACTOR = np.uint64(0x9E3779B97F4A7C15)


class WordHashes(dict):
    """word -> 64-bit hash; a worker starts anew when it holds too many, which changes no result."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORDS_KEPT:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


HASHES = WordHashes()


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, words: int = 5) -> np.ndarray:
    """Sorted distinct hashes of runs of ``words`` words, A-Z lower-cased; a shorter text is one run; no words, no run."""
    tokens = (text or "").encode().lower().split()  # bytes: only A-Z change case, only \x20 and \x09-\x0D part words
    if not tokens:
        return np.empty(0, np.uint64)
    hashes = np.fromiter(map(HASHES.__getitem__, tokens), np.uint64, len(tokens))
    n = min(words, len(hashes))
    runs = np.zeros(len(hashes) - n + 1, np.uint64)
    for k in range(n):
        runs = runs * FACTOR + hashes[k : k + len(runs)]
    return np.unique(mixed(runs + np.uint64(n)))
