"""64-bit hashes of words and of runs of words, vectorised."""

from __future__ import annotations

import numpy as np
import xxhash

#: Odd constants that spread a product over all bits; any fixed odd numbers serve.
MIX = tuple(np.uint64(2 * (0x9E3779B97F4A7C15 * (i + 1) % 2**63) + 1) for i in range(2))
CACHE = 150_000


class WordHashes(dict):
    """Word (bytes) to 64-bit hash, remembered; a task holds at most CACHE words."""

    def __init__(self, seen=lambda w: w):
        self.seen = seen

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(self.seen(word))
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def runs(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of ``k`` words, in order; empty if there are fewer words."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = hashes[:n].copy()
    for i in range(1, k):
        out ^= out >> np.uint64(29)
        out *= MIX[0]
        out += hashes[i : i + n]
    out ^= out >> np.uint64(32)
    out *= MIX[1]
    out ^= out >> np.uint64(29)
    return out


def shingle_set(text: str | None, k: int, words: WordHashes) -> np.ndarray:
    """Sorted distinct hashes of a text's runs of ``k`` words, A-Z lower-cased; with fewer words
    the whole sequence is one run; without words the set is empty."""
    if not text:
        return np.empty(0, np.uint64)
    h = words.of(text.encode().lower().split())
    if len(h) == 0:
        return h
    if len(h) < k:
        # a shorter sequence differs from every full run: its length is hashed in
        return runs(np.append(h, np.uint64(len(h))), len(h) + 1)
    return np.unique(runs(h, k))
