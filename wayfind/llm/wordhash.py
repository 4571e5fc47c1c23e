"""Words of texts as 64-bit hashes, and hashes of word windows, in numpy."""

from __future__ import annotations

import numpy as np
import xxhash

#: Words a worker remembers; then it starts anew.
REMEMBER = 1_000_000
PRIME = np.uint64(0x9E3779B97F4A7C15)


class WordHash(dict):
    """word (bytes) -> 64-bit hash, remembered within bounds."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > REMEMBER:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def array(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit over all others."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def windows(words: np.ndarray, width: int) -> np.ndarray:
    """The hash of each window of `width` consecutive word hashes, by its first word."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = words[:n].copy()
    for k in range(1, width):
        h *= PRIME
        h += words[k : k + n]
    return mix(h)


def shingle_set(words: np.ndarray, width: int) -> np.ndarray:
    """The sorted distinct shingles; of fewer words, the whole sequence as one; of none, empty."""
    if 0 < len(words) < width:
        return windows(words, len(words)) ^ np.uint64(len(words))
    return np.unique(windows(words, width))
