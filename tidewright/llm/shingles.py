"""Word shingles as 64-bit hashes."""

from __future__ import annotations

import numpy as np
import xxhash

#: Distinct words whose hashes a task keeps.
MEMO_WORDS = 1_000_000
_P = np.uint64(0x9E3779B97F4A7C15)


class WordHashes(dict):
    """Word to 64-bit hash."""

    def __missing__(self, word: bytes | str) -> int:
        if len(self) >= MEMO_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h

    def of(self, words: list[bytes] | list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every bit of the input reaches every bit of the output."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingles(h: np.ndarray, k: int = 5) -> np.ndarray:
    """Hashes of the k-word shingles of a text in order; of the whole sequence if it has fewer words; none without words."""
    if not len(h):
        return h
    k = min(k, len(h))
    out = np.full(len(h) - k + 1, k, np.uint64)
    for j in range(k):
        out = out * _P + h[j : len(h) - k + 1 + j]
    return mix(out)


def lower_words(text: bytes) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased."""
    return text.lower().split()
