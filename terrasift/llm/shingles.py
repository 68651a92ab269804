"""Sets of hashed word shingles."""

from __future__ import annotations

import hashlib

import numpy as np
import xxhash

from terrasift.llm.common import lower_words

REMEMBERED = 300_000
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads all bits."""
    h = (h ^ (h >> np.uint64(30))) * _MIX[1]
    h = (h ^ (h >> np.uint64(27))) * _MIX[2]
    return h ^ (h >> np.uint64(31))


class Shingler:
    """Hashes words, remembering recent ones, and joins ``width`` of them to shingles."""

    def __init__(self, width: int = 5):
        self.width = width
        self.known: dict[bytes, int] = {}

    def word_hashes(self, words: list[bytes]) -> np.ndarray:
        known = self.known
        new = set(words).difference(known)
        if len(known) + len(new) > REMEMBERED:
            known.clear()
            new = set(words)
        for word in new:
            known[word] = xxhash.xxh3_64_intdigest(word)
        return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))

    def of_words(self, words: list[bytes]) -> np.ndarray:
        """Distinct shingle hashes in order; all words as one if there are fewer than ``width``, none without words."""
        h = self.word_hashes(words)
        n = len(h) - self.width + 1
        if not len(h):
            return h
        if n < 1:
            total = np.array([len(h)], np.uint64)
            for k in range(len(h)):
                total = mixed(total * _MIX[0] + h[k : k + 1])
            return total
        total = np.zeros(n, np.uint64)
        for k in range(self.width):
            total = total * _MIX[0] + h[k : k + n]
        return np.unique(mixed(total))

    def of_text(self, text: str) -> np.ndarray:
        return self.of_words(lower_words(text))


def name_of(shingles: np.ndarray) -> bytes | None:
    """128 bits that stand for the set; None for the empty one."""
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest() if len(shingles) else None
