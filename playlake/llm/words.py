"""Words of whole texts as 64-bit numbers, inside tasks."""

from __future__ import annotations

import numpy as np
import xxhash

MASK = (1 << 64) - 1
# Odd multipliers of the two polynomial hashes over word hashes (fixed values).
BASE_A = np.uint64(0x9E3779B97F4A7C15)
BASE_B = np.uint64(0xC2B2AE3D27D4EB4F)
MIX_1, MIX_2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


class WordHashes(dict):
    """Word (bytes) -> 64-bit hash; forgets all when it holds ``limit`` words, so its size is bounded."""

    def __init__(self, limit: int = 300_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:
            if len(self) >= self.limit:
                self.clear()
            self[word] = value
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * MIX_1
    x = (x ^ (x >> np.uint64(27))) * MIX_2
    return x ^ (x >> np.uint64(31))


def power(base: np.uint64, n: int) -> np.uint64:
    return np.uint64(pow(int(base), n, 1 << 64))


def windows(h: np.ndarray, n: int, base: np.uint64 = BASE_A) -> np.ndarray:
    """Hash of every run of ``n`` words, by doubling: a run of a+b is the run of a, then that of b."""
    out, length = None, 0
    step, size = h, 1
    while n:
        if n & 1:
            if out is None:
                out, length = step, size
            else:
                m = len(h) - length - size + 1
                out = out[:m] * power(base, size) + step[length:length + m]
                length += size
        n >>= 1
        if n:
            m = len(step) - size
            step = step[:max(m, 0)] * power(base, size) + step[size:] if m > 0 else step[:0]
            size *= 2
    return out if len(h) >= length else h[:0]
