"""Word shingles as sets of 64-bit numbers, and their MinHash signatures, in numpy."""

from __future__ import annotations

import numpy as np
import xxhash

_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


class WordNumbers(dict):
    """Word -> 64-bit number; forgets all beyond ``limit`` words."""

    def __init__(self, limit: int = 100_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_NUMBERS = WordNumbers()


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX[1]
    x = (x ^ (x >> np.uint64(27))) * _MIX[2]
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct shingles of ``size`` words, A-Z in lower case; the whole sequence if shorter; empty without words.

    Words are runs of anything but ASCII white space, so bytes can be split as they are.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(_NUMBERS.__getitem__, words), np.uint64, len(words))
    k = min(size, len(w))
    h = np.full(len(w) - k + 1, np.uint64(k), np.uint64)
    for i in range(k):
        h = _mixed(h * _MIX[0] + w[i : len(w) - k + 1 + i])
    return np.unique(h)


class MinHash:
    """``rows * bands`` universal hash functions x -> a x + b (mod 2^64), a odd, ordered by their high bits."""

    def __init__(self, rows: int, bands: int, seed: int):
        rng = np.random.Generator(np.random.PCG64(seed))
        self.rows, self.bands = rows, bands
        self.a = rng.integers(0, 2**63, rows * bands, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.b = rng.integers(0, 2**64, rows * bands, dtype=np.uint64)

    def minima(self, shingles: np.ndarray) -> np.ndarray:
        out = np.full(len(self.a), np.iinfo(np.uint64).max, np.uint64)
        for i in range(0, len(shingles), 512):
            part = np.multiply.outer(self.a, shingles[i : i + 512])
            part += self.b[:, None]
            np.minimum(out, part.min(axis=1), out=out)
        return out

    def band_keys(self, minima: np.ndarray) -> np.ndarray:
        """One 64-bit key per band; keys of different bands differ."""
        h = np.arange(1, self.bands + 1, dtype=np.uint64)
        for column in minima.reshape(self.bands, self.rows).T:
            h = _mixed(h * _MIX[0] + column)
        return h.view(np.int64)
