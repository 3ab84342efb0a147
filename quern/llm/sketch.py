"""Shingle sets and fast similarity sketches of texts."""

from __future__ import annotations

import hashlib

import numpy as np
import xxhash

BINS, ROWS = 150, 5
BANDS = BINS // ROWS
CACHE = 150_000  # word hashes that a worker remembers
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_ROUNDS = np.random.default_rng(20170).integers(1, 1 << 63, size=(2 * BINS, 2), dtype=np.uint64) | np.uint64(1)


def words(text: str | None) -> list[bytes]:
    """Words of a text: A-Z lower-cased, split at the six ASCII white space characters."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


class Shingler:
    """64-bit hashes of the distinct runs of ``size`` words; texts with fewer words are one run."""

    def __init__(self, size: int):
        self.size, self.cache = size, {}

    def of(self, text: str | None) -> np.ndarray:
        w = words(text)
        if not w:
            return np.zeros(0, dtype=np.uint64)
        if len(self.cache) > CACHE:
            self.cache = {}
        cache, h = self.cache, np.empty(len(w), dtype=np.uint64)
        for i, x in enumerate(w):
            v = cache.get(x)
            if v is None:
                v = cache[x] = xxhash.xxh3_64_intdigest(x)
            h[i] = v
        return shingle_hashes(h, self.size)


def shingle_hashes(h: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``size`` of the word hashes ``h`` (not empty)."""
    k = min(size, len(h))
    mixed = np.full(len(h) - k + 1, k, dtype=np.uint64)
    for j in range(k):
        mixed = (mixed ^ h[j : len(h) - k + 1 + j]) * _M1
        mixed ^= mixed >> np.uint64(29)
    return np.unique(mixed * _M2)


def sketch(items: np.ndarray) -> np.ndarray:
    """The fast similarity sketch of a non-empty set of 64-bit hashes: one 32-bit value a bin.

    In round i every element is hashed to a value and, for i < BINS, to a bin; a bin keeps the least value of the first
    round that reaches it. From round BINS on, round i puts all elements in bin i - BINS, so that every bin is filled.
    """
    out = np.zeros(BINS, dtype=np.uint32)
    empty = np.ones(BINS, dtype=bool)
    for i in range(2 * BINS):
        u = (items ^ _ROUNDS[i, 0]) * _ROUNDS[i, 1]
        u ^= u >> np.uint64(32)
        u *= _M2
        value = (u >> np.uint64(32)).astype(np.uint32)
        if i < BINS:
            found = np.full(BINS, 0xFFFFFFFF, dtype=np.uint32)
            at = ((u & np.uint64(0xFFFFFFFF)) * np.uint64(BINS)) >> np.uint64(32)
            at = at.astype(np.int64)
            np.minimum.at(found, at, value)
            hit = np.zeros(BINS, dtype=bool)
            hit[at] = True
            hit &= empty
        else:
            hit = np.zeros(BINS, dtype=bool)
            hit[i - BINS] = empty[i - BINS]
            found = np.full(BINS, value.min(), dtype=np.uint32)
        out[hit] = found[hit] ^ np.uint32(i * 0x85EBCA6B & 0xFFFFFFFF)
        empty &= ~hit
        if not empty.any():
            break
    return out


def band_keys(values: np.ndarray) -> np.ndarray:
    """A signed 64-bit key for each band of a sketch."""
    key = np.arange(1, BANDS + 1, dtype=np.uint64) * _M1
    for column in values.reshape(BANDS, ROWS).T.astype(np.uint64):
        key = (key ^ column) * _M2
        key ^= key >> np.uint64(31)
    return (key * _M1).view(np.int64)


def brief(values: np.ndarray) -> bytes:
    """A byte of each bin, for estimates: the share of equal bytes is the similarity, give or take."""
    return ((values * np.uint32(0x9E3779B1)) >> np.uint32(24)).astype(np.uint8).tobytes()


def fingerprint(items: np.ndarray) -> bytes:
    return hashlib.blake2b(items.tobytes(), digest_size=16).digest()
