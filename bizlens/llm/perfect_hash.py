"""Minimal perfect hash over distinct 64-bit keys, looked up in NumPy batches.

Level by level, keys that are alone at their position of a bit table get
their bit set; the others go to the next, smaller table. A key's slot is the
number of bits set before its own, so ``n`` keys fill the slots 0 to ``n-1``.
A lookup tests one bit per level until one is set: 1.6 levels on average,
whatever ``n`` is. Keys outside the set get some slot or -1; the caller's
stored fingerprints tell them apart.
"""

from __future__ import annotations

import numpy as np

from bizlens.llm.common import mix64

_SEED = 0x5851F42D4C957F2D


def _place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    return mix64(keys ^ np.uint64(_SEED * (2 * level + 1) & 0xFFFFFFFFFFFFFFFF)) % np.uint64(size)


def fingerprint(keys: np.ndarray) -> np.ndarray:
    """32 bits of a key, independent of its places."""
    return (mix64(keys + np.uint64(0xA0761D6478BD642F)) >> np.uint64(32)).astype(np.uint32)


class PerfectHash:
    def __init__(self, sizes: np.ndarray, words: np.ndarray):
        self.sizes, self.words = sizes, words
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])
        self.first = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray, gamma: float = 2.0) -> PerfectHash:
        left = np.unique(np.asarray(keys, dtype=np.uint64))
        if len(left) != len(keys):
            raise ValueError("keys must be distinct")
        sizes, words = [], []
        while len(left):
            size = -(-int(gamma * len(left) + 1) // 64) * 64
            at = _place(left, len(sizes), size).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            sizes.append(size)
            words.append(np.packbits(alone, bitorder="little").view(np.uint64))
            left = left[~alone[at]]
        return cls(np.array(sizes, dtype=np.int64),
                   np.concatenate(words) if words else np.zeros(0, dtype=np.uint64))

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Slot of each key; -1 where no level has a bit for it."""
        keys = np.asarray(keys, dtype=np.uint64)
        out = np.full(len(keys), -1, dtype=np.int64)
        todo = np.arange(len(keys))
        for level, size in enumerate(self.sizes.tolist()):
            if not len(todo):
                break
            at = self.first[level] + _place(keys[todo], level, size).astype(np.int64)
            word, bit = at >> 6, (at & 63).astype(np.uint64)
            held = self.words[word] >> bit
            hit = (held & np.uint64(1)).astype(bool)
            word, bit = word[hit], bit[hit]
            below = self.words[word] & ((np.uint64(1) << bit) - np.uint64(1))
            out[todo[hit]] = self.before[word] + np.bitwise_count(below)
            todo = todo[~hit]
        return out

    def to_bytes(self) -> bytes:
        return np.int64(len(self.sizes)).tobytes() + self.sizes.tobytes() + self.words.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> PerfectHash:
        n = int(np.frombuffer(data, np.int64, 1)[0])
        return cls(np.frombuffer(data, np.int64, n, 8), np.frombuffer(data, np.uint64, -1, 8 + 8 * n))
