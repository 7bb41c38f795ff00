"""Shingle sets and their parity sketches, as NumPy arrays (used by ``jaccard_join``).

A parity sketch has one bit per hash position; each shingle of a set flips the
bit at its position, so the bits of ``sketch(A) xor sketch(B)`` all come from
shingles in exactly one of the two sets: their Hamming distance never exceeds
``|A - B| + |B - A|``. The positions are split into blocks. If two sets differ
in at most ``d`` shingles, at most ``d`` blocks differ (pigeonhole).
"""

from __future__ import annotations

import numpy as np

from bizlens.llm.common import mix64, word_table

LINK, FULL = 85, 100            # two sets link when FULL * |A and B| >= LINK * |A or B|
WORDS = 4                       # words in a shingle
BAND_RATIO = 1.5                # growth of the size bands
SKETCH_WORDS = (4, 512)         # fewest and most 64-bit words of a dense sketch
_MULT = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93],
                 dtype=np.uint64)


def shingle_sets(rows: list[bytes | None], words: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text (lower-cased A-Z).

    A text with fewer than ``words`` words has its whole sequence as its one
    shingle; one without words (or null) has the empty set.
    """
    h, first, *_ = word_table(rows)
    mult = mix64(np.arange(1, words + 1, dtype=np.uint64)) | np.uint64(1)
    n = len(h) - words + 1
    rolled = np.zeros(max(n, 0), dtype=np.uint64)
    for k in range(words):
        rolled += h[k:k + max(n, 0)] * mult[k]
    rolled = mix64(rolled)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= words:
            out.append(np.unique(rolled[a:b - words + 1]))
        elif b > a:
            whole = (h[a:b] * mult[:b - a]).sum(dtype=np.uint64) + np.uint64(b - a)
            out.append(mix64(np.array([whole], dtype=np.uint64)))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out


def class_of(s: np.ndarray) -> int:
    """Signed 64-bit id of a shingle set: equal sets, equal ids."""
    total = np.array([s.sum(dtype=np.uint64), len(s)], dtype=np.uint64)
    return int((mix64(total[:1]) ^ mix64(total[1:] + np.uint64(7))).view(np.int64)[0])


class Bands:
    """Size bands and, per band, the number of blocks that pairs within the link bound need."""

    def __init__(self, link: int = LINK, full: int = FULL, ratio: float = BAND_RATIO):
        self.link, self.full, self.ratio = link, full, ratio
        self.edges = [1, 2]

    def band(self, n: int) -> int:
        while self.edges[-1] <= n:
            self.edges.append(max(self.edges[-1] + 1, int(np.ceil(self.edges[-1] * self.ratio))))
        return int(np.searchsorted(self.edges, n, side="right")) - 1

    def blocks(self, band: int) -> tuple[int, int]:
        """(blocks, spare): sets of the band that link share at least ``spare + 1`` equal blocks.

        With ``s = |A| + |B|`` a link needs ``|A xor B| <= (full - link) * s / (full + link)``.
        """
        most = self.edges[band + 1] - 1
        differ = (self.full - self.link) * 2 * most // (self.full + self.link)
        spare = (differ + 1) // 20 + 1 if differ else 0
        return differ + 1 + spare, spare

    def homes(self, n: int) -> list[tuple[int, bool]]:
        """Bands in which a set of n shingles is looked up: its own, and the next where a link may reach it."""
        own = self.band(n)
        self.band(self.edges[own + 1])
        up = self.full * n >= self.link * self.edges[own + 1]
        return [(own, False), (own + 1, True)] if up else [(own, False)]


def block_of(s: np.ndarray, blocks: int) -> np.ndarray:
    """Block of each hash; ascending, as the hashes are."""
    return ((s >> np.uint64(32)) * np.uint64(blocks)) >> np.uint64(32)


def block_keys(s: np.ndarray, folded: np.ndarray, band: int, blocks: int, spare: int) -> np.ndarray:
    """Keys of a set's sketch blocks in a band.

    A block's key is the XOR of its odd positions' hashes (``folded`` holds the
    running XOR): equal blocks, equal keys. Blocks without a shingle are left
    out unless there are more of them than ``spare``: two linked sets share at
    least ``spare + 1`` equal blocks, so if either leaves its empty ones out,
    one of the equal blocks has shingles, and if neither does, all are there.
    """
    cut = np.searchsorted(block_of(s, blocks), np.arange(blocks + 1, dtype=np.uint64))
    value = folded[cut[1:]] ^ folded[cut[:-1]]
    place = mix64(np.arange(blocks, dtype=np.uint64) + np.uint64((band + 1) << 32))
    keys = mix64(value ^ place)
    filled = cut[1:] > cut[:-1]
    return keys if blocks - int(filled.sum()) > spare else keys[filled]


def running_xor(s: np.ndarray) -> np.ndarray:
    out = np.zeros(len(s) + 1, dtype=np.uint64)
    np.bitwise_xor.accumulate(mix64(s), out=out[1:])
    return out


def parity_bits(s: np.ndarray, words: int | None = None) -> np.ndarray:
    """A dense parity sketch of ``words`` 64-bit words.

    By default about a bit a shingle: a power of two of words within ``SKETCH_WORDS``.
    """
    words = words or min(max(SKETCH_WORDS[0], 1 << max(0, (len(s) - 1) // 64).bit_length()), SKETCH_WORDS[1])
    at = (s % np.uint64(words * 64)).astype(np.int64)
    return np.packbits(np.bincount(at, minlength=words * 64) & 1, bitorder="little").view(np.uint64)


def folded(bits: np.ndarray, words: int) -> np.ndarray:
    """The sketch that ``parity_bits`` would make with fewer words: positions are hashes modulo the width."""
    return np.bitwise_xor.reduce(bits.reshape(-1, words), axis=0)


def distance(a: np.ndarray, b: np.ndarray) -> int:
    """Hamming distance of two sketches at the narrower one's width."""
    words = min(len(a), len(b))
    return int(np.bitwise_count(folded(a, words) ^ folded(b, words)).sum())
