"""Pre-tokens of byte-level BPE texts, found in NumPy, and ids by distinct pre-token.

``public_tokenizers.PATTERN`` (a fixed value of the vocabularies) cuts a text
at changes between letters, numbers, white space and the rest, with three
rules: a plain space joins what follows it, white space before a word gives
only its last character away, and an apostrophe takes one of seven endings.
These are array operations on a chunk's code points. A chunk then only has to
encode the pre-tokens that its process hasn't met before.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np

from bizlens.llm.common import CHUNK_BYTES, chunked, span_hashes

SPACE, LETTER, NUMBER, OTHER = 0, 1, 2, 3
# Unicode's White_Space.
WHITE_SPACE = [9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F,
               0x205F, 0x3000]
# The pattern's endings.
ENDINGS = ["s", "t", "re", "ve", "m", "ll", "d"]
_CUT = re.compile(r"(?<=[^\s\x1c-\x1f\x85])[ \n]")
_KIND: list[np.ndarray] = []


def _kinds() -> np.ndarray:
    if not _KIND:
        first = {"L": LETTER, "N": NUMBER}
        kind = np.array([first.get(unicodedata.category(chr(i))[0], OTHER) for i in range(0x110000)], np.int8)
        kind[WHITE_SPACE] = SPACE
        _KIND.append(kind)
    return _KIND[0]


def starts_of(cp: np.ndarray, doc_start: np.ndarray) -> np.ndarray:
    """Positions where a pre-token begins. ``cp``: code points of texts set end to end."""
    n = len(cp)
    kind = _kinds()[cp]
    edge = np.zeros(n + 1, dtype=bool)
    edge[doc_start] = True
    new_doc = edge.copy()
    new_doc[n] = True
    edge[1:n] |= kind[1:] != kind[:-1]
    edge[[0, n]] = True
    runs = np.flatnonzero(edge)
    begin, end = runs[:-1], runs[1:]
    space = kind[begin] == SPACE
    start = np.zeros(n + 1, dtype=bool)
    start[begin[space]] = True
    start[end[space & ~new_doc[end]] - 1] = True
    word = begin[~space]
    joined = (word > 0) & ~new_doc[word] & (cp[word - 1] == 32)
    start[word[~joined]] = True
    mark = (cp[begin] == 39) & (end - begin == 1) & ~new_doc[end]
    mark[:-1] &= kind[begin[1:]] == LETTER
    mark &= start[begin]
    if mark.any():
        at = np.flatnonzero(mark)
        b, stop = begin[at], end[at + 1]
        for ending in ENDINGS:
            ok = b + len(ending) < stop
            for k, letter in enumerate(ending, 1):
                ok &= cp[np.minimum(b + k, n - 1)] == ord(letter)
            start[b[ok] + 1] = False
            start[b[ok] + 1 + len(ending)] = True
            b, stop = b[~ok], stop[~ok]
    return np.flatnonzero(start[:n])


def parts(rows: list[str | None], limit: int = CHUNK_BYTES) -> Iterator[tuple[int, str]]:
    """(row, text) with texts over ``limit`` cut where white space follows a word: pre-tokens stay whole."""
    for i, row in enumerate(rows):
        text, at = row or "", 0
        while len(text) - at > limit and (m := _CUT.search(text, at + limit)):
            yield i, text[at:m.start()]
            at = m.start()
        yield i, text[at:]


class Encoder:
    """Ids of whole texts; ``encode_new`` gives the ids of distinct pre-tokens (bytes)."""

    def __init__(self, encode_new: Callable[[list[bytes]], list], memo_limit: int = 2_000_000):
        self.encode_new, self.memo_limit = encode_new, memo_limit
        self.clear()

    def clear(self) -> None:
        self.known = np.zeros(0, dtype=np.uint64)
        self.row = np.zeros(0, dtype=np.int64)
        self.offset = np.zeros(1, dtype=np.int64)
        self.flat = np.zeros(0, dtype=np.uint32)

    def _learn(self, hashes: np.ndarray, words: list[bytes]) -> None:
        got = self.encode_new(words)
        sizes = np.fromiter(map(len, got), np.int64, len(got))
        ids = np.fromiter((x for ids in got for x in ids), np.uint32, int(sizes.sum()))
        rows = np.arange(len(self.offset) - 1, len(self.offset) - 1 + len(words))
        self.offset = np.concatenate([self.offset, self.offset[-1] + np.cumsum(sizes)])
        self.flat = np.concatenate([self.flat, ids])
        at = np.searchsorted(self.known, hashes)
        self.known, self.row = np.insert(self.known, at, hashes), np.insert(self.row, at, rows)

    def _encode_part(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts set end to end, and the number of each text's ids."""
        whole = "".join(texts)
        if not whole:
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        cp = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
        doc = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        start = starts_of(cp, doc[:-1][doc[:-1] < len(cp)])
        width = np.ones(len(cp), np.int64)
        for least in (0x80, 0x800, 0x10000):
            width += cp >= least
        byte = np.concatenate([[0], np.cumsum(width)])[np.append(start, len(cp))]
        raw = whole.encode()
        uniq, first, inverse = np.unique(span_hashes(np.frombuffer(raw, np.uint8), byte[:-1], byte[1:]),
                                         return_index=True, return_inverse=True)
        if len(self.known) > self.memo_limit:
            self.clear()
        at = np.minimum(np.searchsorted(self.known, uniq), max(len(self.known) - 1, 0))
        new = np.flatnonzero(self.known[at] != uniq) if len(self.known) else np.arange(len(uniq))
        if len(new):
            self._learn(uniq[new], [raw[a:b] for a, b in zip(byte[first[new]].tolist(),
                                                             byte[first[new] + 1].tolist())])
        rows = self.row[np.searchsorted(self.known, uniq)][inverse]
        sizes = self.offset[rows + 1] - self.offset[rows]
        ends = np.cumsum(sizes)
        ids = self.flat[np.repeat(self.offset[rows] - ends + sizes, sizes) + np.arange(int(ends[-1]))]
        ends = np.concatenate([[0], ends])
        return ids, np.diff(ends[np.searchsorted(start, doc)])

    def encode(self, rows: list[str | None]) -> Iterator[np.ndarray]:
        """Ids (uint32) of each row; null and empty texts have none."""
        pieces = list(parts(rows))
        row, held = 0, []
        for i, j in chunked([t.encode() for _, t in pieces]):
            ids, sizes = self._encode_part([t for _, t in pieces[i:j]])
            for (k, _), part in zip(pieces[i:j], np.split(ids, np.cumsum(sizes)[:-1])):
                if k != row:
                    yield np.concatenate(held)
                    row, held = k, []
                held.append(part)
        if pieces:
            yield np.concatenate(held)
