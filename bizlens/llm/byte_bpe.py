"""Operator 10: byte-level BPE encoding and decoding in two tiers.

A pre-token that is a vocabulary entry is found through a minimal perfect
hash over the entries (and compared with the entry's bytes). Any other
pre-token's bytes become a linked list, and a heap yields the next merge.
Each task does this once for a distinct pre-token; ids and decoded bytes of
whole texts are then array lookups (``pretokens.Encoder``).

Defined results: a null text is an empty one and has no ids; decoding gives
back the text's bytes. Rows keep their order and number.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bizlens.llm.common import span_hashes
from bizlens.llm.perfect_hash import PerfectHash
from bizlens.llm.pretokens import Encoder


def read_ranks(path: str) -> list[bytes]:
    """Vocabulary entries by rank from lines of base64 and rank."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    entries = [b""] * len(pairs)
    for entry, rank in pairs:
        entries[int(rank)] = base64.b64decode(entry)
    return entries


class ByteBPE:
    def __init__(self, entries: list[bytes]):
        self.entries = entries
        self.sizes = np.fromiter(map(len, entries), np.int64, len(entries))
        self.bytes = np.frombuffer(b"".join(entries), np.uint8)
        self.offset = np.concatenate([[0], np.cumsum(self.sizes)])
        keys = span_hashes(self.bytes, self.offset[:-1], self.offset[1:])
        self.hash = PerfectHash.build(keys)
        self.id_at = np.empty(len(entries), np.int64)
        self.id_at[self.hash.slots(keys)] = np.arange(len(entries))
        rank = {entry: i for i, entry in enumerate(entries)}
        self.byte_id = [rank[bytes([b])] for b in range(256)]
        self.merge: dict[int, int] = {}     # left id << 20 | right id -> id of the two together
        for entry, i in rank.items():
            for cut in range(1, len(entry)):
                left, right = rank.get(entry[:cut]), rank.get(entry[cut:])
                if left is not None and right is not None:
                    self.merge[left << 20 | right] = i
        self.encoder = Encoder(self.encode_words)

    def encode_words(self, words: list[bytes]) -> list[list[int]]:
        buf = np.frombuffer(b"".join(words), np.uint8)
        edge = np.concatenate([[0], np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))])
        slot = self.hash.slots(span_hashes(buf, edge[:-1], edge[1:]))
        whole = np.where(slot >= 0, self.id_at[slot], -1).tolist()
        entries, merged = self.entries, self.merged
        return [[i] if i >= 0 and entries[i] == word else merged(word) for i, word in zip(whole, words)]

    def merged(self, word: bytes) -> list[int]:
        """Lowest rank first, leftmost of equals: a heap of (rank, place) over linked bytes."""
        merge = self.merge
        byte_id = self.byte_id
        ids = [byte_id[b] for b in word]
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [r << 40 | i for i in range(n - 1) if (r := merge.get(ids[i] << 20 | ids[i + 1])) is not None]
        heapify(heap)
        while heap:
            top = heappop(heap)
            r, i = top >> 40, top & 0xFFFFFFFFFF
            j = after[i]
            if ids[i] < 0 or j >= n or merge.get(ids[i] << 20 | ids[j]) != r:
                continue                        # one of the two has been merged since
            ids[i], ids[j] = r, -1
            j = after[i] = after[j]
            if j < n:
                before[j] = i
                if (x := merge.get(r << 20 | ids[j])) is not None:
                    heappush(heap, x << 40 | i)
            j = before[i]
            if j >= 0 and (x := merge.get(ids[j] << 20 | r)) is not None:
                heappush(heap, x << 40 | j)
        return [x for x in ids if x >= 0]

    def encode(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        return self.encoder.encode(texts)

    def decode(self, ids: np.ndarray) -> bytes:
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        return self.bytes[np.repeat(self.offset[ids] - ends + sizes, sizes) + np.arange(total)].tobytes()


_LOADED: dict[str, ByteBPE] = {}


def load_bpe(path: str) -> ByteBPE:
    if path not in _LOADED:
        _LOADED[path] = ByteBPE(read_ranks(path))
    return _LOADED[path]


def encoded(docs: DataFrame, ranks_path: str, id_col: str = "doc_id", text_col: str = "text",
            keep_ids: bool = True) -> DataFrame:
    """``doc_id, n_tokens, ids (little-endian uint32 bytes), ids_sha256, decoded_sha256`` of every row.

    ``ranks_path`` names the vocabulary file, which every executor must have there.
    """
    def run(batches):
        bpe = load_bpe(ranks_path)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                raw, count, digest, decoded = [], [], [], []
                for ids in bpe.encode(part.column("text").to_pylist()):
                    data = ids.astype("<u4").tobytes()
                    raw.append(data if keep_ids else b"")
                    count.append(len(ids))
                    digest.append(hashlib.sha256(data).hexdigest())
                    decoded.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
                cols = {"doc_id": part.column("id"), "n_tokens": pa.array(count, pa.int64()),
                        "ids": pa.array(raw, pa.binary()), "ids_sha256": pa.array(digest, pa.string()),
                        "decoded_sha256": pa.array(decoded, pa.string())}
                yield pa.RecordBatch.from_pydict({k: v for k, v in cols.items() if keep_ids or k != "ids"})

    schema = "doc_id long, n_tokens long, " + "ids binary, " * keep_ids + "ids_sha256 string, decoded_sha256 string"
    return docs.select(F.col(id_col).cast("long").alias("id"),
                       F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)
