"""Operator 1: token ids in binary shards with a perfect-hash index by document key.

``write_store`` range-partitions documents by id; each task appends the ids of
its documents, an end id after each, to one shard file of raw little-endian
ids (16 bits where the vocabulary allows it, else 32). Per document it returns
where the ids lie. From these rows the index is built, in buckets of keys by
hash: a minimal perfect hash gives a key's slot, and the slot's arrays hold
a 32-bit fingerprint, the shard, the offset in ids and the number of ids.
``locate`` looks keys up; ``read_ids`` reads the files.

``stored_documents`` gives the library's ids of each whole text, so the file's
added tokens are found where their strings stand in a text. For ``write_store``
they are ordinary text unless ``added_tokens`` is set.

Defined results: a null or empty text is stored as the end id alone. Of rows
with the same id, the first (by text hash) is the one the key finds; the
others, and rows without an id, which come first, lie in the shards too and
are listed in ``unkeyed``. A key that isn't stored is found with a chance of 2**-32.
"""

from __future__ import annotations

import functools
import json
import os
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bizlens.llm.common import mix64, saved, shared_path
from bizlens.llm.files import Replacing, located
from bizlens.llm.perfect_hash import PerfectHash, fingerprint
from bizlens.llm.pretokens import Encoder

KEYS_PER_BUCKET = 1 << 20
_ENCODERS: dict[str, Encoder] = {}


def tokenizer_encoder(path: str) -> Encoder:
    """Ids of byte-level BPE pre-tokens by the tokenizers library, each distinct one once per process."""
    if path not in _ENCODERS:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"      # Spark's tasks are the parallelism
        from tokenizers import Tokenizer
        tokenizer = Tokenizer.from_file(path)
        tokenizer.encode_special_tokens = True              # their strings in a text are ordinary text

        def encode_new(words: list[bytes]) -> list[list[int]]:
            got = tokenizer.encode_batch_fast([w.decode() for w in words], add_special_tokens=False)
            return [x.ids for x in got]

        _ENCODERS[path] = Encoder(encode_new)
    return _ENCODERS[path]


class WholeTexts:
    """Ids of whole texts as the library gives them without special tokens of its own.

    Texts are cut at the file's added tokens and encoded by pre-tokens between
    them. Where such tokens also take white space, only whole words or
    normalized text, the library encodes the texts that hold one.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.encoder = tokenizer_encoder(path)
        self.library = Tokenizer.from_file(path)
        added = self.library.get_added_tokens_decoder()
        self.ids = {t.content: np.array([i], np.uint32) for i, t in added.items()}
        self.plain = not any(t.lstrip or t.rstrip or t.single_word or t.normalized for t in added.values())
        longest_first = sorted(self.ids, key=len, reverse=True)
        self.find = re.compile("(" + "|".join(map(re.escape, longest_first)) + ")") if added else None

    def encode(self, rows: list[str | None]) -> Iterator[np.ndarray]:
        if not self.find:
            yield from self.encoder.encode(rows)
            return
        cut = [self.find.split(row or "") for row in rows]       # text, token, text, ..., text
        between = self.encoder.encode([t for c in cut if self.plain or len(c) == 1 for t in c[::2]])
        for row, c in zip(rows, cut):
            if len(c) == 1:
                yield next(between)
            elif self.plain:
                ids = [next(between)]
                for token in c[1::2]:
                    ids += [self.ids[token], next(between)]
                yield np.concatenate(ids)
            else:
                yield np.array(self.library.encode(row, add_special_tokens=False).ids, np.uint32)


@functools.cache
def whole_texts(path: str) -> WholeTexts:
    return WholeTexts(path)


def _hashed(keys: np.ndarray) -> np.ndarray:
    return mix64(keys.astype(np.int64).view(np.uint64))


def _bucket(buckets: int):
    return F.expr(f"pmod(xxhash64(doc_id), {buckets})")


def _write(folder: str, tokenizer: str, end_id: int, dtype: str, added_tokens: bool):
    def run(batches):
        shard = TaskContext.get().partitionId()
        encoder = whole_texts(tokenizer) if added_tokens else tokenizer_encoder(tokenizer)
        offset, last = 0, object()
        out = None
        try:
            for batch in batches:
                if out is None:
                    file = Replacing(f"{folder}/shard-{shard:06d}.ids")
                    out = file.__enter__()
                for at in range(0, batch.num_rows, 512):
                    part = batch.slice(at, 512)
                    ids, where = part.column("id").to_pylist(), []
                    for key, row in zip(ids, encoder.encode(part.column("text").to_pylist())):
                        out.write(np.append(row, end_id).astype(dtype).tobytes())
                        where.append((offset, len(row) + 1, key is not None and key != last))
                        offset += len(row) + 1
                        last = key
                    o, n, first = zip(*where)
                    yield pa.RecordBatch.from_pydict({
                        "doc_id": part.column("id"), "shard": pa.array([shard] * len(o), pa.int32()),
                        "offset": pa.array(o, pa.int64()), "n_tokens": pa.array(n, pa.int64()),
                        "keyed": pa.array(first, pa.bool_())})
        except BaseException as e:
            if out is not None:
                file.__exit__(type(e), e, None)
            raise
        if out is not None:
            file.__exit__(None, None, None)
    return run


def _index(batches):
    """One row per bucket from its sorted rows."""
    held: list[pa.RecordBatch] = []

    def made():
        t = pa.Table.from_batches(held)
        keys = _hashed(t.column("doc_id").to_numpy())
        ph = PerfectHash.build(keys)
        order = np.empty(len(keys), np.int64)
        order[ph.slots(keys)] = np.arange(len(keys))
        cols = {"bucket": [t.column("bucket")[0].as_py()], "hash": [ph.to_bytes()],
                "prints": [fingerprint(keys)[order].tobytes()]}
        for name in ("shard", "offset", "n_tokens"):
            cols[name] = [t.column(name).to_numpy()[order].astype(np.int64).tobytes()]
        return pa.RecordBatch.from_pydict(cols)

    for batch in batches:
        if not batch.num_rows:
            continue
        b = batch.column("bucket").to_numpy()
        cut = [0, *(np.flatnonzero(b[1:] != b[:-1]) + 1).tolist(), len(b)]
        for i, j in zip(cut[:-1], cut[1:]):
            if held and held[0].column("bucket")[0].as_py() != b[i]:
                yield made()
                held.clear()
            held.append(batch.slice(i, j - i))
    if held:
        yield made()


def _find(keys: pa.Table, index: pa.Table) -> pa.Table:
    if not keys.num_rows or not index.num_rows:
        return pa.table({"doc_id": pa.array([], pa.int64()), "shard": pa.array([], pa.int32()),
                         "offset": pa.array([], pa.int64()), "n_tokens": pa.array([], pa.int64())})
    row = index.to_pylist()[0]
    ids = keys.column("doc_id").to_numpy()
    hashed = _hashed(ids)
    slot = PerfectHash.from_bytes(row["hash"]).slots(hashed)
    hit = slot >= 0
    hit[hit] = np.frombuffer(row["prints"], np.uint32)[slot[hit]] == fingerprint(hashed[hit])
    at = slot[hit]
    value = {x: np.frombuffer(row[x], np.int64)[at] for x in ("shard", "offset", "n_tokens")}
    return pa.table({"doc_id": pa.array(ids[hit], pa.int64()), "shard": pa.array(value["shard"], pa.int32()),
                     "offset": pa.array(value["offset"], pa.int64()),
                     "n_tokens": pa.array(value["n_tokens"], pa.int64())})


@dataclass
class TokenStore:
    folder: str
    dtype: str
    buckets: int
    index: DataFrame        # bucket, hash, prints, shard, offset, n_tokens
    unkeyed: DataFrame      # doc_id, shard, offset, n_tokens
    bases: DataFrame        # shard, base: ids in the shards before

    def locate(self, keys: DataFrame) -> DataFrame:
        """``doc_id, shard, offset, n_tokens`` of the distinct keys in column doc_id that are stored."""
        keys = keys.select("doc_id").where("doc_id is not null").distinct()
        schema = "doc_id long, shard int, offset long, n_tokens long"
        return (keys.withColumn("bucket", _bucket(self.buckets)).groupBy("bucket")
                .cogroup(self.index.groupBy("bucket")).applyInArrow(_find, schema))

    def read_ids(self, located_rows: DataFrame, keep_ids: bool = True) -> DataFrame:
        """``doc_id, start, n_tokens, ids_crc32 (, ids)`` of rows as ``locate`` gives them, from the files."""
        folder, dtype = self.folder, np.dtype(self.dtype)

        def run(batches):
            shard, file = None, None
            for batch in batches:
                cols = [batch.column(x).to_pylist() for x in ("shard", "offset", "n_tokens")]
                ids, crc = [], []
                for s, offset, n in zip(*cols):
                    if s != shard:
                        if file:
                            file.close()
                        fs_, path = located(f"{folder}/shard-{s:06d}.ids")
                        shard, file, buffer, begin = s, fs_.open_input_file(path), b"", 0
                    a, b = offset * dtype.itemsize, (offset + n) * dtype.itemsize
                    if a < begin or b > begin + len(buffer):
                        file.seek(a)
                        begin, buffer = a, file.read(max(b - a, 1 << 22))
                    data = np.frombuffer(buffer, dtype, n, a - begin).astype("<u4").tobytes()
                    crc.append(zlib.crc32(data))
                    ids.append(data if keep_ids else b"")
                out = {"doc_id": batch.column("doc_id"), "start": batch.column("start"),
                       "n_tokens": batch.column("n_tokens"), "ids_crc32": pa.array(crc, pa.int64())}
                yield pa.RecordBatch.from_pydict(out | ({"ids": pa.array(ids, pa.binary())} if keep_ids else {}))
            if file:
                file.close()

        schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * keep_ids
        block = F.floor(F.col("offset") / (1 << 24))        # a large shard is read by several tasks
        return (located_rows.join(self.bases, "shard")
                .select("doc_id", (F.col("base") + F.col("offset")).alias("start"), "n_tokens", "shard", "offset")
                .repartition("shard", block).sortWithinPartitions("shard", "offset").mapInArrow(run, schema))


def write_store(docs: DataFrame, tokenizer: str, end_id: int, vocab_size: int, id_col: str = "doc_id",
                text_col: str = "text", folder: str | None = None, added_tokens: bool = False) -> TokenStore:
    """Write shards and index in ascending id order. ``tokenizer``: a byte-level BPE file of the tokenizers library."""
    spark: SparkSession = docs.sparkSession
    folder = folder or shared_path(spark, "tokens")
    dtype = "<u2" if max(vocab_size, end_id) <= 1 << 16 else "<u4"
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"))
    entries = saved(rows.repartitionByRange("id").sortWithinPartitions("id", F.xxhash64("text"))
                    .mapInArrow(_write(folder, tokenizer, end_id, dtype, added_tokens),
                                "doc_id long, shard int, offset long, n_tokens long, keyed boolean"), "entries")
    shards = sorted(entries.groupBy("shard").agg(F.sum("n_tokens").alias("n"),
                                                 F.sum(F.col("keyed").cast("long")).alias("k")).collect())
    buckets = max(1, -(-sum(r.k for r in shards) // KEYS_PER_BUCKET))
    bases, base = [], 0
    for r in shards:            # one row per shard file
        bases.append((r.shard, base))
        base += r.n
    with Replacing(f"{folder}/manifest.json") as out:
        out.write(json.dumps({"dtype": dtype, "end_id": end_id, "ids": base, "buckets": buckets,
                              "shards": bases}).encode())
    index = saved(entries.where("keyed").select("doc_id", "shard", "offset", "n_tokens")
                  .withColumn("bucket", _bucket(buckets)).repartition("bucket").sortWithinPartitions("bucket")
                  .mapInArrow(_index, "bucket long, hash binary, prints binary, shard binary, offset binary, "
                                      "n_tokens binary"), "index")
    return TokenStore(folder, dtype, buckets, index,
                      entries.where("not keyed").select("doc_id", "shard", "offset", "n_tokens"),
                      spark.createDataFrame(bases, "shard int, base long"))


def stored_documents(docs: DataFrame, tokenizer: str, end_id: int, vocab_size: int) -> DataFrame:
    """Write the store, find every document's key through the index, and read its ids back."""
    store = write_store(docs, tokenizer, end_id, vocab_size, added_tokens=True)
    found = store.locate(docs.select(F.col("doc_id").cast("long").alias("doc_id")))
    return store.read_ids(found.unionByName(store.unkeyed), keep_ids=False)
