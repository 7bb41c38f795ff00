"""Helpers shared by the training-data operators.

Text reaches Python only as Arrow batches. Words, their 64-bit hashes and
their documents are computed for a megabyte of text at a time with NumPy, so
no Python object exists per word and memory does not grow with a partition.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bizlens.session import ensure_checkpoint_dir
from bizlens.sources.tables import read_table

CHUNK_BYTES = 1 << 20
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"     # Spark's setting: a query's shuffle files go at its end


# ---------------------------------------------------------------- Spark side


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents", list(columns) or None)


def id_remainder(doc_id: Column, m: int) -> Column:
    """``crc32(doc_id as text) mod m``; -1 for a null id, which so is in no fold."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % F.lit(m), F.lit(-1).cast("long"))


def small_table(spark: SparkSession, columns: dict[str, pa.Array]) -> DataFrame:
    """A few rows from the driver, by Arrow: no Python worker takes part."""
    return spark.createDataFrame(pa.table(columns))


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path inside the shared folder named by ``spark.checkpoint.dir``."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm/{name}-{uuid.uuid4().hex[:12]}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here, and so does its shuffle files' use."""
    spark = df.sparkSession
    path, before = shared_path(spark, name), spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")         # else they stay until the driver happens to collect its garbage
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    table = spark.read.schema(df.schema).parquet(path)
    table.saved_path = path
    return table


def drop_saved(*tables: DataFrame) -> None:
    """Remove tables written by ``saved`` that nothing still to be computed reads."""
    for table in tables:
        sc = table.sparkSession.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(table.saved_path)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


# ---------------------------------------------------------------- NumPy side


def byte_rows(column: pa.Array) -> list[bytes | None]:
    """UTF-8 bytes of a string column; null stays None."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return column.cast(kind).to_pylist()


def chunked(rows: list[bytes | None], limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes; a longer row is a range of its own."""
    start = size = 0
    for i, row in enumerate(rows):
        n = len(row) + 1 if row else 1
        if i > start and size + n > limit:
            yield start, i
            start, size = i, 0
        size += n
    if rows:
        yield start, len(rows)


_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15 | 1
_POWERS: dict[str, np.ndarray] = {}


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser (public splitmix64 constants)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "up" not in _POWERS or len(_POWERS["up"]) < n:
        size = max(n, CHUNK_BYTES + 4096)
        for key, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            step = np.full(size, base, dtype=np.uint64)
            step[0] = 1
            _POWERS[key] = np.multiply.accumulate(step)
    return _POWERS["up"], _POWERS["down"]


def span_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of ``buf[start:end]`` for many spans at once.

    A polynomial hash with an odd base is a difference of prefix sums times
    a power of the base's inverse, all modulo 2**64.
    """
    up, down = _powers(len(buf) + 1)
    total = np.zeros(len(buf) + 1, dtype=np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * up[:len(buf)], out=total[1:])
    h = (total[end] - total[start]) * down[start]
    return mix64(h ^ ((end - start).astype(np.uint64) << np.uint64(48)))


def join_rows(rows: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Rows joined by line feeds, and each row's first byte (with the end at last)."""
    buf = np.frombuffer(b"\n".join([r or b"" for r in rows]) + b"\n", dtype=np.uint8)
    starts = np.zeros(len(rows) + 1, dtype=np.int64)
    np.cumsum([len(r or b"") + 1 for r in rows], out=starts[1:])
    return buf, starts


def word_spans(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words ``[^\\x20\\x09-\\x0D]+`` of a buffer that ends in white space."""
    word = np.empty(len(buf) + 1, dtype=np.int8)
    word[0] = 0
    np.logical_not(_SPACE[buf], out=word[1:].view(bool))
    edge = np.diff(word)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def pieces(buf: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of about ``limit`` bytes that end after white space."""
    at = 0
    while at < len(buf):
        end = min(len(buf), at + limit)
        while end < len(buf):
            gap = np.flatnonzero(_SPACE[buf[end - 1:end - 1 + limit]])
            end = end + int(gap[0]) if len(gap) else min(len(buf), end + limit)
            if len(gap):
                break
        yield at, end
        at = end


def word_table(rows: list[bytes | None], lower: bool = True):
    """Word hashes of several rows, in order, and each row's first word (with the end at last).

    Also returns the buffer and the words' spans in it.
    """
    raw, row_start = join_rows(rows)
    buf = _LOWER[raw] if lower else raw
    hashes, starts, ends = [], [], []
    for a, b in pieces(buf):
        s, e = word_spans(buf[a:b])
        hashes.append(span_hashes(buf[a:b], s, e))
        starts.append(s + a)
        ends.append(e + a)
    s = np.concatenate(starts)
    first = np.searchsorted(s, row_start)
    return np.concatenate(hashes), first, buf, s, np.concatenate(ends)
