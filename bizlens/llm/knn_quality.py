"""Operator 9: quality scores by nearest-neighbour voting in a latent semantic space.

Terms are hashed words and word shapes (symbols, capitals, digits, repetition
of the word before, exclamation). Document frequencies come from the whole
table. A bounded sample of labelled documents (``sample`` rows, those whose
ids hash lowest) gives the latent space, by subspace iteration on their
term matrix, and the labelled vectors. Both are broadcast: their size is
``sample`` and ``TERMS`` times ``rank`` floats, whatever the table's size.
Every document is projected, its cosines with all labelled vectors are
computed in blocks, and its nearest neighbours vote with a power of theirs.

Defined results: a null, empty or wordless text has no direction and scores
the sample's share of label 1, as does every text if no row is labelled (0.5).
Labels other than 0 and 1 are left out. Of equally near neighbours any may vote.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bizlens.llm.common import byte_rows, chunked, join_rows, word_table

WORD_TERMS, SHAPE_TERMS = 4096, 32
TERMS = WORD_TERMS + SHAPE_TERMS
SAMPLE, RANK, NEIGHBOURS, POWER = 4000, 64, 32, 8
_IS = np.zeros((4, 256), dtype=np.int64)            # symbol, upper case, digit, letter
_IS[0, [ord(c) for c in "#*$%&|<>"]] = 1
_IS[1, 65:91] = 1
_IS[2, 48:58] = 1
_IS[3, 65:91] = _IS[3, 97:123] = _IS[3, 128:] = 1


def term_counts(rows: list[bytes | None]) -> np.ndarray:
    """Dense counts (rows x TERMS), float32."""
    h, first, _, start, end = word_table(rows)
    buf, _ = join_rows(rows)
    row = np.repeat(np.arange(len(rows)), np.diff(first))
    has = []
    for kind in _IS:
        total = np.concatenate([[0], np.cumsum(kind[buf])])
        has.append(total[end] - total[start])
    symbol, upper, digit, letter = has
    again = np.zeros(len(h), dtype=bool)
    again[1:] = (h[1:] == h[:-1]) & (row[1:] == row[:-1])
    shape = ((symbol > 0) + 2 * ((upper > 1) & (upper == letter)) + 4 * (digit > 0) + 8 * again
             + 16 * (buf[np.maximum(end - 1, 0)] == 33))
    words = (h >> np.uint64(40)).astype(np.int64) % WORD_TERMS
    at = np.concatenate([row * TERMS + words, row * TERMS + WORD_TERMS + shape])
    return np.bincount(at, minlength=len(rows) * TERMS).reshape(len(rows), TERMS).astype(np.float32)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Words as damped tf-idf and shapes as shares, each block of length 1."""
    words = np.log1p(counts[:, :WORD_TERMS]) * idf[:WORD_TERMS]
    shapes = counts[:, WORD_TERMS:] * idf[WORD_TERMS:]
    return np.hstack([_unit(words), _unit(shapes)])


def _counted(texts: list[bytes | None]) -> Iterator[np.ndarray]:
    for i, j in chunked(texts, 1 << 19):
        for at in range(i, j, 256):
            yield term_counts(texts[at:min(at + 256, j)])


@dataclass
class Voters:
    idf: np.ndarray
    space: np.ndarray           # TERMS x rank
    vectors: np.ndarray         # labelled rows x rank, unit length
    labels: np.ndarray
    prior: float

    def score(self, texts: list[bytes | None], neighbours: int = NEIGHBOURS) -> np.ndarray:
        out = [np.zeros(0)]
        k = min(neighbours, len(self.labels))
        for counts in _counted(texts):
            if not k:
                out.append(np.full(len(counts), self.prior))
                continue
            at = weighted(counts, self.idf) @ self.space
            known = np.linalg.norm(at, axis=1) > 1e-9
            cosine = _unit(at) @ self.vectors.T
            near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
            weight = np.maximum(np.take_along_axis(cosine, near, axis=1), 1e-6).astype(np.float64) ** POWER
            vote = (weight * self.labels[near]).sum(axis=1) / weight.sum(axis=1)
            out.append(np.where(known, vote, self.prior))
        return np.clip(np.concatenate(out), 0.0, 1.0)


def document_frequencies(docs: DataFrame, text_col: str = "text") -> tuple[np.ndarray, int]:
    """Per term the documents that have it, over the whole table, and the documents."""
    def count(batches):
        sums, n = np.zeros(TERMS, np.int64), 0
        for batch in batches:
            for counts in _counted(byte_rows(batch.column(0))):
                sums += (counts > 0).sum(axis=0)
                n += len(counts)
        yield pa.RecordBatch.from_pydict({"term": pa.array(np.arange(-1, TERMS)), "n": pa.array(np.append(n, sums))})

    rows = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(count, "term long, n long")
    table = rows.groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(TERMS + 1, np.int64)
    out[table.column("term").to_numpy() + 1] = table.column("n").to_numpy()
    return out[1:], int(out[0])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "quality", sample: int = SAMPLE, rank: int = RANK) -> Voters:
    """``labels``: the rows to learn from. At most ``sample`` ids are used, each once.

    An id with several labels counts with the lowest, one with several texts with
    the lowest of these; so no id decides by being repeated, and no more than
    ``sample`` texts reach the driver. The voters' order is that of their ids.
    """
    frequency, n = document_frequencies(docs, text_col)
    idf = np.log((n + 1) / (frequency + 1)).astype(np.float32) + np.float32(0.1)
    chosen = (labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull())
              .groupBy(F.col(id_col).alias("_id")).agg(F.min(label_col).alias("label"))
              .orderBy(F.xxhash64("_id"), "_id").limit(sample))
    rows = docs.select(F.col(id_col).alias("_doc"), F.col(text_col).cast("string").alias("text")).join(
        F.broadcast(chosen), F.col("_doc") == F.col("_id"))
    table = (rows.groupBy("_id", "label").agg(F.min("text").alias("text")).toArrow().sort_by("_id"))
    label = table.column("label").to_numpy().astype(np.float64)
    if not len(label):
        return Voters(idf, np.zeros((TERMS, 0), np.float32), np.zeros((0, 0), np.float32), label, 0.5)
    x = np.zeros((len(label), TERMS), np.float32)
    at = 0
    for counts in _counted(byte_rows(table.column("text").combine_chunks())):
        x[at:at + len(counts)] = weighted(counts, idf)
        at += len(counts)
    space = latent_space(x, rank)
    return Voters(idf, space, _unit(x @ space), label, float(label.mean()))


def latent_space(x: np.ndarray, rank: int, rounds: int = 12) -> np.ndarray:
    """The leading right singular vectors of ``x`` (columns), by subspace iteration: no square matrix is made."""
    width = min(rank + 16, *x.shape)
    basis = np.linalg.qr(np.random.default_rng(0).normal(size=(x.shape[1], width)).astype(np.float32))[0]
    for _ in range(rounds):
        basis = np.linalg.qr(x.T @ (x @ basis))[0]
    seen = x @ basis
    value, turn = np.linalg.eigh((seen.T @ seen).astype(np.float64))
    top = np.argsort(-value)[:rank]
    top = top[value[top] > 1e-6 * max(value.max(), 1e-12)]
    return (basis @ turn[:, top]).astype(np.float32)


def scored(docs: DataFrame, voters: Voters, text_col: str = "text") -> Column:
    shared = docs.sparkSession.sparkContext.broadcast(voters)

    @F.arrow_udf("double")
    def run(text: pa.Array) -> pa.Array:
        return pa.array(shared.value.score(byte_rows(text)), pa.float64())

    return run(F.col(text_col).cast("string"))
