"""Operator 4: language identification by multinomial naive Bayes over hashed character n-grams.

Training counts n-grams of one to three characters of the lower-cased text in
hash buckets, per language: each task adds up its own, one aggregation adds
the tasks'. The smoothed log-probability matrix (buckets x languages) is
broadcast; its size is fixed by the number of buckets and the label set.
Scoring looks up a batch's n-grams in the matrix and sums by document. The
score is the predicted language's posterior probability.

Defined results: a text that is null or has no letter is ``und`` with score 0.
Training leaves out rows without text or language; with no training rows at
all every text is ``und``. Ties go to the language that sorts first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bizlens.llm.common import CHUNK_BYTES

BUCKETS, ORDERS = 1 << 14, 3
UNKNOWN = "und"
MOST_LANGUAGES = 2000           # label sets beyond this are an error: the matrix would pass 125 MB
_STEP = np.uint32(0x01000193)


def ngram_buckets(texts: list[str], buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bucket, row) of every n-gram of 1 to ``ORDERS`` characters, about a megabyte of text at a time."""
    for begin, part in _slices(texts):
        lengths = np.fromiter((len(t) for t in part), np.int64, len(part))
        cp = np.frombuffer("".join(part).encode("utf-32-le"), np.uint32)
        row = np.repeat(np.arange(begin, begin + len(part)), lengths)
        h = np.zeros(len(cp), np.uint32)
        for order in range(1, ORDERS + 1):
            n = len(cp) - order + 1
            if n <= 0:
                break
            h = (h[:n] * _STEP) ^ (cp[order - 1:] * np.uint32(0x9E3779B1))
            inside = row[:n] == row[order - 1:]
            mixed = h ^ (h >> np.uint32(15))
            mixed = mixed * np.uint32(0x85EBCA6B) + np.uint32(order)
            yield ((mixed >> np.uint32(16)) % np.uint32(buckets))[inside], row[:n][inside]


def _slices(texts: list[str]) -> Iterator[tuple[int, list[str]]]:
    """Runs of rows of about a megabyte; a longer text comes in parts, whose n-grams don't cross the cuts."""
    begin, size, held = 0, 0, []
    for i, t in enumerate(texts):
        if held and size + len(t) > CHUNK_BYTES:
            yield begin, held
            begin, size, held = i, 0, []
        if len(t) > CHUNK_BYTES:
            for at in range(0, len(t), CHUNK_BYTES):
                yield i, [t[at:at + CHUNK_BYTES]]
            begin = i + 1
            continue
        held.append(t)
        size += len(t)
    if held:
        yield begin, held


def _has_letter(t: str | None) -> bool:
    return bool(t) and any(map(str.isalpha, t))


class LanguageModel:
    """Languages in order, and log probabilities (buckets x languages) with the priors."""

    def __init__(self, languages: list[str], logp: np.ndarray, prior: np.ndarray):
        self.languages, self.logp, self.prior = languages, logp, prior

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        n, k = len(texts), len(self.languages)
        known = np.array([_has_letter(t) for t in texts], dtype=bool)
        if not k:
            return [UNKNOWN] * n, np.zeros(n)
        total = np.zeros((n, k)) + self.prior
        lower = [t.lower() if ok else "" for t, ok in zip(texts, known)]
        for bucket, row in ngram_buckets(lower, len(self.logp)):
            # sparse batch: one row per document, its n-grams' columns summed against the matrix
            cut = np.flatnonzero(np.r_[True, row[1:] != row[:-1]]) if len(row) else []
            if len(cut):
                total[row[cut]] += np.add.reduceat(self.logp[bucket], cut, axis=0)
        best = total.argmax(axis=1)
        p = np.exp(total - total.max(axis=1, keepdims=True))
        score = np.where(known, 1 / p.sum(axis=1), 0.0)
        return [self.languages[b] if ok else UNKNOWN for b, ok in zip(best, known)], score


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", buckets: int = BUCKETS) -> LanguageModel:
    """Fit on every row that has text and a language."""
    def count(batches):
        sums: dict[str, np.ndarray] = {}
        rows: dict[str, int] = {}
        for batch in batches:
            langs = np.array(batch.column("lang").to_pylist(), dtype=object)
            texts = batch.column("text").to_pylist()
            for lang in sorted(set(langs)):
                mine = [texts[i].lower() for i in np.flatnonzero(langs == lang)]
                have = sums.setdefault(lang, np.zeros(buckets, np.int64))
                for bucket, _ in ngram_buckets(mine, buckets):
                    have += np.bincount(bucket, minlength=buckets)
                rows[lang] = rows.get(lang, 0) + len(mine)
        for lang, have in sums.items():
            used = np.flatnonzero(have)
            yield pa.RecordBatch.from_pydict({
                "lang": pa.array([lang] * (len(used) + 1)), "bucket": pa.array(np.append(used, -1), pa.int64()),
                "n": pa.array(np.append(have[used], rows[lang]), pa.int64())})

    rows = docs.select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).where(
        "text is not null and lang is not null")
    counts = rows.mapInArrow(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    languages = sorted(r.lang for r in counts.select("lang").distinct().limit(MOST_LANGUAGES + 1).collect())
    if len(languages) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    table = counts.toArrow()
    n = np.zeros((buckets + 1, len(languages)))
    column = np.searchsorted(languages, table.column("lang").to_pylist()) if table.num_rows else []
    n[table.column("bucket").to_numpy(), column] = table.column("n").to_numpy()      # -1, the last: documents
    grams, documents = n[:buckets], n[buckets]
    with np.errstate(divide="ignore"):
        logp = np.log((grams + 0.5) / (grams.sum(axis=0) + 0.5 * buckets))
        prior = np.log(documents / max(documents.sum(), 1))
    return LanguageModel(languages, logp.astype(np.float32), prior)


def predicted(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> Column:
    """A struct column ``lang_pred, score`` for the rows of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast((model.languages, model.logp, model.prior))

    @F.pandas_udf("lang_pred string, score double")
    def run(texts):
        import pandas as pd
        lang, score = LanguageModel(*shared.value).predict([t if isinstance(t, str) else None for t in texts])
        return pd.DataFrame({"lang_pred": lang, "score": score})

    return run(F.col(text_col).cast("string"))
