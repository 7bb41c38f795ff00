"""Language ID (4), LM scores (6) and quality votes (9): held-out results and exact parts."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from bizlens.llm import knn_quality, language_id, maxent_lm
from bizlens.llm.common import id_remainder
from bizlens.llm.queries import QUERIES
from tests.conftest import SF001, SF01
from tests.llm.conftest import hard_rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})


def test_language_id_on_held_out_documents(spark):
    got = QUERIES["op4_language_id"](spark, SF01)
    assert got.dtypes == [("doc_id", "bigint"), ("held_out", "boolean"), ("lang_pred", "string"), ("score", "double")]
    docs = spark.read.parquet(f"{SF01}/documents.parquet")
    rows = got.join(docs, "doc_id").select("doc_id", "held_out", "lang_pred", "score", "lang").collect()
    assert len(rows) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert np.mean([r.lang == r.lang_pred for r in held]) > 0.98


def test_language_id_edges(spark, hard, empty):
    model = language_id.train(hard)
    rows = hard.select("doc_id", "text", language_id.predicted(hard, model).alias("p")).collect()
    for r in rows:
        if not r.text or not any(map(str.isalpha, r.text)):
            assert (r.p.lang_pred, r.p.score) == ("und", 0.0)
        else:
            assert r.p.lang_pred in ("en", "fr") and 0 <= r.p.score <= 1
    none = language_id.train(empty)
    assert none.predict(["abc", None])[0] == ["und", "und"]
    assert empty.select(language_id.predicted(empty, model)).count() == 0


def test_scores_do_not_depend_on_batches(spark):
    model = language_id.train(spark.read.parquet(f"{SF001}/documents.parquet"))
    texts = [r.text for r in spark.read.parquet(f"{SF001}/documents.parquet").limit(50).collect()]
    whole = model.predict(texts)
    single = [model.predict([t]) for t in texts]
    assert whole[0] == [s[0][0] for s in single]
    assert np.allclose(whole[1], [s[1][0] for s in single])


def test_texts_of_over_a_megabyte_keep_their_rows():
    rng = np.random.default_rng(3)
    model = language_id.LanguageModel(["a", "b", "c"], rng.normal(size=(64, 3)).astype(np.float32), np.zeros(3))
    long = "ab cd efgh " * 100_000
    for texts in (["", long, "short"], [long, None, long, "short"], [None, "12", long, "short", "other", long, "", "end"]):
        lang, score = model.predict(texts)
        single = [model.predict([t]) for t in texts]
        assert lang == [s[0][0] for s in single]
        assert np.allclose(score, [s[1][0] for s in single])


def unigram(rows, folds=5, out=1):
    tokens = [WORD.findall((r[1] or "").translate(LOWER)) + [None] for r in rows]
    train = [r[0] is None or zlib.crc32(str(r[0]).encode()) % folds != out for r in rows]
    c = Counter(x for t, ok in zip(tokens, train) if ok for x in t)
    n, v = sum(c.values()), len(c)
    return [(r[0], r[0] is not None and not ok, len(t), sum(c[x] > 0 for x in t), n,
             round(sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in t), 5)) for r, t, ok in zip(rows, tokens, train)]


@pytest.mark.parametrize("block", [8 << 20, 2000])
def test_base_scores_equal_brute_force(spark, hard, empty, monkeypatch, block):
    monkeypatch.setattr(maxent_lm, "BLOCK_BYTES", block)
    monkeypatch.setattr(maxent_lm, "RANGE_ENTRIES", 1 << 21 if block > 2000 else 5000)
    got = maxent_lm.scored_texts(hard.repartition(3)).collect()
    want = unigram(hard_rows())
    assert sorted(str((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5))) for r in got) == sorted(map(str, want))
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)
    assert maxent_lm.scored_texts(empty).count() == 0


def test_model_beats_the_unigram_on_held_out_texts(spark):
    r = QUERIES["op6_maxent_lm"](spark, SF01).where("held_out").agg(F.sum("score"), F.sum("base_score"), F.sum("n_tokens")).first()
    assert r[0] / r[2] > r[1] / r[2] + 0.05


def test_class_probabilities_sum_to_one():
    r = np.random.default_rng(1)
    w = r.normal(size=(maxent_lm.ROWS, maxent_lm.CLASSES)).astype(np.float32)
    at = maxent_lm.features(r.integers(0, 2**63, 500).astype(np.uint64), r.integers(0, 31, 500).astype(np.uint8), np.array([200, 300]))
    assert np.allclose(np.exp(maxent_lm.class_log_probabilities(w, at)).sum(axis=1), 1, atol=1e-5)


def test_a_word_of_its_class_depends_on_the_context(spark):
    rows = [(i, f"{'left bread' if i % 2 else 'right knead'} end") for i in range(4000)]     # one class: both end in "ead"
    tries = ["left bread end", "left knead end", "right knead end", "right bread end"]
    out = [i for i in range(10_000, 10_100) if zlib.crc32(str(i).encode()) % 5 == 1][:4]
    docs = spark.createDataFrame(rows + list(zip(out, tries)), "doc_id long, text string").repartition(4)
    score = {r.doc_id: r.score for r in maxent_lm.scored_texts(docs).where("held_out").collect()}
    good, swapped, good2, swapped2 = (score[i] for i in out)
    assert good > swapped + 0.3 and good2 > swapped2 + 0.3


def test_sub_class_probabilities_sum_to_one():
    r = np.random.default_rng(2)
    w = r.normal(size=(maxent_lm.ALL_ROWS, maxent_lm.SUBS)).astype(np.float32)
    kind = r.integers(0, 31, 500).astype(np.uint8)
    at = maxent_lm.sub_features(maxent_lm.features(r.integers(0, 2**63, 500).astype(np.uint64), kind, np.array([500])), kind)
    assert at.min() >= maxent_lm.ROWS and maxent_lm.ALL_ROWS <= 1 << 16
    assert np.allclose(np.exp(maxent_lm.class_log_probabilities(w, at)).sum(axis=1), 1, atol=1e-5)


def test_context_stays_within_a_text():
    word, kind = np.arange(6, dtype=np.uint64), np.zeros(6, np.uint8)
    at = maxent_lm.features(word, kind, np.array([3, 3]))
    assert at[0, 0] == at[0, 3] and at[1, 1] == at[1, 4]


def test_quality_votes_on_held_out_documents(spark):
    got = QUERIES["op9_knn_quality"](spark, SF01)
    assert got.dtypes == [("doc_id", "bigint"), ("held_out", "boolean"), ("score", "double"), ("predicted", "int")]
    rows = got.join(spark.read.parquet(f"{SF01}/labels.parquet"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert np.mean([r.predicted == r.quality for r in held]) > 0.95
    assert all(r.predicted == int(r.score >= 0.3) and 0 <= r.score <= 1 for r in rows)


def test_quality_edges(spark, hard, empty):
    labels = spark.createDataFrame([(1, 1), (3, 1), (14, 0), (9, None), (77, 1), (None, 1), (14, 5)], "doc_id long, quality int")
    voters = knn_quality.fit(hard, labels)
    rows = hard.select("doc_id", "text", knn_quality.scored(hard, voters).alias("s")).collect()
    assert all(0 <= r.s <= 1 for r in rows) and len(rows) == hard.count()
    blank = [r.s for r in rows if not (r.text or "").strip()]
    assert blank and all(s == pytest.approx(2 / 3) for s in blank)
    none = knn_quality.fit(hard, labels.limit(0))
    assert {r[0] for r in hard.select(knn_quality.scored(hard, none)).collect()} == {0.5}
    assert empty.select(knn_quality.scored(empty, voters)).count() == 0
    assert knn_quality.fit(empty, labels).prior == 0.5


def test_remainder_of_ids(spark):
    df = spark.createDataFrame([(5,), (None,)], "doc_id long").select(id_remainder(F.col("doc_id"), 4).alias("r"))
    assert [r.r for r in df.collect()] == [zlib.crc32(b"5") % 4, -1]


def naive_update(weights, squares, at, kind):
    """``maxent_lm.update`` a token at a time."""
    grads = {}
    for t, k in enumerate(kind.tolist()):
        x = sum(weights[r].astype(np.float64) for r in at[:, t])
        p = np.exp(x - x.max())
        g = p / p.sum()
        g[k] -= 1
        for r in at[:, t].tolist():
            grads[r] = grads.get(r, 0) + g
    for r, g in grads.items():
        squares[r] += (g * g).mean()
        weights[r] -= (maxent_lm.RATE * g / math.sqrt(squares[r] + 1e-6)).astype(np.float32)


def test_score_is_that_of_a_model_written_out_token_by_token(spark, monkeypatch):
    """One block, one task, one round: features, updates, shares and sums in plain Python."""
    m = maxent_lm
    monkeypatch.setattr(m, "ROUNDS", 1)
    monkeypatch.setattr(m, "BATCH", 64)
    r = __import__("random").Random(2)
    rows = [(i, " ".join(r.choice(["the", "cat", "sat", "on", "a", "mat", "x1", "läuft", "END"]) for _ in range(r.randint(0, 12))))
            for i in range(60)]
    got = {x.doc_id: x.score for x in m.scored_texts(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()}
    texts = [t.translate(LOWER).encode() for _, t in rows]
    h, first, size, tail = m._words(texts)
    n = np.diff(first)
    word = np.insert(h, first[1:], m.END)
    kind = np.insert(m._class(size, tail), first[1:], m.CLASSES - 1).astype(np.uint8)
    sub, sizes = m._sub(word), n + 1
    held = np.repeat([zlib.crc32(str(i).encode()) % 5 == 1 for i, _ in rows], sizes)
    count = Counter(word[~held].tolist())
    by_sub, known = np.zeros((m.CLASSES, m.SUBS)), np.zeros((m.CLASSES, m.SUBS))
    for w, k, s in {(w, k, s) for w, k, s in zip(word.tolist(), kind.tolist(), sub.tolist())}:
        by_sub[k, s] += count[w]
        known[k, s] += count[w] > 0
    weights, squares = np.zeros((m.ALL_ROWS, m.CLASSES), np.float32), np.zeros(m.ALL_ROWS, np.float32)
    by_class = by_sub.sum(axis=1)
    weights[2 * m.WORD_BUCKETS:2 * m.WORD_BUCKETS + m.PAIRS] = np.log((by_class + 1) / (by_class.sum() + m.CLASSES))
    weights[m.ROWS:m.ROWS + m.CLASSES] = np.log((by_sub + 1) / (by_class + m.SUBS)[:, None])
    at = m.features(word, kind, sizes)
    both = m.sub_features(at, kind)
    train = np.flatnonzero(~held)
    for i in range(0, len(train), 64):
        mine = train[i:i + 64]
        naive_update(weights, squares, at[:, mine], kind[mine])
        mine = mine[kind[mine] < m.CLASSES - 1]
        if len(mine):
            naive_update(weights, squares, both[:, mine], sub[mine])
    start = 0
    for (i, _), size_ in zip(rows, sizes.tolist()):
        total = 0.0
        for t in range(start, start + size_):
            total += m.class_log_probabilities(weights, at[:, t:t + 1])[0, kind[t]] / math.log(10)
            if kind[t] < m.CLASSES - 1:
                total += m.class_log_probabilities(weights, both[:, t:t + 1])[0, sub[t]] / math.log(10)
            share = by_sub[kind[t], sub[t]] + 0.5 * (known[kind[t], sub[t]] + 1)
            total += math.log10((count[int(word[t])] + 0.5) / share)
        start += size_
        assert got[i] == pytest.approx(total, abs=2e-3), i


def test_an_id_that_is_repeated_votes_once(spark):
    rows = [(1, "good prose of one kind")] * 500 + [(2, "bad junk $$ of another kind")] + [(1, "good text")] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(1, 1), (1, 1), (1, 0), (2, 0), (None, 1)], "doc_id long, quality int")
    voters = knn_quality.fit(docs, labels)
    assert voters.labels.tolist() == [0.0, 0.0] and len(voters.vectors) == 2


def naive_grams(text):
    out, mask = Counter(), (1 << 32) - 1
    for order in range(1, 4):
        for i in range(len(text) - order + 1):
            h = 0
            for c in text.lower()[i:i + order]:
                h = (h * 0x01000193 & mask) ^ (ord(c) * 0x9E3779B1 & mask)
            h = ((h ^ h >> 15) * 0x85EBCA6B + order) & mask
            out[(h >> 16) % language_id.BUCKETS] += 1
    return out


def test_naive_bayes_is_that_of_counts_in_plain_python(spark):
    """Bayes' rule over hashed n-grams, written out per document."""
    r = __import__("random").Random(7)
    letters = {"aa": "abcde ", "bb": "cdefg ", "cc": "\u00fc\u00f6\u00e4 g"}
    rows = []
    for i in range(90):
        lang = r.choice(list(letters))
        rows.append((i, "".join(r.choice(letters[lang]) for _ in range(r.randint(1, 60))), lang))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    model = language_id.train(docs)
    per, many = {}, Counter(lang for *_, lang in rows)
    for _, text, lang in rows:
        per.setdefault(lang, Counter()).update(naive_grams(text))
    for row in docs.select("doc_id", language_id.predicted(docs, model).alias("p")).collect():
        text = rows[row.doc_id][1]
        if not any(c.isalpha() for c in text):
            assert row.p.lang_pred == "und" and row.p.score == 0
            continue
        logs = {x: math.log(many[x] / 90) + sum(k * math.log((c[g] + 0.5) / (sum(c.values()) + 0.5 * language_id.BUCKETS))
                                                for g, k in naive_grams(text).items()) for x, c in per.items()}
        best = max(logs, key=logs.get)
        share = 1 / sum(math.exp(v - logs[best]) for v in logs.values())
        assert logs[row.p.lang_pred] == pytest.approx(logs[best], abs=1e-3) and row.p.score == pytest.approx(share, abs=1e-3)
