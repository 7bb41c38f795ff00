"""Adaptive rules (3), k-d shards (7) and the pipeline."""

import re
import time
import zlib
from collections import Counter, defaultdict

import corpus_pipeline
import pytest

from bizlens.llm.adaptive_rules import MEASURES, adaptive_quality, measures
from bizlens.llm.common import saved
from bizlens.llm.kd_shards import kd_shards
from bizlens.llm.queries import QUERIES
from tests.conftest import SF001, SF01
from tests.llm.conftest import hard_rows, words

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_measures(text):
    text = text or ""
    w = WORD.findall(text)
    tri = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
    c = Counter(tri)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (len(w), sum(map(len, w)), sum(text.count(x) for x in "#*$%&|<>"), len(lines) - len(set(lines)),
            len({p for i, g in enumerate(tri) if c[g] > 1 for p in (i, i + 1, i + 2)}))


def test_measures_equal_brute_force(spark, hard):
    more = ["a b c a b c", "a a a a a", "a a a", "x\ny\nx\n \n \n", "a\x0bb\x0cc\rd\te f", "é é é é", "\x1ca \x85b \xa0c", "a b " * 5000]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(more)], "doc_id long, text string")
    got = {r.doc_id: tuple(r[m] for m in MEASURES) for r in measures(df, keep=["doc_id"]).collect()}
    assert got == {i: brute_measures(t) for i, t in enumerate(more)}
    got = Counter((r.doc_id, *(r[m] for m in MEASURES)) for r in adaptive_quality(hard).collect())
    assert got == Counter((r[0], *brute_measures(r[1])) for r in hard_rows())


def test_thresholds_adapt_and_keep_clean_documents(spark, empty):
    rows = [(i, " ".join(words(120, i)), "en", "hot" if i % 3 else f"s{i % 7}") for i in range(400)]
    rows += [(1000 + i, " ".join(f"{w}{i}{k}###***" for k, w in enumerate(words(120, i))), "en", "hot") for i in range(20)]
    rows += [(2000 + i, " ".join("w" * 30 + str(1000 * i + k) for k in range(100)), "de", f"long{i % 2}") for i in range(250)]
    rows += [(3000, None, None, None), (3001, "a b", "en", None)]
    got = {r.doc_id: r for r in adaptive_quality(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert all(got[i].kept for i in range(400))
    assert not any(got[1000 + i].kept for i in range(20))
    assert all(got[2000 + i].kept for i in range(250))          # long words are normal in their own group
    assert got[3000].base_failed and not got[3000].kept and not got[3001].kept
    assert adaptive_quality(empty).count() == 0


def check_shards(rows, docs, shards):
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in rows) == Counter(
        (i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in docs)
    slots, size = defaultdict(list), Counter()
    for r in rows:
        slots[r.shard].append(r.slot)
        size[r.shard] += r["size"]
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < shards
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    return size


def test_shards_of_hard_rows(spark, hard, empty):
    check_shards(kd_shards(hard, shards=16).collect(), [r[:2] for r in hard_rows()], 16)
    check_shards(kd_shards(hard, target_bytes=100_000).collect(), [r[:2] for r in hard_rows()], 16)
    assert kd_shards(empty, shards=16).count() == 0


@pytest.mark.parametrize("shards", [16, 5])
def test_shards_are_near_equal_despite_a_hot_source_and_copies(spark, shards):
    docs = [(i, "same text " * 20 if i % 3 == 0 else " ".join(words(20 + i % 60, i)), "en", "hot" if i % 3 == 0 else f"s{i % 9}") for i in range(6000)]
    rows = kd_shards(spark.createDataFrame(docs, "doc_id long, text string, lang string, source string"), shards=shards).collect()
    size = check_shards(rows, [d[:2] for d in docs], shards)
    mean = sum(size.values()) / shards
    assert len(size) == shards and max(size.values()) < 1.02 * mean and min(size.values()) > 0.98 * mean


def test_pipeline_stages(spark, hard, empty):
    docs = hard
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = saved(stage(spark, docs, SF001), name)
        assert got.columns == hard.columns, name
        docs = got
        assert stage(spark, empty, SF001).count() == 0
    ids = [r.doc_id for r in docs.collect()]
    assert not {6, 7, 8, 15} & set(ids) and ids.count(1) == 1 and not {2, 3, 4, 5} & set(ids)
    assert ids.count(None) == 1 and {9, 11, 12, 13, 14} <= set(ids)
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF001)
    assert sorted(r.decoded_sha256 for r in last.collect()) and last.count() == len(ids)


def test_pipeline_run_keeps_what_its_stages_keep(spark):
    rows = QUERIES["pipeline"](spark, SF01).collect()
    docs = spark.read.parquet(f"{SF01}/documents.parquet").count()
    assert 0.8 * docs < len(rows) < docs and len({r.doc_id for r in rows}) == len(rows)


def test_repeated_rows_are_spread_over_the_shards(spark):
    rows = [(7, "same text " * 30, "en", "s")] * 3000 + [(100 + i, "other " * (i % 60), "de", f"s{i % 9}") for i in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    results = []
    for parts in (3, 7):
        got = kd_shards(docs.repartition(parts), shards=16).collect()
        by = {}
        for r in got:
            by.setdefault(r.shard, []).append(r)
        size = [sum(r.size for r in by.get(k, [])) for k in range(16)]
        assert len(by) == 16 and max(size) < 1.1 * min(size)
        assert all(sorted(r.slot for r in x) == list(range(len(x))) for x in by.values())
        results.append(sorted((r.doc_id, r.size, r.shard) for r in got))
    assert results[0] == results[1]         # as many copies in each shard, however the rows are dealt


def test_saved_tables_leave_no_shuffle_files(spark):
    from pyspark.sql import functions as F

    from bizlens.llm.common import CLEANUP

    def left():
        files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {name for i in range(files.size()) if (name := files.apply(i).getName()).startswith("shuffle_")}

    rows = spark.range(1000).repartition(4, "id").groupBy((F.col("id") % 7).alias("k")).count()
    before, setting = left(), spark.conf.get(CLEANUP, None)
    table = saved(rows, "cleaned")
    for _ in range(20):                 # executors are told, not waited for
        if left() <= before:
            break
        time.sleep(0.5)
    assert left() <= before
    assert spark.conf.get(CLEANUP, None) == setting
    assert table.count() == rows.count() == 7       # what was saved can still be computed again
