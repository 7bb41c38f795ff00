"""Jaccard join (5), decontamination (2), line dedup (8) against brute force."""

import random
import re
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from bizlens.llm import jaccard_join as JJ
from bizlens.llm.components import components
from bizlens.llm.decontaminate import REACH, contaminated, without_benchmark
from bizlens.llm.jaccard_join import jaccard_components, one_per_component
from bizlens.llm.jaccard_sketch import Bands, block_keys, distance, parity_bits, running_xor, shingle_sets
from bizlens.llm.line_dedup import dedup_lines
from tests.llm.conftest import hard_rows, words

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})


def shingles(text, k=4):
    w = WORD.findall((text or "").translate(LOWER))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i:i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)])


def brute_components(rows):
    """By row number: set size and the smallest id of its component."""
    sets = [shingles(r[1]) for r in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            both = len(a & b)
            if both and 100 * both >= 85 * (len(a) + len(b) - both):
                root[find(i)] = find(j)
    lowest = defaultdict(list)
    for i, r in enumerate(rows):
        if r[0] is not None:
            lowest[find(i)].append(r[0])
    return [(r[0], len(sets[i]), min(lowest[find(i)], default=None)) for i, r in enumerate(rows)]


def hub_rows():
    """Many variants of one text, each linked with the text but hardly with each other; and chains."""
    rows, base = [], words(150, 7)
    for i in range(120):
        w = list(base)
        for at in random.Random(i).sample(range(0, 150, 5), 1 + i % 3):
            w[at] = f"v{i}"
        rows.append((1000 + i, " ".join(w)))
    rows.append((5000, " ".join(base)))
    chain = words(60, 8)
    for i in range(12):
        chain = chain[1:] + [f"c{i}"]
        rows.append((6000 - i, " ".join(chain)))
    return rows + [(7000 + i, " ".join(words(n, 100 + i))) for i, n in enumerate([1, 2, 3, 4, 5, 8, 13, 40] * 3)]


@pytest.mark.parametrize("rows", [hub_rows(), [r[:2] for r in hard_rows()]], ids=["hub", "hard"])
def test_components_equal_brute_force(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in jaccard_components(df).collect()]
    assert sorted(map(str, got)) == sorted(map(str, brute_components(rows)))


def test_the_pipelines_near_copies_are_those_of_five_words_and_four_fifths(spark):
    rows = []
    for i in range(48):         # a text, and a copy with 2 to 49 words more: similarity of 0.98 to 0.66
        text = words(100, 300 + i)
        rows += [(i, " ".join(text)), (100 + i, " ".join(text + words(i + 2, 400 + i)))]
    sets = {i: shingles(t, 5) for i, t in rows}
    copies = {100 + i for i in range(48) if 5 * len(sets[i] & sets[100 + i]) >= 4 * len(sets[i] | sets[100 + i])}
    lost_before = {100 + i for i in range(48) if 100 * len(shingles(rows[2 * i][1]) & shingles(rows[2 * i + 1][1]))
                   < 85 * len(shingles(rows[2 * i][1]) | shingles(rows[2 * i + 1][1]))} & copies
    assert lost_before and len(copies) < 48
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    kept = corpus_pipeline.one_of_each_group(spark, docs, "")
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(sets) - copies)


def test_one_per_component(spark, hard, empty):
    kept = one_per_component(hard)
    assert kept.columns == hard.columns
    rows = kept.collect()
    ids = [r.doc_id for r in rows]
    assert ids.count(1) == 1 and not {2, 3, 4, 5, 10} & {r.doc_id for r in rows if r.doc_id != 10 or r.text == "ONE two"}
    assert ids.count(None) == 2 and ids.count(9) == 2 and {6, 7, 8} <= set(ids)
    assert one_per_component(empty).count() == 0


def test_linked_sets_share_a_block_and_sketches_bound_the_difference():
    bands, r = Bands(), np.random.default_rng(3)
    for n in [1, 2, 3, 5, 8, 13, 30, 77, 200, 900]:
        for _ in range(40):
            a = np.unique(r.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2))
            drop = r.integers(0, max(1, int(len(a) * 0.16)) + 1)
            extra = r.integers(0, 2**63, r.integers(0, max(1, int(n * 0.16)) + 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
            b = np.unique(np.concatenate([a[drop:], extra]))
            differ = len(np.setxor1d(a, b))
            far = int(np.bitwise_count(parity_bits(a, 16) ^ parity_bits(b, 16)).sum())
            assert far <= differ
            both = len(np.intersect1d(a, b))
            if len(b) and 100 * both >= 85 * (len(a) + len(b) - both):
                keys = [{k for band, _ in bands.homes(len(s)) for k in block_keys(s, running_xor(s), band, *bands.blocks(band)).tolist()}
                        for s in (a, b)]
                assert keys[0] & keys[1]


def test_shingle_sets_of_edge_texts():
    a, b, c, d, e = shingle_sets([None, b" \n", b"One TWO", b"one two", b"a b c d e"])
    assert len(a) == len(b) == 0 and np.array_equal(c, d) and len(e) == 2


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and all(got[i] == 100 for i in range(100, 160))
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---------------------------------------------------------------- benchmark


def clean_words(text):
    return re.sub(r"[\W_]+", " ", (text or "").lower()).split()


def brute_contaminated(docs, items, k=5):
    out = set()
    for i, text in docs:
        w = clean_words(text)
        for item, item_text in items:
            v = clean_words(item_text)
            if len(v) < k:
                continue
            b = Counter(tuple(v[p:p + k]) for p in range(len(v) - k + 1))
            for s in range(max(1, len(w) - len(v) + 1)):
                part = w[s:s + len(v)]
                a = Counter(tuple(part[p:p + k]) for p in range(len(part) - k + 1))
                both = sum((a & b).values())
                if both and 5 * both >= 4 * (a.total() + b.total() - both):
                    out.add((i, item))
                    break
    return out


def test_contaminated_documents_equal_brute_force(spark, hard, empty):
    items = [(1, " ".join(words(40, 21))), (2, " ".join(words(60, 22))), (3, "short one"), (4, None), (5, "the a the a the a the a the a"),
             (6, " ".join(words(40, 21))), (None, " ".join(words(35, 25)))]
    filler = [" ".join(words(90, 30 + i)) for i in range(12)]
    v = items[1][1].split()
    changed = v[:30] + ["other"] + v[31:]
    added = v[:20] + ["more", "words"] + v[20:]
    halves = v[:30] + words(30, 77)
    docs = [(100, f"{filler[0]} {items[0][1]} {filler[1]}"), (101, f"{filler[2]}\n{items[1][1].upper()}!"), (102, items[0][1]),
            (103, f"{filler[3]} {' '.join(changed)} {filler[4]}"), (104, f"{filler[5]} {' '.join(added)}"),
            (105, f"{filler[6]} {' '.join(halves)}"), (106, filler[7]), (107, "the a " * 30), (108, None), (109, "short one"),
            (110, f"{filler[8]}, {items[0][1].replace(' ', ', ')} {items[1][1]}"), (110, filler[9])]
    docs_df = spark.createDataFrame(docs, "doc_id long, text string")
    items_df = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in contaminated(docs_df, items_df).collect()}
    assert got == brute_contaminated(docs, items)
    assert {i for i, _ in got} >= {100, 101, 102, 103, 104, 110} and not {i for i, _ in got} & {105, 106, 108, 109}
    kept = [(r.doc_id, r.text) for r in without_benchmark(docs_df, items_df).collect()]
    assert (110, filler[9]) in kept and len([x for x in kept if x[0] == 110]) == 1
    assert without_benchmark(hard, items_df).columns == hard.columns
    assert without_benchmark(hard, items_df).count() == hard.count()
    assert contaminated(empty, items_df).count() == 0
    assert without_benchmark(hard, items_df.limit(0)).count() == hard.count()


# ---------------------------------------------------------------- lines


def brute_lines(rows, min_sites):
    sites, first = defaultdict(set), {}
    for i, text, site in rows:
        for p, line in enumerate((text or "").split("\n") if text is not None else []):
            if line.strip(" \t\x0b\x0c\r"):
                key = line.strip(" ")
                if site is not None:
                    sites[key].add(site)
                place = (i is not None, i or 0, p)
                first[key] = min(first.get(key, place), place)
    out = []
    for i, text, site in rows:
        if text is None:
            out.append((i, None, 0))
            continue
        lines = text.split("\n")
        keep = [x for p, x in enumerate(lines) if not x.strip(" \t\x0b\x0c\r") or len(sites[x.strip(" ")]) < min_sites
                or first[x.strip(" ")] == (i is not None, i or 0, p)]
        out.append((i, "\n".join(keep), len(lines) - len(keep)))
    return out


def test_lines_equal_brute_force(spark, hard, empty):
    rows = []
    for i in range(400):
        lines = [f"own line {i}"]
        lines += ["spread over all sites"] if i % 3 == 0 else []
        lines += ["on exactly four sites "] if i % 20 in (0, 5, 10, 15) else []
        lines += [" on exactly three sites"] if i % 20 in (1, 6, 11) else []
        lines += ["", "\t"] if i % 7 == 0 else []
        lines += ["one hot site only"] if i % 20 == 2 else []
        rows.append((i, "\n".join(lines), f"s{i % 20}" if i % 50 else None))
    rows += [(400, None, "s1"), (401, "", "s1"), (402, "spread over all sites", "s1"), (None, "spread over all sites", "s2")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(6)
    got = [(r.doc_id, r.text, r.n_removed_lines) for r in dedup_lines(df, min_sites=4).collect()]
    assert sorted(map(str, got)) == sorted(map(str, brute_lines(rows, 4)))
    assert dedup_lines(empty).count() == 0
    out = dedup_lines(hard, min_sites=2)
    assert sorted(out.columns) == sorted(hard.columns) and out.count() == hard.count()
    copies = [r.text for r in out.where("doc_id = 2").collect()]
    assert copies == ["", ""]


def test_reach_is_small():
    assert REACH == 2


def test_sketches_of_any_widths_bound_the_difference():
    r = np.random.default_rng(5)
    for n, m in ((1, 3), (200, 260), (300, 5000), (40000, 36000)):
        a, b = (np.unique(r.integers(0, 2**63, k, dtype=np.uint64)) for k in (n, m))
        b = np.unique(np.concatenate([b, a[: n // 2]]))
        assert distance(parity_bits(a), parity_bits(b)) <= len(np.setxor1d(a, b))
    assert distance(parity_bits(a), parity_bits(a)) == 0


def test_a_copy_without_an_id_takes_no_component(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(5, text), (7, text), (None, text), (None, "alone in here without any id at all")]
    got = jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((str(r.doc_id), str(r.component_id), r.is_first) for r in got.collect()) == [
        ("5", "5", True), ("7", "5", False), ("None", "5", False), ("None", "None", True)]


def test_a_text_with_many_near_copies_is_sent_in_parts(spark, monkeypatch):
    import bizlens.llm.jaccard_join as jj
    monkeypatch.setattr(jj, "FAN", 3)
    base = [f"w{i}" for i in range(120)]
    rows = [(i, " ".join(base[:i] + [f"x{i}"] + base[i + 1:])) for i in range(20)] + [(99, "far away from all of it")]
    got = jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id: r.component_id for r in got.collect()} == {**dict.fromkeys(range(20), 0), 99: 99}


def test_a_pair_that_meets_in_many_buckets_is_given_by_the_lowest_only():
    """Forty near copies in eight buckets; of two classes only higher buckets are known, so all of theirs give the pair."""
    rng = np.random.default_rng(3)
    n, keys, low = 40, range(10, 18), list(range(10, 18))
    bits = [rng.integers(0, 2, 4).astype(np.uint64).tobytes() for _ in range(n)]
    part = {"c": range(n), "comp": range(n), "n": [100] * n, "bits": bits, "part": [0] * n,
            "low": [low if i < n - 2 else [16 + i] for i in range(n)]}
    types = pa.schema([("key", pa.int64()), ("left", pa.int64()), ("right", pa.int64()), ("c", pa.int64()), ("comp", pa.int64()),
                       ("n", pa.int64()), ("bits", pa.binary()), ("part", pa.int64()), ("low", pa.list_(pa.int64()))])
    squares = [pa.RecordBatch.from_pydict({"key": [k] * n, "left": [0] * n, "right": [0] * n, **part}, types) for k in keys]
    got = [p for b in JJ._square(85, 100)(iter(squares)) for p in zip(*(x.to_pylist() for x in b.columns))]
    pairs = {(i, j) for i in range(n) for j in range(i + 1, n)}
    assert set(got) == pairs
    assert all(got.count(p) == (1 if p[1] < n - 2 else len(keys)) for p in list(pairs)[:60] + [(0, n - 1), (n - 2, n - 1)])


def test_pairs_of_many_shared_buckets_leave_no_link_out(spark, monkeypatch):
    """Without the star rounds and with a single known bucket a class, the squares alone find every link."""
    rng = np.random.default_rng(8)
    base = [f"w{i}" for i in rng.integers(0, 5000, 120)]
    texts = []
    for i in range(60):
        words = list(base)
        for at in rng.choice(120, int(rng.integers(0, 5)), replace=False):
            words[at] = f"x{rng.integers(0, 10 ** 6)}"
        texts.append(" ".join(words))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id LONG, text STRING")
    want = {i: lowest for i, _, lowest in brute_components(list(enumerate(texts)))}
    monkeypatch.setattr(JJ.JaccardJoin, "star", lambda self, members, turn: members.select(
        F.col("c").alias("a"), F.col("c").alias("b")).limit(0))
    for known in (1, 64):
        monkeypatch.setattr(JJ, "LOW", known)
        got = {r.doc_id: r.component_id for r in JJ.jaccard_components(docs).collect()}
        assert got == want


def test_mixed_buckets_are_saved_before_the_squares(spark, monkeypatch):
    """The squares' query reads a saved table: the joins that lead to it have left no shuffle files beside the squares'."""
    plans, rest = [], JJ.JaccardJoin.rest

    def watched(self, m, sketches):
        plans.append(m._jdf.queryExecution().optimizedPlan().toString())
        return rest(self, m, sketches)

    monkeypatch.setattr(JJ.JaccardJoin, "rest", watched)
    rows = hub_rows()
    got = {r.doc_id: r.component_id for r in jaccard_components(
        spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: lowest for i, _, lowest in brute_components(rows)}
    assert len(plans) == 1 and "Join" not in plans[0] and "parquet" in plans[0]


def test_squares_are_compared_in_slices(spark, monkeypatch):
    """A large bucket's squares are saved slice by slice, whatever their number; no link is left out."""
    names, real = [], JJ.saved
    monkeypatch.setattr(JJ, "saved", lambda df, name: (names.append(name), real(df, name))[1])
    monkeypatch.setattr(JJ.JaccardJoin, "star", lambda self, members, turn: members.where("false").selectExpr("c AS a", "c AS b"))
    monkeypatch.setattr(JJ, "SQUARE", 16)
    monkeypatch.setattr(JJ, "SLICE", 500, raising=False)
    rows = hub_rows() + [(None, " ".join(words(150, 7)))]
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in jaccard_components(
        spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert Counter(got) == Counter(brute_components(rows))
    assert names.count("squares") > 2


def test_kept_documents_are_shuffled_once(spark):
    """The first of equal rows is taken where the join has put them: one shuffle of the documents, one of the ids."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = hub_rows() + [(None, "a b c d"), (None, "a b c d"), (1000, "a b c d"), (1000, "a b c d"), (0, None), (None, None)]
        kept = one_per_component(spark.createDataFrame(rows, "doc_id long, text string"), words=4, link=85, full=100)
        assert kept._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 2
        got = Counter((r.doc_id, r.text) for r in kept.collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert got[1000, "a b c d"] == 1 and (None, "a b c d") not in got and got[0, None] == 1 and got[None, None] == 1
