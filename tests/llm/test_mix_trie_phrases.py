"""Operators 11 to 13 against brute force, on hard rows, with many small partitions and shards."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from bizlens.llm.double_array import DoubleArray
from bizlens.llm.phrase_mining import collocations
from bizlens.llm.prefix_trie import conversation_trie, forest, lcp, prefix_trie, rebuilt
from bizlens.llm.running import running_sums
from bizlens.llm.weighted_mix import mix_plan, mixture
from tests.llm.conftest import hard_rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# ---------------------------------------------------------------- running sums, mixing


def test_running_sums_follow_a_global_order(spark):
    rows = [(i % 7, i, (i * 37) % 11) for i in range(500)]
    df = spark.createDataFrame(rows, "k long, i long, v long").repartition(5)
    got = {(r.k, r.i): r.upto for r in running_sums(df, ["k", "i"], {"upto": "v"}, "t").collect()}
    total = 0
    for k, i, v in sorted(rows):
        total += v
        assert got[k, i] == total


def mixed(rows, weights=(5, 2, 1)):
    """Targets by sharing the excess again and again, then the copies in order of finish time."""
    docs = [(i, s, t or "", len(WORD.findall(t or ""))) for i, t, s in rows]
    sizes = Counter()
    for _, s, _, n in docs:
        sizes[s] += n
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % 3] for k, s in enumerate(order)}
    budget = sum(sizes.values()) * 1.5
    target, left = {}, set(order)
    while left:
        rest = budget - sum(target.values())
        share = {s: rest * weight[s] / sum(weight[x] for x in left) for s in left}
        over = {s for s in left if share[s] >= 2 * sizes[s]}
        if not over:
            target |= share
            break
        target |= {s: 2.0 * sizes[s] for s in over}
        left -= over
    copies = []
    for s in order:
        key = lambda d: hashlib.md5(f"mix:{'' if d[0] is None else d[0]}:{d[2]}".encode()).hexdigest()
        upto = 0
        for epoch in range(2):
            for k, d in sorted(enumerate(d for d in docs if d[1] == s), key=lambda x: key(x[1])):
                upto += d[3]
                copies.append((upto / target[s] if target[s] else 0.0, order.index(s), key(d), epoch, k, d))
    taken, total = Counter(), 0
    for at, place, key_, epoch, k, d in sorted(copies, key=lambda c: c[:4]):
        total += d[3]
        if total <= budget:
            taken[place, k] += d[3]
    out = []
    for s in order:
        for k, d in enumerate(d for d in docs if d[1] == s):
            out.append((d[0], d[3], sizes[s], round(target[s], 6), taken[order.index(s), k]))
    return out


def some_documents(seed, n=300):
    r = random.Random(seed)
    return [(r.choice([i, 3, None]), " ".join(["w"] * r.randint(0, 40)) or None,
             r.choice(["hot"] * 6 + ["a", "é", "z", "", None, "b"])) for i in range(n)]


def test_mixing_is_that_of_the_queues_by_brute_force(spark):
    for rows in (some_documents(1), [(i, t, s) for i, t, _, s, *_ in hard_rows()]):
        plan = mix_plan(spark.createDataFrame(rows, "doc_id long, text string, source string"))
        got = sorted(((r.id, r.size, r.source_size, round(r.target, 6), r.taken) for r in plan.collect()), key=str)
        assert got == sorted(mixed(rows), key=str)
        assert all(t in (0, n, 2 * n) for _, n, _, _, t in got)
        assert sum(t for *_, t in got) <= 1.5 * sum(n for _, n, *_ in got)


def test_the_mixture_has_a_row_for_each_copy(spark, hard):
    plan = mix_plan(hard)
    want = Counter()
    for r in plan.where("copies > 0").select("key", "copies").collect():
        want[r.key] += r.copies
    rows = mixture(hard).collect()
    assert len(rows) == sum(want.values()) and rows
    assert [r.mix_finish for r in rows] == sorted(r.mix_finish for r in rows)
    assert {"_key", "size", "first"} <= set(rows[0].asDict())


def test_mixing_nothing(spark, empty):
    assert mix_plan(empty).collect() == [] and mixture(empty).collect() == []
    nulls = spark.createDataFrame([(None, None, None)] * 3, "doc_id long, text string, source string")
    assert [(r.size, r.target, r.taken) for r in mix_plan(nulls).collect()] == [(0, 0.0, 0)] * 3


# ---------------------------------------------------------------- prefix trie


def built(rows):
    by = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()
            by[c].append((turn is not None, turn or 0, digest, role, text))
    own = {c: [(t[3], t[4]) for t in sorted(ts)] for c, ts in by.items()}
    out = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = own.get(c - c % 20, [])[:h] + ts[h:]
    return out


def trie(convs):
    members = defaultdict(list)
    for c, ts in convs.items():
        for d in range(len(ts) + 1):
            members[tuple(ts[:d])].append(c)
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        own = (len(members[p]) - 1) * len(WORD.findall(p[-1][1])) if p else 0
        leaves[p] = sum(leaves[c] for c in children[p]) or 1
        saved[p] = own + sum(saved[c] for c in children[p])
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(children[p]), leaves[p], saved[p],
                   hashlib.sha256(",".join(str(c) for c in sorted(m) if len(convs[c]) == len(p)).encode()).hexdigest())
                  for p, m in members.items()) if convs else []


def some_turns(seed, n=260):
    r = random.Random(seed)
    rows = []
    for c in range(n):
        if r.random() < 0.1:
            continue
        for turn in range(r.choice([1, 1, 2, 3, 5, 60 if c == 7 else 4])):
            rows.append((c, turn if r.random() < 0.9 else None, r.choice(["user", "bot", None]),
                         r.choice(["hi there", "hi there", "what is it", "", None, " a\tb\nc "])))
    rows += [(c, t, "user", f"the same long talk {t}") for c in range(400, 460) for t in range(9)]
    rows += [(None, 0, "user", "nobody's"), (999, None, None, None), (3, 0, "user", "again"), (3, 0, "user", "again")]
    return rows


@pytest.mark.parametrize("part_turns", [40, 1 << 19])
def test_trie_is_that_of_brute_force_in_one_and_in_many_partitions(spark, part_turns):
    rows = some_turns(3)
    df = spark.createDataFrame([(*r, 1, "x") for r in rows],
                               "conv_id long, turn long, role string, text string, depth long, node string")
    got = conversation_trie(df, part_turns).select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children",
                                                   "n_leaves", "saved_tokens", "ends_sha256")
    assert sorted(tuple(r) for r in got.collect()) == trie(built(rows))


def test_trie_of_nothing_and_of_turnless_conversations(spark):
    schema = "conv_id long, turn long, role string, text string"
    assert conversation_trie(spark.createDataFrame([], schema)).collect() == []
    rows = [(c, 0, "user", "only one turn") for c in range(21, 40)]         # their base is absent
    got = conversation_trie(spark.createDataFrame(rows, schema))
    assert sorted(tuple(r) for r in got.collect()) == trie(built(rows))


def test_forest_of_random_sequences_cut_anywhere():
    r = random.Random(11)
    for _ in range(60):
        seqs = sorted({bytes(16 * r.randint(0, 1)) + b"".join(bytes([r.randint(0, 2)]) * 16 for _ in range(r.randint(0, 6)))
                       for _ in range(r.randint(1, 25))})
        words = {s: [s[16 * i] + i for i in range(len(s) // 16)] for s in seqs}
        n = [r.randint(1, 4) for _ in seqs]
        low = r.sample(range(1000), len(seqs))
        whole = {x[0]: x for x in forest(seqs, [words[s] for s in seqs], n, low, -1, -1)}
        cuts = sorted({0, len(seqs), *(r.randint(0, len(seqs)) for _ in range(3))})
        pieces = defaultdict(list)
        for a, b in zip(cuts, cuts[1:]):
            left = lcp(seqs[a - 1], seqs[a]) if a else -1
            right = lcp(seqs[b - 1], seqs[b]) if b < len(seqs) else -1
            for x in forest(seqs[a:b], [words[s] for s in seqs[a:b]], n[a:b], low[a:b], left, right):
                pieces[x[0]].append(x)
        assert set(pieces) == set(whole)
        for node, parts in pieces.items():
            assert len(parts) == 1 or all(p[9] for p in parts)
            assert min(p[3] for p in parts) == whole[node][3]
            for field in (4, 5, 6, 7):
                assert sum(p[field] for p in parts) == whole[node][field]


def test_rebuilding_takes_the_first_turns_of_the_base(spark):
    convs = spark.createDataFrame([(20, [("a", 1), ("b", 1)]), (21, [("x", 1)]), (22, [("y", 1), ("z", 2), ("u", 1), ("v", 1)])],
                                  "conv_id long, turns array<struct<d:string,w:long>>")
    got = {r.conv_id: "".join(t.d for t in r.turns) for r in rebuilt(convs).collect()}
    h = {c: zlib.crc32(str(c).encode()) % 4 for c in got}
    assert got == {20: "ab", 21: "ab"[:h[21]] + "x"[h[21]:], 22: "ab"[:h[22]] + "yzuv"[h[22]:]}
    empty = prefix_trie(spark.createDataFrame([], "conv_id long, seq binary, words array<long>"))
    assert empty.collect() == []


# ---------------------------------------------------------------- phrases


def test_double_array_holds_its_keys_and_no_others():
    r = np.random.default_rng(3)
    keys = np.unique((r.integers(0, 256, (30000, 4)) % [3, 256, 7, 256]).astype(np.uint8), axis=0)
    trie_ = DoubleArray(keys)
    assert len(set(trie_.end.tolist())) == len(keys)
    other = r.integers(0, 256, (20000, 4)).astype(np.uint8)
    known = {k.tobytes() for k in keys}
    for rows in (keys, other):
        state = np.full(len(rows), trie_.root)
        for j in range(4):
            state = trie_.step(state, rows[:, j].astype(np.int64))
        ends = set(trie_.end.tolist())
        assert [s in ends for s in state.tolist()] == [k.tobytes() in known for k in rows]


def mined(rows, least, top):
    counts, sizes = defaultdict(Counter), Counter()
    lower = {i: i + 32 for i in range(65, 91)}
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(lower)):
            ws = re.findall(r"[^\x20\x09]+", piece)
            sizes[lang] += len(ws)
            for k in range(1, 5):
                for i in range(len(ws) - k + 1):
                    counts[lang][tuple(ws[i:i + k])] += 1
    out = []
    for lang, f in counts.items():
        cands = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        best = []
        for p, a in cands.items():
            score, _, l, r = min((2000000 * a // (f[p[:k]] + f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            if not any(len(q) > len(p) and 100 * b >= 80 * a and any(q[i:i + len(p)] == p for i in range(len(q)))
                       for q, b in cands.items()):
                best.append((-score, -a, " ".join(p).encode(), l, r))
        for rank, (score, a, p, l, r) in enumerate(sorted(best)[:top], 1):
            out.append((lang, rank, p.decode(), -a, l, r, sizes[lang], -score))
    return sorted(out)


@pytest.mark.parametrize("shard", [1 << 20, 40])
def test_collocations_are_those_of_brute_force(spark, shard):
    r = random.Random(9)
    vocabulary = "New york, the city of München is old; old! and É new\ttown a b".split(" ")
    rows = [(" ".join(r.choices(vocabulary, k=r.randint(0, 60))), r.choice(["en", "en", "en", "de", None, "und"]))
            for _ in range(300)] + [(t, lang) for _, t, lang, *_ in hard_rows()] + [("one two three four. " * 50, "fr")] * 2
    df = spark.createDataFrame([(*x, 1, "p") for x in rows], "text string, lang string, rank long, phrase string")
    for least, top in ((4, 40),):
        got = collocations(df, top=top, least=least, shard=shard)
        assert sorted(tuple(x) for x in got.collect()) == mined(rows, least, top)


def test_phrases_are_scored_once(spark):
    df = spark.createDataFrame([("one two three four. " * 40, "en"), ("of the one two. " * 40, "de")], "text string, lang string")
    got = collocations(df)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    joins = sum("Join " in line for line in plan.splitlines())      # spelling's and the sizes' joins, none of the scores'
    assert joins <= 4 and got.count() > 0


def test_collocations_of_nothing(spark, empty):
    assert collocations(empty).collect() == []
    few = spark.createDataFrame([("too few words", "en"), (None, None)], "text string, lang string")
    assert collocations(few).collect() == []
