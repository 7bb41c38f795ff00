"""Operator 13: phrase collocations, counted by double-array tries over all text positions.

Phrases of 2 to 4 words that occur often, scored by how much they hold together.
Everything is per language.

1. Blocks: texts of a language, about ``BLOCK_BYTES`` together, become the block's
   distinct words (64-bit hashes, with their strings and counts) and a code for
   each word and piece break. All later passes read these codes.
2. Words: the blocks' counts are added up; words below the least count can be in
   no candidate.
3. For phrases of 2, 3 and 4 words in turn (a phrase is frequent only if all its
   parts are):
   a. a sketch of hash buckets counts the phrases whose two shorter parts
      are frequent (a bit map of hashes that errs on the safe side only);
   b. the distinct ones among them in a bucket that reaches the least
      count are the candidates;
   c. the candidates, split by hash into shards of ``SHARD`` at most on average, become
      double-array tries of word codes, broadcast one after another. In a pass
      over the blocks, NumPy advances the states of all positions together, symbol
      by symbol; the accepting states are bincounted, and the blocks' counts
      are added up.
4. Scores come from the counts by joins on the phrases' parts.

What is bounded: bit maps have at most ``2 ** MOST_BITS`` bits and a shard's trie
some ten slots a candidate, whatever the input's size. With more frequent
phrases there are more shards, each a pass of its own, and nothing is left out.

Defined results: a null text is empty, a null language is ``und``. Repeated rows
count each. Words are told apart by 64-bit hashes in all counts of phrases.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bizlens.llm.common import _LOWER, byte_rows, chunked, drop_saved, join_rows, mix64, pieces, saved, span_hashes
from bizlens.llm.double_array import SYMBOLS, DoubleArray

BLOCK_BYTES = 2 << 20
LEAST = 30              # occurrences of a candidate
LONGEST = 4             # words
TOP = 2000              # phrases of a language that are reported
INSIDE = (80, 100)      # a candidate goes if a longer one around it has this share of its occurrences
SCALE = 2_000_000
MOST_BITS = 27          # of a bit map's or sketch's hash
SLICES = 64             # parts of a bit map that are made apart
SHARD = 1 << 20         # candidates of one broadcast trie, on average

# The bytes at which pieces end, and those that separate words within a piece.
BREAKS = b".,;:!?\x0a\x0b\x0c\x0d"
BLANKS = b" \x09"
_BREAK = np.zeros(256, dtype=bool)
_BREAK[list(BREAKS)] = True
_WORD = np.ones(256, dtype=np.int8)
_WORD[list(BREAKS + BLANKS)] = 0
_TURN = mix64(np.arange(1, LONGEST + 1, dtype=np.uint64)) | np.uint64(1)       # multiplier of a phrase's k-th word


# ---------------------------------------------------------------- blocks


def words_of(rows: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes of rows in order, whether a piece ends before each, the buffer and the words' spans in it."""
    raw, _ = join_rows(rows)
    buf = _LOWER[raw]
    hashes, starts, ends = [], [], []
    for a, b in pieces(buf):
        edge = np.diff(_WORD[buf[a:b]], prepend=np.int8(0))
        s, e = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        hashes.append(span_hashes(buf[a:b], s, e))
        starts.append(s + a)
        ends.append(e + a)
    h, s, e = np.concatenate(hashes), np.concatenate(starts), np.concatenate(ends)
    breaks = np.cumsum(_BREAK[buf])
    ended = np.ones(len(h), dtype=bool)
    ended[1:] = breaks[s[1:]] > breaks[e[:-1] - 1]
    return np.maximum(h, np.uint64(1)), ended, buf, s, e


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lang = batch.column("lang").to_pylist()
        texts = byte_rows(batch.column("text"))
        by: dict[str, list] = {}
        for name, text in zip(lang, texts):
            by.setdefault(name, []).append(text)
        for name, rows in by.items():
            for i, j in chunked(rows, BLOCK_BYTES):
                h, ended, buf, s, e = words_of(rows[i:j])
                if not len(h):
                    continue
                uniq, first, code, count = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
                codes = np.insert(code.astype(np.uint32) + np.uint32(1), np.flatnonzero(ended), np.uint32(0))
                strings = [buf[a:b].tobytes() for a, b in zip(s[first].tolist(), e[first].tolist())]
                yield pa.RecordBatch.from_pydict({
                    "lang": pa.array([name]), "hashes": pa.array([uniq.view(np.int64)], pa.list_(pa.int64())),
                    "counts": pa.array([count], pa.list_(pa.int64())),
                    "words": pa.array([strings], pa.list_(pa.binary())).cast(pa.list_(pa.string())),
                    "codes": pa.array([codes.tobytes()], pa.binary())})


def salt(lang: str) -> np.uint64:
    return np.frombuffer(hashlib.md5(lang.encode(), usedforsecurity=False).digest()[:8], np.uint64)[0]


class Block:
    """A block's words and codes; code 0 is the end of a piece."""

    def __init__(self, lang: str, hashes: pa.Array, codes: bytes):
        self.lang, self.salt = lang, salt(lang)
        self.words = np.concatenate([np.zeros(1, np.uint64), np.asarray(hashes).view(np.uint64)])
        self.codes = np.frombuffer(codes, np.uint32)

    def keys(self, at: np.ndarray, k: int) -> np.ndarray:
        """Hashes of the phrases of ``k`` words at these positions."""
        total = np.full(len(at), self.salt)
        for j in range(k):
            total += (self.words * _TURN[j])[self.codes[at + j]]
        return mix64(total)

    def places(self, k: int, maps: list) -> np.ndarray:
        """Positions of phrases of ``k`` words whose two parts of ``k - 1`` words may be frequent.

        ``maps[0]`` is the bit map of words, ``maps[-1]`` that of phrases of ``k - 1`` words.
        """
        some = has(maps[0], mix64(self.words * _TURN[0] + self.salt))
        some[0] = False
        some = some[self.codes]
        n = len(some) - k + 1
        ok = some[:max(n, 0)].copy()
        for j in range(1, k):
            ok &= some[j:j + n]
        at = np.flatnonzero(ok)
        if k > 2 and len(at):
            at = at[has(maps[-1], self.keys(at, k - 1))]
            at = at[has(maps[-1], self.keys(at + 1, k - 1))]
        return at


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    for batch in batches:
        hashes = batch.column("hashes")
        for i in range(batch.num_rows):
            yield Block(batch.column("lang")[i].as_py(), hashes[i].values, batch.column("codes")[i].as_py())


# ---------------------------------------------------------------- bit maps


def has(bits: tuple[int, np.ndarray], keys: np.ndarray) -> np.ndarray:
    width, data = bits
    at = keys >> np.uint64(64 - width)
    return (data[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & np.uint8(1)).astype(bool)


def _buckets(width: int, k: int, shared):
    """Per block and slice of the sketch: the buckets of its phrases of ``k`` words and their counts."""
    def run(batches):
        cut = np.arange(SLICES + 1, dtype=np.uint64) << np.uint64(width - 6)
        for block in _read(batches):
            at = block.places(k, shared.value)
            if len(at):
                yield _sliced(*np.unique(block.keys(at, k) >> np.uint64(64 - width), return_counts=True), cut)
    return run


def _known(width: int):
    """The same of a table of frequent phrases, each counted once."""
    def run(batches):
        cut = np.arange(SLICES + 1, dtype=np.uint64) << np.uint64(width - 6)
        for batch in batches:
            lists = batch.column("w")
            words = lists.flatten().to_numpy().view(np.uint64).reshape(batch.num_rows, -1)
            names = batch.column("lang").to_pylist()
            salts = {x: salt(x) for x in set(names)}
            keys = np.array([salts[x] for x in names], np.uint64)
            for j in range(words.shape[1] if len(names) else 0):
                keys += words[:, j] * _TURN[j]
            at = np.unique(mix64(keys) >> np.uint64(64 - width))
            yield _sliced(at, np.ones(len(at), np.int64), cut)
    return run


def _sliced(bucket: np.ndarray, count: np.ndarray, cut: np.ndarray) -> pa.RecordBatch:
    edge = np.searchsorted(bucket, cut)
    some = [i for i in range(SLICES) if edge[i] < edge[i + 1]]
    low = [(bucket[edge[i]:edge[i + 1]] - cut[i]).astype(np.uint32).tobytes() for i in some]
    count = [count[edge[i]:edge[i + 1]].astype(np.int64) for i in some]
    wide = [c.tobytes() if c.max() >> 31 else c.astype(np.int32).tobytes() for c in count]
    return pa.RecordBatch.from_pydict({"slice": pa.array(some, pa.int32()), "at": pa.array(low, pa.binary()),
                                       "n": pa.array(wide, pa.binary())})


def _reached(width: int, least: int):
    """Of rows sorted by slice: the bits of the buckets that reach the least count."""
    size = 1 << (width - 6)

    def made(part, total):
        return pa.RecordBatch.from_pydict({
            "slice": pa.array([part], pa.int32()),
            "bits": pa.array([np.packbits(total >= least, bitorder="little").tobytes()], pa.binary())})

    def run(batches):
        part, total = None, None
        for batch in batches:
            for p, at, n in zip(*(batch.column(c).to_pylist() for c in ("slice", "at", "n"))):
                if p != part:
                    if part is not None:
                        yield made(part, total)
                    part, total = p, np.zeros(size, np.int64)
                at = np.frombuffer(at, np.uint32)
                total[at] += np.frombuffer(n, np.int64 if len(n) == 8 * len(at) else np.int32)
        if part is not None:
            yield made(part, total)
    return run


def _bit_map(rows: DataFrame, width: int, least: int) -> tuple[int, np.ndarray]:
    """The bit map of ``(slice, at, n)``: at most ``2 ** MOST_BITS`` bits, whatever the input's size."""
    slices = (rows.repartition("slice").sortWithinPartitions("slice")
              .mapInArrow(_reached(width, least), "slice int, bits binary").collect())
    data = np.zeros(1 << (width - 3), np.uint8)
    step = len(data) // SLICES
    for r in slices:
        data[r["slice"] * step:(r["slice"] + 1) * step] = np.frombuffer(r["bits"], np.uint8)
    return width, data


def _width(entries: int) -> int:
    return min(max(16, int(entries).bit_length() + 1), MOST_BITS)


# ---------------------------------------------------------------- candidates and tries


def _candidates(k: int, shared):
    def run(batches):
        *maps, sketch = shared.value
        for block in _read(batches):
            at = block.places(k, maps)
            key = block.keys(at, k)
            some = has(sketch, key)
            _, pick = np.unique(key[some], return_index=True)
            at = at[some][pick]
            words = np.stack([block.words[block.codes[at + j]] for j in range(k)], axis=1)
            yield pa.RecordBatch.from_arrays([pa.array([block.lang] * len(at), pa.string()), _lists(words)],
                                             names=["lang", "w"])
    return run


def _lists(words: np.ndarray) -> pa.Array:
    n, k = words.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * k),
                                    pa.array(words.reshape(-1).view(np.int64)))


class PhraseTrie:
    """A shard's candidates as a double-array trie: the language and the words as symbols."""

    def __init__(self, langs: list[str], words: np.ndarray):
        self.k = words.shape[1]
        self.langs = {x: i for i, x in enumerate(sorted(set(langs)))}
        self.lang = np.array([self.langs[x] for x in langs], np.int64)
        self.words = words
        self.alphabet = np.unique(words)
        self.symbols = max(1, -(-int(len(self.alphabet) - 1).bit_length() // 8))       # of a word
        self.lang_symbols = max(1, -(-int(len(self.langs) - 1).bit_length() // 8))
        code = np.searchsorted(self.alphabet, words)
        keys = [self.lang >> 8 * i & 255 for i in range(self.lang_symbols)]
        keys += [code[:, j] >> 8 * i & 255 for j in range(self.k) for i in range(self.symbols)]
        self.trie = DoubleArray(np.stack(keys, axis=1).astype(np.uint8))
        self.number = np.full(len(self.trie.base), -1, np.int32)        # of the candidate that a state accepts
        self.number[self.trie.end] = np.arange(len(words), dtype=np.int32)

    def counted(self, block: Block, maps: list, total: np.ndarray) -> None:
        """Add the block's occurrences of each candidate."""
        if block.lang not in self.langs:
            return
        state = np.full(1, self.trie.root)
        for i in range(self.lang_symbols):
            state = self.trie.step(state, np.array([self.langs[block.lang] >> 8 * i & 255]))
        code = np.searchsorted(self.alphabet, block.words)
        code[code == len(self.alphabet)] = 0
        known = self.alphabet[code] == block.words
        at = block.places(self.k, maps)
        state = np.full(len(at), state[0])
        for j in range(self.k):
            word = block.codes[at + j]
            on = known[word]
            at, state, word = at[on], state[on], word[on]
            for i in range(self.symbols):
                state = self.trie.step(state, code[word] >> 8 * i & 255)
            on = state > 0
            at, state = at[on], state[on]
        total += np.bincount(self.number[state], minlength=len(total))


def _count(shared):
    """A task's occurrences of every candidate, by slices of the candidates: a bounded number of rows a task."""
    def run(batches):
        trie, maps = shared.value
        total = np.zeros(len(trie.words), np.int64)
        for block in _read(batches):
            trie.counted(block, maps, total)
        parts = [(i, x) for i, x in enumerate(np.array_split(total, SLICES)) if x.any()]
        wide = [x.tobytes() if x.max() >> 31 else x.astype(np.int32).tobytes() for _, x in parts]
        yield pa.RecordBatch.from_pydict({"slice": pa.array([i for i, _ in parts], pa.int32()),
                                          "n": pa.array(wide, pa.binary())})
    return run


def _frequent(shared, least: int):
    """Of rows sorted by slice: the candidates whose counts, added up over the tasks, reach the least count."""
    def run(batches):
        trie, _ = shared.value
        cut = np.cumsum([0, *(len(x) for x in np.array_split(np.zeros(len(trie.words)), SLICES))])
        names = np.array(sorted(trie.langs), dtype=object)

        def made(part, total):
            some = np.flatnonzero(total >= least)
            at = some + cut[part]
            return pa.RecordBatch.from_arrays([pa.array(names[trie.lang[at]], pa.string()), _lists(trie.words[at]),
                                               pa.array(total[some])], names=["lang", "w", "f"])

        part, total = None, None
        for batch in batches:
            for p, n in zip(batch.column("slice").to_pylist(), batch.column("n").to_pylist()):
                if p != part:
                    if part is not None:
                        yield made(part, total)
                    part, total = p, np.zeros(cut[p + 1] - cut[p], np.int64)
                total += np.frombuffer(n, np.int64 if len(n) == 8 * len(total) else np.int32)
        if part is not None:
            yield made(part, total)
    return run


class PhraseMiner:
    """Counts of words and frequent phrases over a table of texts; intermediate tables lie in the shared folder."""

    def __init__(self, docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST,
                 longest: int = LONGEST, shard: int = SHARD):
        self.least, self.longest, self.shard = least, longest, shard
        rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"),
                           F.col(text_col).cast("string").alias("text"))
        self.sc = docs.sparkSession.sparkContext
        self.blocks = saved(rows.mapInArrow(_blocks, "lang string, hashes array<long>, counts array<long>, "
                                                     "words array<string>, codes binary"), "blocks")

    def words(self) -> DataFrame:
        """``(lang, word, h, f)`` of every word."""
        one = F.explode(F.arrays_zip("words", "hashes", "counts")).alias("x")
        return saved(self.blocks.select("lang", one).groupBy("lang", F.col("x.words").alias("word"))
                     .agg(F.first("x.hashes").alias("h"), F.sum("x.counts").alias("f")), "words")

    def tries(self, candidates: DataFrame, k: int) -> Iterator[PhraseTrie]:
        """The candidates' tries, one shard at a time; a shard's size is fixed, their number grows."""
        shards = max(1, -(-candidates.count() // self.shard))
        split = candidates.withColumn("shard", F.expr(f"pmod(xxhash64(lang, w), {shards})"))
        for i in range(shards):
            table = split.where(F.col("shard") == i).select("lang", "w").toArrow().combine_chunks()
            if table.num_rows:
                words = table.column("w").combine_chunks().flatten().to_numpy().view(np.uint64).reshape(-1, k)
                yield PhraseTrie(table.column("lang").to_pylist(), words)

    def longer(self, k: int, maps: list, bits: int) -> DataFrame:
        """``(lang, w, f)`` of the frequent phrases of ``k`` words; ``maps`` as in ``Block.places``."""
        read = self.blocks.select("lang", "hashes", "codes")
        shared = self.sc.broadcast(maps)
        sketch = _bit_map(read.mapInArrow(_buckets(bits, k, shared), "slice int, at binary, n binary"), bits, self.least)
        both = self.sc.broadcast([*maps, sketch])
        candidates = saved(read.mapInArrow(_candidates(k, both), "lang string, w array<long>").distinct(), "candidates")
        found = []
        for trie in self.tries(candidates, k):
            broadcast = self.sc.broadcast((trie, maps))
            counts = (read.mapInArrow(_count(broadcast), "slice int, n binary").repartition("slice")
                      .sortWithinPartitions("slice"))
            found.append(saved(counts.mapInArrow(_frequent(broadcast, self.least), "lang string, w array<long>, f long"),
                               "phrases"))
            broadcast.unpersist()
        drop_saved(candidates)
        out = found[0] if found else None
        for more in found[1:]:
            out = out.unionByName(more)         # shards share no phrase
        return out

    def run(self) -> tuple[DataFrame, DataFrame]:
        """``(lang, word, h, f)`` of all words and ``(lang, w, f)`` of the frequent words and phrases."""
        words = self.words()
        total = words.agg(F.coalesce(F.sum("f"), F.lit(0))).first()[0]
        bits = _width(4 * total // self.least)
        level = words.where(F.col("f") >= self.least).select("lang", F.array("h").alias("w"), "f")
        every, maps = level, []
        for k in range(2, self.longest + 1):
            width = _width(16 * level.count())
            maps = maps[:1] + [_bit_map(level.select("lang", "w").mapInArrow(
                _known(width), "slice int, at binary, n binary"), width, 1)]
            level = self.longer(k, maps, bits)
            if level is None:
                break
            every = every.unionByName(level)
        drop_saved(self.blocks)
        return words, every


def scored(frequent: DataFrame) -> DataFrame:
    """``(lang, w, a, l, r, score)`` of every candidate: its cut with the lowest score, the first of several."""
    phrases = frequent.where(F.size("w") >= 2).withColumnRenamed("f", "a")
    cuts = phrases.select("lang", "w", "a", F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("cut"))
    part = lambda name: frequent.select(F.col("lang").alias(f"{name}_lang"), F.col("w").alias(f"{name}_w"),
                                        F.col("f").alias(name))
    left, right = part("l"), part("r")
    cuts = cuts.withColumns({"first": F.slice("w", F.lit(1), F.col("cut")),
                             "rest": F.slice("w", F.col("cut") + 1, F.size("w") - F.col("cut"))})
    both = (cuts.join(left, (F.col("lang") == F.col("l_lang")) & (F.col("first") == F.col("l_w")))
            .join(right, (F.col("lang") == F.col("r_lang")) & (F.col("rest") == F.col("r_w"))))
    wide = lambda c: f"CAST({c} AS DECIMAL(19,0))"
    score = F.expr(f"CAST(CAST({SCALE} AS DECIMAL(7,0)) * {wide('a')} div ({wide('l')} + {wide('r')}) AS BIGINT)")
    lowest = F.min(F.struct(score.alias("score"), "cut", "l", "r"))
    return (both.groupBy("lang", "w", "a").agg(lowest.alias("s"))
            .select("lang", "w", "a", "s.l", "s.r", "s.score"))


def kept(candidates: DataFrame) -> DataFrame:
    """Without the candidates inside a longer one that has most of their occurrences."""
    inner = (candidates.where(F.size("w") > 2)
             .select("lang", F.col("a").alias("longer"), "w", F.explode(F.sequence(F.lit(2), F.size("w") - 1)).alias("n"))
             .select("lang", "longer", "n", "w", F.explode(F.sequence(F.lit(1), F.size("w") - F.col("n") + 1)).alias("i"))
             .select("lang", "longer", F.slice("w", F.col("i"), F.col("n")).alias("w")))
    most = inner.groupBy("lang", "w").agg(F.max("longer").alias("longer"))
    share, of = INSIDE
    wide = lambda c, by: F.col(c).cast("decimal(19,0)") * F.lit(by).cast("decimal(3,0)")
    gone = F.coalesce(wide("longer", of) >= wide("a", share), F.lit(False))
    return candidates.join(most, ["lang", "w"], "left").where(~gone).drop("longer")


def spelled(phrases: DataFrame, words: DataFrame) -> DataFrame:
    """``phrases`` with ``phrase``, their words joined by spaces."""
    known = words.select("lang", "h", "word")
    each = phrases.select("lang", "w", F.posexplode("w").alias("i", "h")).join(known, ["lang", "h"])
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", "word"))), lambda x: x["word"]), " ")
    return phrases.join(each.groupBy("lang", "w").agg(text.alias("phrase")), ["lang", "w"])


def collocations(docs: DataFrame, top: int = TOP, **options) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: each language's best phrases."""
    words, frequent = PhraseMiner(docs, **options).run()
    sizes = words.groupBy("lang").agg(F.sum("f").alias("n"))
    often = words.join(frequent.where(F.size("w") == 1).select("lang", F.col("w")[0].alias("h")), ["lang", "h"], "left_semi")
    every = saved(scored(frequent), "scored")       # read twice by the next step, which is read twice by the one after:
    best = saved(kept(every), "kept")               # as one query they would be four times the joins, planned and run at once
    drop_saved(every)
    best = spelled(best, often)
    place = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    best = best.withColumn("rank", F.row_number().over(place).cast("long")).where(F.col("rank") <= top)
    return best.join(sizes, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
