"""Operator 6: scores of texts by a hashed maximum-entropy language model.

A word's probability is factored: ``P(class | context) * P(sub-class | class,
context) * P(word | sub-class)``. A class is what words with the same ending
and size have in common, so that unseen words have one too; the end of a text
is a class of its own. A sub-class is a range of word hashes within a class.
The class is predicted by a softmax over hashed features of the context: the
word before, the word before that (skip), the classes of the last two words
and of the two before them (skip). The sub-class is predicted by a softmax of
its own over the class and, each hashed together with the class, the first
three of these features. Words within a sub-class share its probability by
their training counts, with half a count for each and for one unseen word.

1. Texts are cut into blocks of about ``BLOCK_BYTES``; a block holds its
   distinct words' hashes, and its texts as places in that list.
2. Counts: every block sends its distinct words to their hash range, which adds
   up the blocks' counts and sends back each block's sums. A word that every
   block has costs one entry per block; no vocabulary is broadcast.
3. Training goes over all training texts in ``ROUNDS`` disjoint parts. A task
   makes mini-batch updates (Adagrad) from the broadcast weights and returns
   the change; the changes' mean over the tasks, weighted by tokens, is the
   round's update. The weights' size is fixed by the parameters.
4. Scoring reads blocks with their counts, in batches.

The base score is that of the add-one-half unigram model on the same counts.
The order in which tasks' changes are added follows the shuffle, so ``score`` is
repeatable to rounding, not to the last bit; all other columns are exact.
Defined results: a null or empty text is the end token alone. Rows without
an id are training rows. Repeated rows are scored and counted each. Without
training rows the counts are 0 and nothing is learned. Words are told apart by
64-bit hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bizlens.llm.common import byte_rows, chunked, id_remainder, mix64, saved, word_table

BLOCK_BYTES = 8 << 20
CLASSES = 32                            # the last one is the end's
WORD_BUCKETS = 1 << 13
PAIRS = CLASSES * CLASSES
ROWS = 2 * WORD_BUCKETS + 2 * PAIRS     # rows of the weight matrix (16 bits, for a fast sort)
SUBS = 32                               # sub-classes of a class; as many as classes, so one matrix holds both
SUB_BUCKETS = 15 << 10
ALL_ROWS = ROWS + CLASSES + 3 * SUB_BUCKETS     # with the rows of the sub-classes (16 bits too)
ROUNDS, BATCH, RATE = 3, 2048, 0.1
SLICES = 64                             # slices of the weights that are summed apart
RANGE_ENTRIES = 1 << 21                 # distinct words of blocks that a hash range gets on average
END = np.uint64(0xE0D0F0A0C0FFEE01)
_START = np.uint64(0x57A27)


# ---------------------------------------------------------------- blocks


def _blocks(train_if_not: int):
    def run(batches):
        serial = TaskContext.get().partitionId() << 33
        for batch in batches:
            rows = byte_rows(batch.column("text"))
            for i, j in chunked(rows, BLOCK_BYTES):
                part = batch.slice(i, j - i)
                fold = part.column("fold").to_numpy()
                h, first, size, tail = _words(rows[i:j])
                n = np.diff(first)
                at = np.insert(h, first[1:], END)           # each text's words, then its end
                words, pick, code = np.unique(at, return_index=True, return_inverse=True)
                classes = np.insert(_class(size, tail), first[1:], CLASSES - 1)[pick]
                train = np.repeat(fold != train_if_not, n + 1)
                count = np.bincount(code[train], minlength=len(words))
                yield pa.RecordBatch.from_pydict({
                    "block": pa.array([serial]), "ids": pa.array([part.column("id").to_pylist()], pa.list_(pa.int64())),
                    "held_out": pa.array([(fold == train_if_not).tolist()], pa.list_(pa.bool_())),
                    "sizes": pa.array([(n + 1).tolist()], pa.list_(pa.int64())),
                    "codes": pa.array([code.astype(np.uint32).tobytes()], pa.binary()),
                    "words": pa.array([words.tobytes()], pa.binary()),
                    "counts": pa.array([count.astype(np.int64).tobytes()], pa.binary()),
                    "classes": pa.array([classes.astype(np.uint8).tobytes()], pa.binary()),
                    "n_words": pa.array([len(words)], pa.int64())})
                serial += 1
    return run


def _words(rows: list[bytes | None]):
    """Word hashes of a block, with each word's size and last two bytes."""
    h, first, size, tail = [], [np.zeros(1, np.int64)], [], []
    seen = 0
    for i, j in chunked(rows):
        hash_, f, buf, s, e = word_table(rows[i:j])
        h.append(hash_)
        first.append(f[1:] + seen)
        seen += len(hash_)
        size.append(e - s)
        tail.append(buf[e - 1].astype(np.int64) | buf[np.maximum(e - 2, s)].astype(np.int64) << 8)
    cat = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
    return cat(h, np.uint64), np.concatenate(first), cat(size, np.int64), cat(tail, np.int64)


def _class(size: np.ndarray, tail: np.ndarray) -> np.ndarray:
    return (mix64((tail << 2 | np.minimum(size, 3)).astype(np.uint64)) % np.uint64(CLASSES - 1)).astype(np.int64)


def _sub(words: np.ndarray) -> np.ndarray:
    return (words & np.uint64(SUBS - 1)).astype(np.int64)


# ---------------------------------------------------------------- counts


def _send(ranges: int):
    """A block's words by hash range; the words are sorted, so a range is a slice."""
    def run(batches):
        edges = (np.arange(1, ranges, dtype=object) * (1 << 64) // ranges).astype(np.uint64)
        for batch in batches:
            for row in batch.to_pylist():
                words = np.frombuffer(row["words"], np.uint64)
                cut = [0, *np.searchsorted(words, edges).tolist(), len(words)]
                some = [r for r in range(ranges) if cut[r] < cut[r + 1]]
                part = lambda name, width: pa.array(
                    [row[name][cut[r] * width:cut[r + 1] * width] for r in some], pa.binary())
                yield pa.RecordBatch.from_pydict({
                    "part": pa.array(some, pa.int32()), "block": pa.array([row["block"]] * len(some), pa.int64()),
                    "words": part("words", 8), "counts": part("counts", 8), "classes": part("classes", 1)})
    return run


def _add(batches):
    """Per range: each block's words' counts over all blocks, and (block -1) the sums by class and sub-class."""
    held: list[tuple[int, bytes, bytes, bytes]] = []
    part = None

    def added():
        size = [len(w) // 8 for _, w, _, _ in held]
        words = np.frombuffer(b"".join(w for _, w, _, _ in held), np.uint64)
        counts = np.frombuffer(b"".join(c for _, _, c, _ in held), np.int64)
        uniq, pick, code = np.unique(words, return_index=True, return_inverse=True)
        total = np.bincount(code, weights=counts, minlength=len(uniq)).astype(np.int64)
        classes = np.frombuffer(b"".join(k for _, _, _, k in held), np.uint8)[pick]
        place = classes.astype(np.int64) * SUBS + _sub(uniq)
        by_sub = np.stack([np.bincount(place, weights=x, minlength=CLASSES * SUBS) for x in (total, total > 0)])
        blocks = [b for b, *_ in held] + [-1]
        data = [x.astype(np.int64).tobytes() for x in np.split(total[code], np.cumsum(size)[:-1])]
        yield pa.RecordBatch.from_pydict({
            "block": pa.array(blocks, pa.int64()), "part": pa.array([part] * len(blocks), pa.int32()),
            "totals": pa.array(data + [by_sub.astype(np.int64).tobytes()], pa.binary())})

    for batch in batches:
        for row in batch.to_pylist():
            if row["part"] != part and held:
                yield from added()
                held.clear()
            part = row["part"]
            held.append((row["block"], row["words"], row["counts"], row["classes"]))
    if held:
        yield from added()


# ---------------------------------------------------------------- model


def features(word: np.ndarray, kind: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Rows of the weight matrix that each token's context switches on (4 x tokens)."""
    n = len(word)
    place = np.arange(n) - np.repeat(np.cumsum(sizes) - sizes, sizes)

    def back(x: np.ndarray, k: int, start):
        out = np.full(n, start, dtype=x.dtype)
        out[k:] = x[:n - k] if k < n else x[:0]
        out[place < k] = start
        return out

    one, two = (mix64(back(word, k, _START) + np.uint64(k)) % np.uint64(WORD_BUCKETS) for k in (1, 2))
    k1, k2, k3, k4 = (back(kind.astype(np.int64), k, CLASSES - 1) for k in (1, 2, 3, 4))
    base = 2 * WORD_BUCKETS
    return np.stack([one.astype(np.int64), two.astype(np.int64) + WORD_BUCKETS, base + k2 * CLASSES + k1,
                     base + PAIRS + k4 * CLASSES + k3]).astype(np.uint16)


def sub_features(at: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """Rows that each token's class, and its context together with the class, switch on (4 x tokens)."""
    rows = [ROWS + kind.astype(np.int64)]
    for i, row in enumerate(at[:3]):
        mixed = mix64(row.astype(np.uint64) * np.uint64(CLASSES) + kind.astype(np.uint64)) % np.uint64(SUB_BUCKETS)
        rows.append(mixed.astype(np.int64) + (ROWS + CLASSES + i * SUB_BUCKETS))
    return np.stack(rows).astype(np.uint16)


def _summed(weights: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The classes' scores of each token (less the largest): the sum of its features' rows."""
    x = weights.take(at[0], axis=0)
    for row in at[1:]:
        x += weights.take(row, axis=0)
    x -= x.max(axis=1, keepdims=True)
    return x


def class_log_probabilities(weights: np.ndarray, at: np.ndarray) -> np.ndarray:
    x = _summed(weights, at)
    x -= np.log(np.exp(x).sum(axis=1, keepdims=True))
    return x


def log_probability(weights: np.ndarray, at: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """The log-probability of each token's own class."""
    x = _summed(weights, at)
    own = x[np.arange(len(kind)), kind]
    return own - np.log(np.exp(x, out=x).sum(axis=1))


def update(weights: np.ndarray, squares: np.ndarray, at: np.ndarray, kind: np.ndarray) -> None:
    """One mini-batch step in place: the softmax's gradient, summed by feature.

    The features' rows lie in ranges of their own, so all of them are sorted and summed together.
    """
    g = _summed(weights, at)
    np.exp(g, out=g)
    g /= g.sum(axis=1, keepdims=True)
    g[np.arange(len(kind)), kind] -= 1.0
    rows = at.ravel()
    order = np.argsort(rows, kind="stable")
    sorted_ = rows.take(order)
    cut = np.flatnonzero(np.r_[True, sorted_[1:] != sorted_[:-1]])
    g = g.take(order % len(kind), axis=0)
    grad, rest = g.take(cut, axis=0), np.ones(len(g), dtype=bool)
    rest[cut] = False
    more = np.diff(np.r_[cut, len(g)]) - 1              # most rows are met once: only the others are summed
    many = np.flatnonzero(more)
    if len(many):
        grad[many] += np.add.reduceat(g[rest], (np.cumsum(more) - more)[many], axis=0)
    used = sorted_.take(cut)
    total = squares.take(used) + np.einsum("ij,ij->i", grad, grad) / np.float32(grad.shape[1])
    squares[used] = total
    grad *= (RATE / np.sqrt(total + 1e-6)).astype(np.float32)[:, None]
    weights[used] -= grad


def _unpacked(row: dict):
    words, classes = np.frombuffer(row["words"], np.uint64), np.frombuffer(row["classes"], np.uint8)
    code = np.frombuffer(row["codes"], np.uint32)
    return words[code], classes[code], code, np.array(row["sizes"], np.int64)


def _train(shared):
    def run(batches):
        weights, tokens = shared.value.copy(), 0
        squares = np.zeros(ALL_ROWS, np.float32)
        for batch in batches:
            for row in batch.to_pylist():
                word, kind, _, sizes = _unpacked(row)
                at = features(word, kind, sizes)
                sub_at, sub = sub_features(at, kind), _sub(word)
                train = np.flatnonzero(~np.repeat(np.array(row["held_out"], dtype=bool), sizes))
                for i in range(0, len(train), BATCH):
                    mine = train[i:i + BATCH]
                    update(weights, squares, at[:, mine], kind[mine].astype(np.int64))
                    mine = mine[kind[mine] < CLASSES - 1]       # the end's class has one word
                    if len(mine):
                        update(weights, squares, sub_at[:, mine], sub[mine])
                tokens += len(train)
        if tokens:
            delta = ((weights - shared.value) * np.float32(tokens)).astype(np.float32)
            slices = np.array_split(delta, SLICES)
            yield pa.RecordBatch.from_pydict({"slice": pa.array(range(SLICES), pa.int32()),
                                              "tokens": pa.array([tokens] * SLICES, pa.int64()),
                                              "delta": pa.array([x.tobytes() for x in slices], pa.binary())})
    return run


def _sum_deltas(batches):
    """Per slice of the weights, the sum of the tasks' changes; holds one sum for each slice it is given."""
    sums: dict[int, list] = {}
    for batch in batches:
        for k, n, delta in zip(*(batch.column(c).to_pylist() for c in ("slice", "tokens", "delta"))):
            have = sums.setdefault(k, [0, 0.0])
            have[0] += n
            have[1] = have[1] + np.frombuffer(delta, np.float32).astype(np.float64)
    for k, (tokens, total) in sums.items():
        yield pa.RecordBatch.from_pydict({"slice": pa.array([k], pa.int32()), "tokens": pa.array([tokens], pa.int64()),
                                          "delta": pa.array([total.astype(np.float32).tobytes()], pa.binary())})


def _sum_by_sub(batches):
    """One task's sums by class and sub-class."""
    total = np.zeros(2 * CLASSES * SUBS, np.int64)
    for batch in batches:
        for x in batch.column("totals").to_pylist():
            total += np.frombuffer(x, np.int64)
    yield pa.RecordBatch.from_pydict({"totals": pa.array([total.tobytes()], pa.binary())})


def _score(shared):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
        if not left.num_rows:
            return pa.table({n: pa.array([], t) for n, t in zip(names, _TYPES)})
        weights, by_sub = shared.value
        row = left.to_pylist()[0]
        parts = sorted(zip(right.column("part").to_pylist(), right.column("totals").to_pylist()))
        total = np.frombuffer(b"".join(x for _, x in parts), np.int64)
        word, kind, code, sizes = _unpacked(row)
        n, v = (int(x) for x in by_sub.sum(axis=(1, 2)))
        base = np.log10((total + 0.5) / (n + 0.5 * (v + 1)))
        classes = np.frombuffer(row["classes"], np.uint8)
        share = (by_sub[0] + 0.5 * (by_sub[1] + 1))[classes, _sub(np.frombuffer(row["words"], np.uint64))]
        within = np.log10((total + 0.5) / share)
        at = features(word, kind, sizes)
        chosen = np.empty(len(code))
        for i in range(0, len(code), 2 * BATCH):
            j = min(i + 2 * BATCH, len(code))
            chosen[i:j] = log_probability(weights, at[:, i:j], kind[i:j])
            words = np.flatnonzero(kind[i:j] < CLASSES - 1) + i         # the end's class has one word
            chosen[words] += log_probability(weights, sub_features(at[:, words], kind[words]), _sub(word[words]))
        first = np.cumsum(sizes) - sizes
        sums = lambda x: np.add.reduceat(x, first)
        known = sums((total > 0)[code].astype(np.int64))
        return pa.table({
            "doc_id": pa.array(row["ids"], pa.int64()), "held_out": pa.array(row["held_out"], pa.bool_()),
            "n_tokens": pa.array(sizes, pa.int64()), "n_known": pa.array(known, pa.int64()),
            "train_tokens": pa.array([n] * len(sizes), pa.int64()), "base_score": pa.array(sums(base[code])),
            "score": pa.array(sums(within[code]) + sums(chosen) / np.log(10.0))})
    return run


_TYPES = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]


def scored_texts(docs: DataFrame, folds: int = 5, held_out_fold: int = 1, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every row.

    Training leaves out the rows whose ``crc32(id as text) mod folds`` is ``held_out_fold``.
    """
    spark = docs.sparkSession
    sc = spark.sparkContext
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"),
                       id_remainder(F.col(id_col), folds).alias("fold"))
    blocks = saved(rows.mapInArrow(_blocks(held_out_fold),
                                   "block long, ids array<long>, held_out array<boolean>, sizes array<long>, "
                                   "codes binary, words binary, counts binary, classes binary, n_words long"), "blocks")
    entries = blocks.agg(F.coalesce(F.sum("n_words"), F.lit(0))).first()[0]
    ranges = max(1, -(-entries // RANGE_ENTRIES))
    sent = blocks.select("block", "words", "counts", "classes").mapInArrow(
        _send(ranges), "part int, block long, words binary, counts binary, classes binary")
    totals = saved(sent.repartition("part").sortWithinPartitions("part").mapInArrow(
        _add, "block long, part int, totals binary"), "totals")
    by_sub = np.zeros((2, CLASSES, SUBS), np.int64)
    for r in totals.where("block = -1").select("totals").mapInArrow(_sum_by_sub, "totals binary").collect():
        by_sub += np.frombuffer(r.totals, np.int64).reshape(2, CLASSES, SUBS)

    weights = np.zeros((ALL_ROWS, CLASSES), np.float32)     # the shares, before any context is learned
    by_class = by_sub[0].sum(axis=1)
    weights[2 * WORD_BUCKETS:2 * WORD_BUCKETS + PAIRS] = np.log((by_class + 1) / (by_class.sum() + CLASSES))
    weights[ROWS:ROWS + CLASSES] = np.log((by_sub[0] + 1) / (by_class + SUBS)[:, None])
    for turn in range(ROUNDS):
        shared = sc.broadcast(weights)
        mine = blocks.where(F.pmod(F.xxhash64("block"), F.lit(ROUNDS)) == turn).select(
            "codes", "words", "classes", "sizes", "held_out")
        deltas = (mine.mapInArrow(_train(shared), "slice int, tokens long, delta binary")
                  .repartition("slice").mapInArrow(_sum_deltas, "slice int, tokens long, delta binary")).collect()
        if deltas:              # together one matrix, however many tasks there were
            change = np.concatenate([np.frombuffer(r.delta, np.float32) / r.tokens
                                     for r in sorted(deltas, key=lambda r: r.slice)])
            weights = (weights + change.reshape(ALL_ROWS, CLASSES)).astype(np.float32)
    shared = sc.broadcast((weights, by_sub))
    left = blocks.select("block", "ids", "held_out", "sizes", "codes", "words", "classes")
    return (left.groupBy("block").cogroup(totals.where("block >= 0").groupBy("block"))
            .applyInArrow(_score(shared), "doc_id long, held_out boolean, n_tokens long, n_known long, "
                                          "train_tokens long, base_score double, score double"))
