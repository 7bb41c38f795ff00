"""Operator 12: the prefix trie of conversations, with what a shared prefix cache would save.

A conversation is the sequence of its turns; a node is a distinct sequence of
first turns. The trie is never walked from the root:

1. Turns: each is a 128-bit digest of role and text with its number of words.
   Digests, not texts, are brought together by conversation, in order of turn.
2. Sequences: equal conversations become one row with their number and lowest
   id, and the rows are range-partitioned and sorted.
3. Forests: in each partition, neighbours' longest common prefixes (LCP) are edges.
   Taken in descending depth by union-find, every merge of two components makes
   a branching node (or adds a child to the one of that depth). The chain of
   nodes above each node has its members, so all nodes follow from these.
4. Boundaries: what a partition shares with its neighbours has the depth of the
   LCP of the last and the first sequence around the boundary. Nodes down to that
   depth are open; each partition contracts its subtrees into sums on its open
   nodes, and pieces of a node (equal digests of the prefix) are added up.
   Whatever is counted once, an open node's own row, belongs to its first piece.

What is bounded: a partition holds about ``PART_TURNS`` turns' digests (16 bytes
a turn, as do sequences in Spark); a single conversation's digests are one row.
Two sequences a partition go to the driver, to find the LCP around boundaries.

Defined results: turns are in order of ``turn`` (null first), then of digest;
equal rows are turns each. Null role or text is empty. Rows without a
conversation id belong to none and are left out. An empty table gives no rows.
Sequences are told apart by 128-bit digests.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bizlens.llm.common import drop_saved, saved

WIDTH = 16                  # bytes of a turn's digest
PART_TURNS = 1 << 19        # turns of distinct sequences in a partition, on average
WORD = r"[^\x20\x09-\x0D]+"
NODE = ("node binary, depth long, parent binary, low long, n_convs long, n_children long, n_leaves long, "
        "saved_tokens long, parent_low long, open boolean")


def turn_digest(role: Column, text: Column) -> Column:
    role, text = (F.coalesce(c.cast("string"), F.lit("")) for c in (role, text))
    return F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))


def conversations(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                  text_col: str = "text") -> DataFrame:
    """``(conv_id, turns)``: each conversation's digests and word counts in order."""
    words = F.regexp_count(F.coalesce(F.col(text_col).cast("string"), F.lit("")), F.lit(WORD)).cast("long")
    turn = F.struct(F.col(turn_col).alias("turn"), turn_digest(F.col(role_col), F.col(text_col)).alias("d"),
                    words.alias("w"))
    ordered = F.sort_array(F.collect_list(turn))                # nulls are the lowest
    return (turns.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("conv_id"))
            .agg(F.transform(ordered, lambda t: F.struct(t["d"], t["w"])).alias("turns")))


def sequences(convs: DataFrame) -> DataFrame:
    """``(conv_id, seq, words)``: the digests one after another, and the turns' word counts."""
    hexed = F.array_join(F.transform("turns", lambda t: t["d"]), "")
    return convs.select("conv_id", F.unhex(hexed).alias("seq"), F.transform("turns", lambda t: t["w"]).alias("words"))


# ---------------------------------------------------------------- one partition's forest


def lcp(a: bytes, b: bytes) -> int:
    """Common first turns of two sequences."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n // WIDTH
    low, high = 0, n // WIDTH           # a[:low] is common, a[:high] is not
    while high - low > 1:
        mid = (low + high) // 2
        if a[low * WIDTH:mid * WIDTH] == b[low * WIDTH:mid * WIDTH]:
            low = mid
        else:
            high = mid
    return low


def merged(seqs: list[bytes], shared: list[int]) -> tuple[list[int], list[int], list[int], list[int]]:
    """Depth, first and last leaf and parent of each compact node, by union-find over the edges in descending LCP.

    Nodes ``0..len(seqs) - 1`` are the sequences' ends; ``shared[i]`` is the LCP of
    ``i`` and ``i + 1``. Edges of equal depth go from left to right, so that only the
    left component can already have a node of that depth. The root's parent is -1.
    """
    m = len(seqs)
    depth = [len(s) // WIDTH for s in seqs]
    first, last, parent = list(range(m)), list(range(m)), [-1] * m
    boss, top = list(range(m)), list(range(m))

    def find(i: int) -> int:
        while boss[i] != i:
            boss[i] = boss[boss[i]]
            i = boss[i]
        return i

    for e in np.argsort(-np.array(shared, dtype=np.int64), kind="stable").tolist():
        a, b = find(e), find(e + 1)
        u, v, d = top[a], top[b], shared[e]
        if depth[u] != d:
            depth.append(d)
            first.append(first[u])
            last.append(last[u])
            parent.append(-1)
            parent[u] = u = len(depth) - 1
        parent[v], last[u] = u, last[v]
        boss[b] = a
        top[a] = u
    if depth[top[find(0)]]:
        depth.append(0)
        first.append(0)
        last.append(m - 1)
        parent.append(-1)
        parent[top[find(0)]] = len(depth) - 1
    return depth, first, last, parent


def forest(seqs: list[bytes], words: list, n: list[int], low: list[int], left: int, right: int) -> Iterator[tuple]:
    """Every node of one partition's sorted distinct sequences, or its piece of it (see ``NODE``).

    ``left`` and ``right`` are the LCPs with the neighbouring partitions' sequences, -1 where there is none.
    """
    m = len(seqs)
    depth, first, last, parent = merged(seqs, [lcp(a, b) for a, b in zip(seqs, seqs[1:])])
    size = len(depth)
    order = sorted(range(size), key=lambda v: -depth[v])             # children before parents
    count, lowest = n + [0] * (size - m), low + [None] * (size - m)
    children, leaves, saved_ = [0] * size, [0] * size, [0] * size    # of the node at the end of the chain
    above = [0] * size                                               # the saving of the chain's top and all below it

    def shared_left(v: int, d: int) -> bool:
        return first[v] == 0 and d <= left

    def own(v: int, d: int) -> int:
        """A piece's part of (members - 1) x words; the 1 is taken off by the first piece."""
        return (count[v] - (not shared_left(v, d))) * words[first[v]][d - 1] if d else 0

    for v in order:
        p, d = parent[v], depth[v]
        goes_on = last[v] == m - 1 and d <= right       # the next partition has a child of it
        if not children[v] and leaves[v] == 0 and v < m and not goes_on:
            leaves[v] = 1
        saved_[v] += own(v, d)
        top = depth[p] + 1 if p >= 0 else d
        above[v] = saved_[v] + sum(own(v, k) for k in range(top, d))
        if p >= 0:
            children[p] += not shared_left(v, top)
            leaves[p] += leaves[v]
            saved_[p] += above[v]
            count[p] += count[v]
            lowest[p] = lowest[v] if lowest[p] is None else min(lowest[p], lowest[v])
    digests: list = [None] * size                       # of the prefix at the end of each chain
    for v in reversed(order):
        p = parent[v]
        digest = digests[p].copy() if p >= 0 else hashlib.md5(usedforsecurity=False)
        top = depth[p] + 1 if p >= 0 else depth[v]
        sum_, up, up_open = above[v], digest.digest() if p >= 0 else None, p >= 0 and _open(first, last, m, p, top - 1, left, right)
        up_low = lowest[p] if p >= 0 else None
        for d in range(top, depth[v] + 1):
            if d:
                digest.update(seqs[first[v]][(d - 1) * WIDTH:d * WIDTH])
            at_end, node, is_open = d == depth[v], digest.digest(), _open(first, last, m, v, d, left, right)
            yield (node, d, up, lowest[v], count[v], children[v] if at_end else int(not shared_left(v, d + 1)),
                   leaves[v], sum_, None if up_open else up_low, is_open)
            sum_ -= own(v, d)
            up, up_open, up_low = node, is_open, lowest[v]
        digests[v] = digest


def _open(first: list[int], last: list[int], m: int, v: int, d: int, left: int, right: int) -> bool:
    return (first[v] == 0 and d <= left) or (last[v] == m - 1 and d <= right)


def _forests(bounds: dict[int, tuple[int, int]]):
    def run(batches):
        held: list[list] = [[], [], [], []]
        part = None

        def made():
            left, right = bounds[part]
            rows: list[tuple] = []
            for row in forest(*held, left, right):
                rows.append(row)
                if len(rows) == 20000:
                    yield _batch(rows)
                    rows = []
            if rows:
                yield _batch(rows)

        for batch in batches:
            for p, *row in zip(*(batch.column(c).to_pylist() for c in ("part", "seq", "words", "n", "low"))):
                if p != part and held[0]:
                    yield from made()
                    held = [[], [], [], []]
                part = p
                for column, value in zip(held, row):
                    column.append(value)
        if held[0]:
            yield from made()
    return run


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.binary(), pa.int64(), pa.binary(), *[pa.int64()] * 6, pa.bool_()]
    names = [f.split()[0] for f in NODE.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)


# ---------------------------------------------------------------- the trie


def prefix_trie(seqs: DataFrame, part_turns: int = PART_TURNS) -> DataFrame:
    """All nodes of the trie of ``(conv_id, seq, words)``.

    ``node`` and ``parent`` (128-bit digests of the prefixes), ``depth, conv_id``
    (lowest member), ``parent_conv_id, n_convs, n_children, n_leaves, saved_tokens``.
    """
    distinct = (seqs.groupBy("seq").agg(F.count("*").alias("n"), F.min("conv_id").alias("low"),
                                        F.first("words").alias("words")))
    turns = seqs.agg(F.coalesce(F.sum(F.size("words")), F.lit(0))).first()[0]
    parts = max(1, -(-turns // part_turns))
    table = saved(distinct.repartitionByRange(parts, "seq").withColumn("part", F.spark_partition_id()), "distinct")
    ends = table.groupBy("part").agg(F.min("seq").alias("a"), F.max("seq").alias("b")).orderBy("part").collect()
    around = [lcp(bytes(x["b"]), bytes(y["a"])) for x, y in zip(ends, ends[1:])]
    bounds = {e["part"]: (x, y) for e, x, y in zip(ends, [-1, *around], [*around, -1])}
    nodes = saved(table.repartition(parts, "part").sortWithinPartitions("part", "seq")
                  .select("part", "seq", "words", "n", "low").mapInArrow(_forests(bounds), NODE), "nodes")
    drop_saved(table)
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    whole = saved(nodes.where("open").groupBy("node", "depth", "parent").agg(F.min("low").alias("low"), *sums), "open")
    fields = ["node", "depth", "parent", "low", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    every = nodes.where("not open").select(*fields, "parent_low").unionByName(
        whole.select(*fields, F.lit(None).cast("long").alias("parent_low")))
    above = whole.select(F.col("node").alias("up"), F.col("low").alias("up_low"))
    return every.join(above, every.parent == above.up, "left").select(
        "node", "parent", "depth", F.col("low").alias("conv_id"),
        F.coalesce("up_low", "parent_low").alias("parent_conv_id"),
        "n_convs", "n_children", "n_leaves", "saved_tokens")


def ends(seqs: DataFrame) -> DataFrame:
    """``(node, conv_id)``: the node at which each conversation ends."""
    return seqs.select(F.unhex(F.md5("seq")).alias("node"), "conv_id")


def _digests(batches):
    """Of rows sorted by (node, conv_id): SHA-256 of each node's decimal ids, comma-joined. Holds one state."""
    node, state = None, None
    for batch in batches:
        done: list[tuple] = []
        for at, conv in zip(batch.column("node").to_pylist(), batch.column("conv_id").to_pylist()):
            if at != node:
                if state is not None:
                    done.append((node, state.hexdigest()))
                node, state, between = at, hashlib.sha256(), ""
            state.update(f"{between}{conv}".encode())
            between = ","
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done)], names=["node", "ends_sha256"])
    if state is not None:
        yield pa.RecordBatch.from_arrays([pa.array([node]), pa.array([state.hexdigest()])], names=["node", "ends_sha256"])


def end_digests(ended: DataFrame) -> DataFrame:
    """``(node, ends_sha256)`` of ``ends``: ids stream through in order, so a node of any size takes constant memory."""
    return (ended.repartition("node").sortWithinPartitions("node", "conv_id")
            .mapInArrow(_digests, "node binary, ends_sha256 string"))


def rebuilt(convs: DataFrame, group: int = 20, heads: int = 4) -> DataFrame:
    """``(conv_id, turns)`` with the first ``h`` turns of conversation ``c - c % group`` before the own ones after ``h``.

    ``h`` is ``crc32(decimal c) % heads``.
    """
    base = convs.select(F.col("conv_id").alias("base"), F.slice("turns", 1, heads - 1).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % F.lit(heads)).cast("int")
    own = convs.withColumns({"h": h, "of": F.col("conv_id") - F.col("conv_id") % F.lit(group)})
    both = own.join(base, F.col("of") == F.col("base"), "left")
    head = F.slice(F.coalesce("head", F.slice("turns", 1, 0)), F.lit(1), F.col("h"))
    return both.select("conv_id", F.concat(head, F.slice("turns", F.col("h") + 1, F.size("turns"))).alias("turns"))


def conversation_trie(turns: DataFrame, part_turns: int = PART_TURNS) -> DataFrame:
    """The query's rows: the trie of the rebuilt conversations, with each node's digest of the ids that end there."""
    convs = saved(conversations(turns), "conversations")
    seqs = saved(sequences(rebuilt(convs)), "sequences")
    drop_saved(convs)
    nodes = prefix_trie(seqs, part_turns)
    done = end_digests(ends(seqs)).withColumnRenamed("node", "ended")
    none = hashlib.sha256().hexdigest()
    return nodes.join(done, nodes.node == done.ended, "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"))
