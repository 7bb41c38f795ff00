"""Operator 5: n-gram Jaccard join by parity sketches.

Documents are linked when their shingle sets have a Jaccard similarity of at
least 0.85, and get the smallest id they reach by links.

1. Equal sets are one class from the start, so exact copies never meet.
2. Each class is looked up by the blocks of its parity sketch, per size band
   (``jaccard_sketch``): linked sets share a block, so none is missed.
3. In each block's bucket, one class is compared with the others ("star"),
   twice with different choices. That connects almost every group of near
   copies with a few comparisons a document.
4. What is then still in different components is compared in full, in bounded
   squares of a bucket: a pair whose sketches' Hamming distance already shows
   too many different shingles is passed over, the rest is verified. Near
   copies meet in many buckets: each class brings its ``LOW`` lowest ones, and
   a bucket leaves a pair to a lower one that both have.
5. Every pair is first tried by its dense sketches, a bit a shingle: their
   Hamming distance never exceeds the sets' difference. Only for what is left
   both whole texts are read and their exact sets compared; a text that is
   compared with many others is sent once for up to ``FAN`` of them.

Defined results: a null or blank text has no shingles, size 0, and is alone
in its component. Rows with the same id and repeated rows each get a row. Rows
without an id take part, but give a component neither its id nor its first
document, unless it has such rows only: its id is null then.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bizlens.llm.common import byte_rows, chunked, drop_saved, free_name, saved
from bizlens.llm.components import components
from bizlens.llm.jaccard_sketch import (FULL, LINK, WORDS, Bands, block_keys, class_of, distance, folded,
                                        parity_bits, running_xor, shingle_sets)

SQUARE = 512            # classes on a side of a square of comparisons
LOW = 64                # of a class's buckets, how many every bucket knows, so that a pair is not given by each of them
FAN = 256               # texts that are compared with one copy of another, on average at most
SLICE = 1 << 17         # members of squares that are always compared in one go; more only up to half of the mixed buckets' members


def _sets(batches: Iterator[pa.RecordBatch], column: str, words: int):
    for batch in batches:
        rows = byte_rows(batch.column(column))
        for i, j in chunked(rows):
            yield batch.slice(i, j - i), shingle_sets(rows[i:j], words)


def _classify(words: int):
    def run(batches):
        for part, sets in _sets(batches, "text", words):
            yield pa.RecordBatch.from_arrays(
                [part.column("id"), part.column("th"), pa.array([len(s) for s in sets], pa.int64()),
                 pa.array([class_of(s) if len(s) else None for s in sets], pa.int64())],
                names=["id", "th", "n", "c"])
    return run


def _emit(words: int, bands: Bands):
    def run(batches):
        done: set[int] = set()
        for _, sets in _sets(batches, "text", words):
            keys, owner = [], []
            for s in sets:
                if not len(s):
                    continue
                c = class_of(s)
                if c in done:
                    continue
                done.add(c)
                running = running_xor(s)
                for band, _up in bands.homes(len(s)):
                    k = block_keys(s, running, band, *bands.blocks(band))
                    keys.append(k)
                    owner.append(np.full(len(k), c, dtype=np.int64))
            if keys:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(owner))],
                    names=["key", "c"])
    return run


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by (key, c): those whose key has another class. Streams; holds one row back."""
    none = np.zeros(0, dtype=np.int64)
    key, c, joined = none, none, False       # the row held back, and whether its key began before it
    for batch in batches:
        k = np.concatenate([key, batch.column(0).to_numpy()])
        v = np.concatenate([c, batch.column(1).to_numpy()])
        new = np.ones(len(k), dtype=bool)
        new[1:] = (k[1:] != k[:-1]) | (v[1:] != v[:-1])
        k, v = k[new], v[new]
        if not len(k):
            continue
        same = k[1:] == k[:-1]
        take = np.zeros(len(k), dtype=bool)
        take[1:] |= same
        take[:-1] |= same
        take[0] |= joined
        key, c, joined = k[-1:], v[-1:], bool(take[-1])
        yield pa.RecordBatch.from_arrays([pa.array(k[:-1][take[:-1]]), pa.array(v[:-1][take[:-1]])],
                                         names=["key", "c"])
    if joined:
        yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(c)], names=["key", "c"])


def _near(link: int, full: int):
    """The pairs whose sketches' Hamming distance leaves a link possible."""
    def run(batches):
        for batch in batches:
            size = batch.column("na").to_numpy() + batch.column("nb").to_numpy()
            bits = [[np.frombuffer(x, np.uint64) for x in batch.column(c).to_pylist()] for c in ("bits_a", "bits_b")]
            far = np.array([distance(x, y) for x, y in zip(*bits)], dtype=np.int64)
            ok = (full + link) * far <= (full - link) * size
            yield batch.select(["a", "b"]).filter(pa.array(ok))
    return run


def _linked(words: int, link: int, full: int):
    """Of rows sorted by (a, part), a's own row (b is null) first: the pairs whose whole texts' sets are linked."""
    def run(batches):
        lead, mine = None, None
        for batch in batches:
            a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            texts = byte_rows(batch.column("text"))
            ok = np.zeros(len(a), dtype=bool)
            for i, j in chunked(texts):
                for at, s in enumerate(shingle_sets(texts[i:j], words), i):
                    if b[at] is None:
                        lead, mine = a[at], s
                        continue
                    assert a[at] == lead
                    both = len(np.intersect1d(mine, s, assume_unique=True))
                    ok[at] = full * both >= link * (len(mine) + len(s) - both)
            yield batch.select(["a", "b"]).filter(pa.array(ok))
    return run


def _sketches(words: int):
    def run(batches):
        for part, sets in _sets(batches, "text", words):
            bits = [parity_bits(s).tobytes() for s in sets]
            yield pa.RecordBatch.from_arrays([part.column("c"), part.column("n"), pa.array(bits, pa.binary())],
                                             names=["c", "n", "bits"])
    return run


def _square(link: int, full: int):
    """Pairs of one square's classes that are in different components, may be linked and have no lower bucket in ``low``.

    The lowest bucket of both never leaves a pair out, so each is given at least once.
    """
    def run(batches):
        for group in _groups(batches, ("key", "left", "right")):
            c, comp, n = (group.column(x).to_numpy() for x in ("c", "comp", "n"))
            part = group.column("part").to_numpy()
            bits = [np.frombuffer(x, np.uint64) for x in group.column("bits").to_pylist()]
            width = min(len(x) for x in bits)
            bits = np.stack([folded(x, width) for x in bits])
            key, left, right = (group.column(x)[0].as_py() for x in ("key", "left", "right"))
            lower = [np.array(x, dtype=np.int64) for x in group.column("low").to_pylist()]
            lower = [x[x < key] for x in lower]
            known = np.full((len(c), max(len(x) for x in lower)), key, dtype=np.int64)     # the rest of a row: no lower key
            for x, row in zip(lower, known):
                row[:len(x)] = x
            rows, cols = np.flatnonzero(part == left), np.flatnonzero(part == right)
            a, b = [], []
            for r in rows:
                far = np.bitwise_count(bits[cols] ^ bits[r]).sum(axis=1, dtype=np.int64)
                size = n[cols] + n[r]
                ok = ((comp[cols] != comp[r]) & ((full + link) * far <= (full - link) * size)
                      & (full * np.minimum(n[cols], n[r]) >= link * np.maximum(n[cols], n[r])))
                if left == right:
                    ok &= cols > r
                met = cols[ok]
                met = met[~np.isin(known[met], lower[r]).any(axis=1)]
                a.append(np.full(len(met), c[r]))
                b.append(c[met])
            a, b = np.concatenate(a), np.concatenate(b)
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))],
                                             names=["a", "b"])
    return run


def _groups(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[pa.Table]:
    """Runs of equal keys in sorted batches, one table each; only one run is held."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(k).to_numpy() for k in keys]
        cut = np.flatnonzero(np.any([x[1:] != x[:-1] for x in cols], axis=0)) + 1
        edges = [0, *cut.tolist(), batch.num_rows]
        for i, j in zip(edges[:-1], edges[1:]):
            run = batch.slice(i, j - i)
            if held and any(held[-1].column(k)[0] != run.column(k)[0] for k in keys):
                yield pa.Table.from_batches(held).combine_chunks()
                held = []
            held.append(run)
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _row_hash(id_: Column, th: Column) -> Column:
    return F.xxhash64(id_, th)


def _same_row(id_a: Column, th_a: Column, id_b: Column, th_b: Column) -> Column:
    """Equal text hashes and ids (null and null too), told by exclusive or: so only the row hash is the join's key,
    and what is grouped by it afterwards needs no second shuffle of the texts."""
    none, zero = lambda x: x.isNull().cast("long"), F.lit(0).cast("long")
    differ = (th_a.bitwiseXOR(th_b).bitwiseOR(none(id_a).bitwiseXOR(none(id_b)))
              .bitwiseOR(F.coalesce(id_a, zero).bitwiseXOR(F.coalesce(id_b, zero))))
    return differ == 0


class JaccardJoin:
    """The join over a table of texts; intermediate tables lie in the shared folder."""

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS,
                 link: int = LINK, full: int = FULL):
        self.words, self.link, self.full = words, link, full
        self.bands = Bands(link, full)
        text = F.col(text_col).cast("string")
        self.docs = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"),
                                F.xxhash64(text).alias("th"))

    def classified(self) -> DataFrame:
        """``(id, th, n, c)`` of every row: text hash, size of its set, class (null: empty set)."""
        return saved(self.docs.mapInArrow(_classify(self.words), "id long, th long, n long, c long"), "sets")

    def buckets(self) -> DataFrame:
        """``(key, c)`` of the sketch blocks that two or more classes have."""
        keys = self.docs.select("text").mapInArrow(_emit(self.words, self.bands), "key long, c long")
        return saved(keys.repartition("key").sortWithinPartitions("key", "c")
                     .mapInArrow(_shared, "key long, c long"), "buckets")

    def near(self, pairs: DataFrame, sketches: DataFrame) -> DataFrame:
        """The pairs ``(a, b)`` that their sketches allow to be linked."""
        a, b = (sketches.select(F.col("c").alias(x), F.col("n").alias(f"n{x}"), F.col("bits").alias(f"bits_{x}"))
                for x in "ab")
        return saved(pairs.join(a.hint("merge"), "a").join(b.hint("merge"), "b")
                     .mapInArrow(_near(self.link, self.full), "a long, b long"), "pairs")

    def verified(self, pairs: DataFrame, texts: DataFrame) -> DataFrame:
        """The pairs ``(a, b)`` whose whole texts' sets are linked; ``pairs`` is a saved table."""
        fan = pairs.groupBy("a").agg(F.ceil(F.count("*") / FAN).alias("parts"))
        leads = (fan.join(texts.hint("merge"), fan.a == texts.c)
                 .select("a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"),
                         F.lit(None).cast("long").alias("b"), "text"))
        others = (pairs.join(fan.hint("merge"), "a").join(texts.hint("merge"), F.col("b") == texts.c)
                  .select("a", F.expr("pmod(xxhash64(b), parts)").alias("part"), "b", "text"))
        return saved(leads.unionByName(others).repartition("a", "part").sortWithinPartitions("a", "part", "b")
                     .mapInArrow(_linked(self.words, self.link, self.full), "a long, b long"), "links")

    def star(self, members: DataFrame, turn: int) -> DataFrame:
        """Pairs of each bucket's leader with the bucket's classes of other components."""
        order = F.xxhash64("c", F.col("key") % 4, F.lit(turn))
        lead = (members.groupBy("key").agg(F.min(F.struct(order.alias("o"), "c", "n", "comp")).alias("l"),
                                           F.min("comp").alias("lo"), F.max("comp").alias("hi"))
                .where("lo != hi").select("key", F.col("l.c").alias("lc"), F.col("l.n").alias("ln"),
                                          F.col("l.comp").alias("lcomp")))
        near = F.expr(f"{self.full} * least(n, ln) >= {self.link} * greatest(n, ln)")
        return (members.join(lead, "key").where((F.col("comp") != F.col("lcomp")) & near)
                .select(F.least("c", "lc").alias("a"), F.greatest("c", "lc").alias("b")).distinct())

    def mixed(self, members: DataFrame) -> DataFrame:
        """The members of buckets with classes of different components, each with one of its bucket's ``parts``.

        Saved, so that the shuffles that lead to it are gone when the comparisons need the disk.
        """
        open_ = (members.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"),
                                            F.count("*").alias("size")).where("lo != hi and size > 2")
                 .select("key", F.ceil(F.col("size") / SQUARE).alias("parts")))
        return saved(members.join(open_, "key").withColumn("part", F.expr("pmod(xxhash64(c), parts)")), "mixed")

    def rest(self, m: DataFrame, sketches: DataFrame) -> DataFrame:
        """Pairs of classes of a mixed bucket in different components that their sketches allow to be linked.

        A bucket's members come once for each of its parts, with their sketches, so what is shuffled grows with the
        square of a large bucket. The squares are dealt into slices by their hash, each compared and saved before the next:
        the disk holds one slice, of about half as many rows as the buckets have members, however large a bucket is.
        """
        low = m.groupBy("c").agg(F.slice(F.sort_array(F.collect_set("key")), 1, LOW).alias("low"))
        known = saved(sketches.select("c", "bits").join(low.hint("merge"), "c"), "known")
        members, rows = m.agg(F.count("*"), F.coalesce(F.sum("parts"), F.lit(0))).first()
        slices = max(1, -(-rows // max(members // 2, SLICE)))
        m = (m.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
             .select("key", F.least("part", "other").alias("left"), F.greatest("part", "other").alias("right"),
                     "part", "c", "comp", "n"))
        keys = ["key", "left", "right"]
        found = []
        for i in range(slices):
            some = m.where(F.pmod(F.xxhash64(*keys), F.lit(slices)) == i).join(known.hint("merge"), "c")
            some = some.withColumn("low", F.filter("low", lambda x: x < F.col("key")))
            found.append(saved(some.repartition(*keys).sortWithinPartitions(*keys)
                               .mapInArrow(_square(self.link, self.full), "a long, b long").distinct(), "squares"))
        drop_saved(known)
        self.squares = found                # what the result still reads
        return reduce(DataFrame.unionByName, found).distinct()

    def run(self) -> DataFrame:
        """``doc_id, n_shingles, component_id`` of every row, its text's hash, and whether it is its component's first."""
        rows = self.classified()
        first = F.struct(F.col("id").isNull().alias("no_id"), "id", "th")
        classes = (rows.where("c is not null").groupBy("c")
                   .agg(F.min(first).alias("r"), F.first("n").alias("n")))
        buckets = self.buckets()
        found = saved(classes.join(buckets.select("c").distinct(), "c", "left_semi")
                      .select("c", "n", "r.id", "r.th"), "classes")
        # both sides grow with the table: joined by a shuffle at every size
        docs = self.docs.withColumn("k", _row_hash(F.col("id"), F.col("th")))
        lead = found.withColumn("k", _row_hash(F.col("id"), F.col("th")))
        texts = saved(docs.join(lead.hint("merge"), (docs.k == lead.k) & _same_row(docs.id, docs.th, lead.id, lead.th))
                      .select(lead.k, "c", "n", "text").dropDuplicates(["k", "c"]).drop("k"), "texts")
        sketches = saved(texts.mapInArrow(_sketches(self.words), "c long, n long, bits binary"), "sketches")
        members = buckets.join(found.select("c", "n").hint("merge"), "c")
        links, inner = None, [texts, sketches]
        for turn in range(3):
            if links is None:
                now = members.withColumn("comp", F.col("c"))
            else:
                root = components(links)
                now = (members.join(root, members.c == root.node, "left")
                       .select("key", "c", "n", F.coalesce("root", "c").alias("comp")))
            if turn < 2:
                near = self.star(now, turn)
            else:
                mixed = self.mixed(now)
                drop_saved(buckets, found)          # the members were all that still read them
                near = self.rest(mixed, sketches)
                drop_saved(mixed)
                inner += self.squares
            pairs = self.near(near, sketches)
            more = self.verified(pairs, texts)
            inner += [pairs, more]
            links = more if links is None else links.unionByName(more)
        root = saved(components(links), "roots")
        drop_saved(*inner)
        self.inner = [rows, root]           # what the result still reads
        classes = (classes.join(root, F.col("c") == root.node, "left")
                   .select("c", F.col("r").alias("r"), F.coalesce("root", "c").alias("root")))
        lowest = classes.groupBy("root").agg(F.min("r").alias("first"))
        classes = classes.join(lowest, "root").select("c", "first")
        return rows.join(classes, "c", "left").select(
            F.col("id").alias("doc_id"), F.col("th").alias("text_hash"), F.col("n").alias("n_shingles"),
            F.when(F.col("c").isNull(), F.col("id")).otherwise(F.col("first.id")).alias("component_id"),
            (F.col("c").isNull() | (F.col("id").eqNullSafe(F.col("first.id")) & (F.col("th") == F.col("first.th"))))
            .alias("is_first"))


def jaccard_components(docs: DataFrame, **options) -> DataFrame:
    """Component of every document; see ``JaccardJoin``."""
    return JaccardJoin(docs, **options).run()


def one_per_component(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The first document (lowest id, then text hash; no id last) of each component, with all its columns.

    Rows that share id and text are one document.
    """
    join = JaccardJoin(docs, id_col=id_col, text_col=text_col, **options)
    found = saved(join.run().where("is_first").select("doc_id", "text_hash").distinct(), "firsts")
    drop_saved(*join.inner)
    key, hashed = free_name(docs, "_row"), free_name(docs, "_row_hash")
    id_, th = F.col(id_col).cast("long"), F.xxhash64(F.col(text_col).cast("string"))
    named = docs.withColumn(key, F.struct(id_.alias("id"), th.alias("th"))).withColumn(hashed, _row_hash(id_, th))
    first = found.select("doc_id", "text_hash", _row_hash(F.col("doc_id"), F.col("text_hash")).alias("_hash"))
    kept = named.join(first, (named[hashed] == first["_hash"]) & _same_row(
        named[key]["id"], named[key]["th"], first["doc_id"], first["text_hash"]), "left_semi")
    return kept.dropDuplicates([hashed, key]).drop(key, hashed)
