"""Operator 7: shards as the leaves of a k-d tree over document metadata.

A node is split along its widest dimension (its range as a share of the
table's) at the median weighted by size in bytes, until the leaves reach the
target. The dimensions are the text's length on a log scale, its language, its
source and its id. In each, a row's key is 30 bits of its value and then 32
bits of a hash of the row and of its number among equal rows, so a value that a
third of all rows share, or a row that is repeated as often, is split as evenly
as any other. The medians of a level's nodes are found together, by
sums over 4,096 bins of the key, again inside the bin that holds the median,
until that bin weighs next to nothing: no sort and no collected rows. Per node
its bounds and its median reach the driver, nothing else.

Law ``bytes``: the shards' sizes are near equal (a shard of ``m`` leaves is cut
at ``m // 2 / m`` of its bytes). Defined results: a null text has size 1 and
checksum 0; null names are a name like any other, a null id is the smallest;
repeated rows each get a row and a slot of their own; an empty table has no
rows. Slots run from 0 without gaps in each shard.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bizlens.llm.common import saved, small_table
from bizlens.operators.ranking import global_position

VALUE_BITS, TIE_BITS, STEP_BITS = 30, 32, 12
SLOT_BLOCK = 4096               # rows numbered together
DIMENSIONS = ["length", "lang", "source", "id"]


def _metadata(docs: DataFrame, id_col: str, text_col: str, lang_col: str, source_col: str) -> DataFrame:
    """One narrow row per document: size, checksum and its raw value in each dimension."""
    data = F.col(text_col).cast("string").cast("binary")
    size = (F.coalesce(F.octet_length(data), F.lit(0)) + 1).cast("long")
    name = lambda c: F.shiftrightunsigned(F.xxhash64(F.col(c).cast("string")), 64 - VALUE_BITS)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), size.alias("size"),
                       F.coalesce(F.crc32(data), F.lit(0).cast("long")).alias("text_crc32"),
                       F.log2(size).alias("length"), name(lang_col).cast("double").alias("lang"),
                       name(source_col).cast("double").alias("source"))
    return rows.withColumn("id", F.col("doc_id").cast("double"))


def _numbered(rows: DataFrame) -> DataFrame:
    """``rows`` with ``tie``, a hash of the row and of its place among the rows that are equal to it.

    The places come from a global order, in which equal rows are cut anywhere:
    no window or task holds all of them. Which of them gets which place doesn't matter.
    """
    same = ["doc_id", "size", "text_crc32", "lang", "source"]
    alike = F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in same])
    rows = rows.withColumns({"alike": alike, "_salt": F.monotonically_increasing_id()})
    placed = global_position(rows, "alike", *same, "_salt", name="_place")
    first = placed.groupBy("alike").agg(F.min("_place").alias("_first"))
    tie = F.xxhash64("alike", F.col("_place") - F.col("_first")).bitwiseAND((1 << TIE_BITS) - 1)
    return placed.join(first, "alike").withColumn("tie", tie).drop("alike", "_salt", "_place", "_first")


def _keyed(rows: DataFrame) -> DataFrame:
    """Each dimension as a 62-bit key over the table's whole range."""
    bounds = rows.agg(*[f(d).alias(f"{n}_{d}") for d in DIMENSIONS for n, f in (("lo", F.min), ("hi", F.max))]).first()
    keys = {}
    for d in DIMENSIONS:
        lo, hi = bounds[f"lo_{d}"], bounds[f"hi_{d}"]
        width = (hi - lo) if lo is not None and hi > lo else 1.0
        share = (F.coalesce(F.col(d), F.lit(lo)) - F.lit(lo or 0.0)) / F.lit(width)
        value = F.floor(share * F.lit(float((1 << VALUE_BITS) - 1))).cast("long")
        keys[f"k_{d}"] = F.coalesce(value, F.lit(0).cast("long")) * F.lit(1 << TIE_BITS) + F.col("tie")
    return rows.select("doc_id", "size", "text_crc32", "tie", *[k.alias(n) for n, k in keys.items()])


def _key_of(dim: str) -> Column:
    return F.expr(f"case {dim} " + " ".join(f"when {i} then k_{d}" for i, d in enumerate(DIMENSIONS)) + " end")


def _cuts(rows: DataFrame, nodes: dict[int, dict], tolerance: int) -> dict[int, int]:
    """Per node the key at which its right half begins."""
    spark = rows.sparkSession
    bits = VALUE_BITS + TIE_BITS
    open_ = {n: {"dim": x["dim"], "prefix": 0, "want": x["want"]} for n, x in nodes.items()}
    cuts: dict[int, int] = {}
    while open_:
        step = min(STEP_BITS, bits)
        state = small_table(spark, {"node": pa.array(open_, pa.int64()), **{
            name: pa.array([x[name] for x in open_.values()], pa.int64()) for name in ("dim", "prefix", "want")}})
        key = _key_of("dim")
        bins = (rows.join(F.broadcast(state), "node").where(F.shiftright(key, bits) == F.col("prefix"))
                .groupBy("node", "want", F.shiftright(key, bits - step).alias("bin"))
                .agg(F.sum("size").alias("bytes"), F.count("*").alias("n")))
        run = bins.withColumn("upto", F.expr("sum(bytes) over (partition by node order by bin)"))
        found = (run.where("upto >= want").groupBy("node")
                 .agg(F.min(F.struct("bin", "upto", "bytes", "n", "want")).alias("x")).collect())
        bits -= step
        for node, x in ((r.node, r.x) for r in found):
            inside = x.want - (x.upto - x.bytes)             # bytes of the bin that go left
            if bits == 0 or x.n == 1 or x.bytes <= tolerance:
                cuts[node] = (x.bin + (2 * inside >= x.bytes)) << bits
                del open_[node]
            else:
                open_[node] |= {"prefix": x.bin, "want": inside}
    return cuts


def kd_shards(docs: DataFrame, target_bytes: int | None = None, shards: int | None = None,
              id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
              source_col: str = "source") -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` of every row.

    Give the number of shards, or the bytes that a shard should reach.
    """
    spark = docs.sparkSession
    keyed = saved(_keyed(saved(_numbered(saved(
        _metadata(docs, id_col, text_col, lang_col, source_col), "metadata")), "numbered")), "keys")
    total = keyed.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    count = shards or max(1, -(-total // target_bytes))
    tolerance = total // (count * 4096)
    rows = keyed.withColumn("node", F.lit(1).cast("long"))
    leaves, first = {1: count}, {1: 0}                       # leaves below a node, and its first shard
    while any(m > 1 for m in leaves.values()):
        stats = rows.groupBy("node").agg(
            F.sum("size").alias("bytes"), *[(F.max(f"k_{d}") - F.min(f"k_{d}")).alias(d) for d in DIMENSIONS]).collect()
        split = {}
        for r in stats:
            m = leaves.get(r.node, 1)
            if m > 1:
                widest = max(range(len(DIMENSIONS)), key=lambda i: r[DIMENSIONS[i]])
                split[r.node] = {"dim": widest, "want": max(1, r.bytes * (m // 2) // m)}
        if not split:
            break
        cuts = _cuts(rows, split, tolerance)
        table = small_table(spark, {"node": pa.array(cuts, pa.int64()), "cut": pa.array(cuts.values(), pa.int64()),
                                    "dim": pa.array([split[n]["dim"] for n in cuts], pa.int64())})
        right = F.when(_key_of("dim") >= F.col("cut"), 1).otherwise(0)
        rows = (rows.join(F.broadcast(table), "node", "left")
                .withColumn("node", F.when(F.col("dim").isNull(), F.col("node"))
                            .otherwise(F.col("node") * 2 + right)).drop("dim", "cut"))
        for n in split:
            m, at = leaves.pop(n), first.pop(n)
            for child, k, a in ((2 * n, m // 2, at), (2 * n + 1, m - m // 2, at + m // 2)):
                leaves[child], first[child] = k, a
    numbers = small_table(spark, {"node": pa.array(first, pa.int64()), "shard": pa.array(first.values(), pa.int32())})
    return _slotted(rows.join(F.broadcast(numbers), "node"))


def _slotted(rows: DataFrame) -> DataFrame:
    """Number a shard's rows in blocks by hash, and the blocks by their sizes' running sum."""
    sizes = rows.groupBy("shard").agg(F.ceil(F.count("*") / SLOT_BLOCK).alias("blocks"))
    rows = rows.join(F.broadcast(sizes), "shard").withColumn("block", F.expr("pmod(tie, blocks)"))
    begins = (rows.groupBy("shard", "block").agg(F.count("*").alias("n"))
              .withColumn("begin", F.expr("sum(n) over (partition by shard order by block) - n")))
    place = F.expr("row_number() over (partition by shard, block order by doc_id, text_crc32, size)")
    return (rows.withColumn("place", place).join(begins.drop("n"), ["shard", "block"])
            .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
                    (F.col("begin") + F.col("place") - 1).cast("long").alias("slot"),
                    F.lit(None).cast("int").alias("grown_shard")))
