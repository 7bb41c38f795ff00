"""Operator 2: benchmark decontamination by SimHash windows, in DataFrame functions only.

1. Words are runs of letters and digits, lower-cased; shingles have five.
   A window can only resemble an item if it holds one of the benchmark's
   shingles, so windows are laid out around those places alone: as long as an
   item and so that the place falls where an item has that shingle, or up to
   ``REACH`` words beside it (insertions and deletions move the rest).
2. Each window and each item gets a 64-bit SimHash of its shingles, weighted by
   how often they occur.
3. Fingerprints are cut into ``RADIUS + 1`` blocks. Two within the radius agree
   in one block at least, so a join on (length, block, value) finds them all.
4. Of the pairs within the radius, the exact weighted Jaccard similarity of
   the shingles, ``sum(min) / sum(max)`` of their numbers, decides: 0.8 or more.

The radius leaves out a pair of similarity 0.8 with a chance of about 0.0006
(3.2 standard deviations), and each passage has several windows.

Defined results: a null or short text matches nothing, nor does an item with
fewer than five words. Repeated documents and repeated items each match.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bizlens.llm.common import free_name, saved

WORDS, BITS, RADIUS, REACH = 5, 64, 19, 2
NUMERATOR, DENOMINATOR = 4, 5           # similarity of 0.8
SMALL_BENCHMARK = 1 << 20               # shingles that are still broadcast (under 50 MB)
_LANES, _LANE_BITS = 3, 21              # bit counters in one long; up to 2 million shingles a window


def words_of(text: Column) -> Column:
    plain = F.regexp_replace(F.lower(F.coalesce(text.cast("string"), F.lit(""))), r"[^\p{L}\p{N}]+", " ")
    return F.array_remove(F.split(plain, " "), "")


def _hashes(words: str) -> Column:
    at = ", ".join(f"{words}[i + {k}]" for k in range(WORDS))
    return F.expr(f"if(size({words}) < {WORDS}, cast(array() as array<bigint>), "
                  f"transform(sequence(0, size({words}) - {WORDS}), i -> xxhash64({at})))")


def _counted_shingles(words: str) -> Column:
    """Each shingle's words and which occurrence of it this is: sets of these compare as multisets."""
    at = ", ".join(f"{words}[i + {k}]" for k in range(WORDS))
    made = f"sort_array(transform(sequence(0, size({words}) - {WORDS}), i -> concat_ws(' ', {at})))"
    return F.expr(f"transform(array({made}), s -> transform(s, (x, i) -> concat(x, '#', i - array_position(s, x))))[0]")


def simhash(windows: DataFrame, by: list[str], words: str) -> DataFrame:
    """``by`` and the SimHash of each row's words."""
    h = windows.select(*by, F.explode(_hashes(words)).alias("h"))
    lanes = []
    for first in range(0, BITS, _LANES):
        terms = [f"shiftleft(shiftright(h, {b}) & 1L, {_LANE_BITS * k})"
                 for k, b in enumerate(range(first, min(first + _LANES, BITS)))]
        lanes.append(F.expr("sum(" + " | ".join(terms) + ")").alias(f"lane{first // _LANES}"))
    sums = h.groupBy(*by).agg(F.count("*").alias("total"), *lanes)
    mask = (1 << _LANE_BITS) - 1
    bits = [f"if(2 * (shiftright(lane{b // _LANES}, {_LANE_BITS * (b % _LANES)}) & {mask}L) > total, "
            f"shiftleft(1L, {b}), 0L)" for b in range(BITS)]
    while len(bits) > 1:
        bits = [f"({' | '.join(bits[i:i + 8])})" for i in range(0, len(bits), 8)]
    return sums.select(*by, F.expr(bits[0]).alias("fp"))


def _blocks(rows: DataFrame) -> DataFrame:
    """A row per block of the fingerprint."""
    edges = [BITS * i // (RADIUS + 1) for i in range(RADIUS + 2)]
    values = [f"named_struct('block', {i}, 'value', shiftright(fp, {a}) & {(1 << (b - a)) - 1}L)"
              for i, (a, b) in enumerate(zip(edges[:-1], edges[1:]))]
    return rows.select("*", F.expr(f"inline(array({', '.join(values)}))"))


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``doc_id, item_id, start_word, n_words, similarity``: each document's best window for each item it holds.

    ``text_hash`` (xxhash64 of the text) tells rows with the same id apart.
    """
    items = saved(benchmark.select(F.col(item_col).alias("item_id"), words_of(F.col(item_text_col)).alias("iw"))
                  .where(F.size("iw") >= WORDS)
                  .select("item_id", "iw", F.size("iw").alias("n"), F.expr("uuid()").alias("item_row")), "items")
    places = (items.select("n", F.posexplode(_hashes("iw")).alias("at", "h")).distinct())
    if places.count() <= SMALL_BENCHMARK:
        places = F.broadcast(places)
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("t"))
    split = rows.select("doc_id", "text_hash", words_of(F.col("t")).alias("w"))
    hits = split.select("doc_id", "text_hash", F.posexplode(_hashes("w")).alias("pos", "h")).join(places, "h")
    starts = (hits.select("doc_id", "text_hash", "n", (F.col("pos") - F.col("at")).alias("s")).distinct()
              .groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("s", "n")).alias("places")))
    found = saved(starts, "places").withColumnsRenamed({"doc_id": "d", "text_hash": "x"})
    held = rows.join(
        found, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("x")))
    near = (f"array_distinct(flatten(transform(places, p -> transform(sequence(-{REACH}, {REACH}), k -> "
            "named_struct('s', greatest(0, least(p.s + k, size(w) - p.n)), 'n', p.n)))))")
    windows = (held.select("doc_id", "text_hash", words_of(F.col("t")).alias("w"), "places")
               .select("doc_id", "text_hash", "w", F.expr(f"inline({near})"))
               .select("doc_id", "text_hash", "s", "n", F.expr("slice(w, s + 1, n)").alias("ww"))
               .where(F.size("ww") >= WORDS))
    windows = saved(windows, "windows")
    key = ["doc_id", "text_hash", "s", "n"]
    prints = _blocks(simhash(windows, key, "ww"))
    item_prints = _blocks(simhash(items, ["item_row", "n"], "iw")).withColumnRenamed("fp", "ifp")
    pairs = (prints.join(item_prints, ["n", "block", "value"])
             .where(F.bit_count(F.col("fp").bitwiseXOR(F.col("ifp"))) <= RADIUS)
             .select(*key, "item_row").distinct())
    sets = windows.dropDuplicates(key).withColumnsRenamed({k: f"w_{k}" for k in key})
    same = [F.col(k).eqNullSafe(F.col(f"w_{k}")) for k in key]
    both = pairs.join(sets, same).join(items.drop("n"), "item_row")
    both = both.select(*key, "item_row", "item_id", _counted_shingles("ww").alias("a"),
                       _counted_shingles("iw").alias("b"))
    both = both.withColumn("i", F.size(F.array_intersect("a", "b")))
    both = both.withColumn("u", F.size("a") + F.size("b") - F.col("i"))
    hit = both.where(F.lit(DENOMINATOR) * F.col("i") >= F.lit(NUMERATOR) * F.col("u"))
    best = hit.groupBy("doc_id", "text_hash", "item_row", "item_id").agg(
        F.max(F.struct((F.col("i") / F.col("u")).alias("similarity"), (-F.col("s")).alias("s"), "n")).alias("m"))
    return best.select("doc_id", "item_id", (-F.col("m.s")).cast("long").alias("start_word"),
                       F.col("m.n").cast("long").alias("n_words"), F.col("m.similarity").alias("similarity"),
                       "text_hash")


def without_benchmark(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id",
                      text_col: str = "text") -> DataFrame:
    """The documents that hold no benchmark item, with all their columns."""
    row = F.struct(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col).cast("string")).alias("th"))
    bad = contaminated(docs, benchmark, id_col, text_col).select(
        F.struct(F.col("doc_id").alias("id"), F.col("text_hash").alias("th")).alias(free_name(docs, "_bad"))).distinct()
    return docs.join(bad, row.eqNullSafe(F.col(bad.columns[0])), "left_anti")
