"""Operator 8: removal of lines that are spread over many sites.

A line's site spread is estimated by a HyperLogLog sketch of the sources that
show it, one sketch per line hash, merged by aggregation. An estimate of
twice ``min_sites`` or more is far above the threshold and one under half of
it far below; lines between get an exact distinct count. A line on ``min_sites``
or more sites is boilerplate: its first occurrence (lowest id, then place)
stays, the others go.

Defined results: lines are compared without white space at their ends; a line
without a word is never removed; a null source isn't a site; a null text stays
null. The first occurrence stays in each row that repeats its row. A document
may become empty. Lines are told apart by 64-bit hashes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bizlens.llm.common import free_name, saved

MIN_SITES = 8
BLANK = " \t\x0b\x0c\r"


def _lines(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    text = F.col(text_col).cast("string")
    d = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("th"), F.col(source_col).cast("string").alias("site"),
                    F.posexplode(F.split(text, "\n")).alias("pos", "line"))
    return (d.where(F.length(F.translate("line", BLANK, "")) > 0)
            .select("id", "th", "site", "pos", F.xxhash64(F.trim("line", F.lit(BLANK))).alias("h")))


def boilerplate(lines: DataFrame, min_sites: int) -> DataFrame:
    """``h, first`` of the lines on ``min_sites`` sites or more."""
    spread = saved(lines.groupBy("h").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(10))).alias("sites"),
                                          F.min(F.struct("id", "th", "pos")).alias("first"))
                   .where(F.col("sites") * 2 >= min_sites), "spread")
    far = spread.where(F.col("sites") >= 2 * min_sites)
    near = spread.where(F.col("sites") < 2 * min_sites)
    exact = (lines.join(near.select("h"), "h").select("h", "site").where("site is not null").distinct()
             .groupBy("h").count().where(F.col("count") >= min_sites))
    return far.select("h", "first").unionByName(near.join(exact, "h").select("h", "first"))


def dedup_lines(docs: DataFrame, min_sites: int = MIN_SITES, id_col: str = "doc_id", text_col: str = "text",
                source_col: str = "source", count_col: str = "n_removed_lines") -> DataFrame:
    """The rows with their boilerplate lines removed from the text, and ``count_col`` (replaced if there)."""
    lines = saved(_lines(docs, id_col, text_col, source_col), "lines")
    gone = (lines.join(boilerplate(lines, min_sites), "h")
            .where(~F.struct("id", "th", "pos").eqNullSafe(F.col("first")))
            .groupBy("id", "th").agg(F.collect_set("pos").alias("gone")))
    key, drop, pieces = (free_name(docs, x) for x in ("_key", "_gone", "_pieces"))
    gone = gone.select(F.struct("id", "th").alias("_row"), F.col("gone").alias(drop))
    text = F.col(text_col).cast("string")
    named = docs.withColumns({key: F.struct(F.col(id_col).alias("id"), F.xxhash64(text).alias("th")),
                              pieces: F.split(text, "\n")})
    joined = named.join(gone, named[key].eqNullSafe(gone["_row"]), "left")
    kept = F.expr(f"array_join(transform(array_except(sequence(0, size(`{pieces}`) - 1), `{drop}`), "
                  f"i -> `{pieces}`[i]), '\\n')")
    return joined.select(
        *[F.when(F.col(drop).isNull(), text).otherwise(kept).alias(c) if c == text_col else named[c]
          for c in docs.columns if c != count_col],
        F.coalesce(F.size(drop), F.lit(0)).cast("long").alias(count_col))
