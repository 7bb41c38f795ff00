"""Connected components of an edge table, without collecting anything."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bizlens.llm.common import drop_saved, saved


def _digest(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of the edges ``(a, b)``; the root is the smallest node.

    Large-star and small-star steps (Kiveris et al. 2014) until nothing
    changes. Each step is a grouped minimum and a join, so a node with very
    many edges is combined on the map side and its join partition can be split.
    """
    e = saved(edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
              .distinct(), "edges")
    before = _digest(e)
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = (both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .distinct())
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        old, e = e, saved(small.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                       .unionByName(small.select("u", F.col("m").alias("v"))).distinct(), "edges")
        drop_saved(old)
        after = _digest(e)
        if after == before:
            roots = e.select(F.col("v").alias("node"), F.col("v").alias("root"))
            return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots).distinct()
        before = after
