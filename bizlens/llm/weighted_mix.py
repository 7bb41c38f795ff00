"""Operator 11: mixing sources to target weights by weighted fair queueing.

Each source is a queue of its documents in shuffled order, served again from
the start in every further epoch. A copy's virtual finish time is the words of
its source up to its end, over the source's target: the sources' targets are
the weights of the service. The mix is all sources' copies in the order of
finish time, cut where the total reaches the budget, so at any point of it the
sources have been served in proportion to their targets.

1. Size: words of each text; one number a document is all that is sorted.
2. Targets: a source's weight is that of its place in the order of sources. The
   budget is shared by weight; a target stops at ``most`` times its source's
   size and the excess is shared again. With the sources in the order of (cap /
   weight), those that reach their cap are the first ones, so running sums find
   the level at which the others stop.
3. Queues: running sums of the sizes over (source, shuffled order), less what
   lies before the source. A hot source is many ranges of that order.
4. The mix: running sums over the finish times of all copies; the last copy
   within the budget is the cut.

Copies are whole documents: a source is off its target by less than one
document at the cut. The shuffle is the MD5 of the seed, id and text, so reruns
agree; rows that are equal in all of these are interchangeable.

Defined results: a null text has no words and is never taken. A null source is
a source of its own, after all others. Rows without an id take part. Without
words every target is 0; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from bizlens.llm.common import drop_saved, free_name, saved
from bizlens.llm.running import running_sums

WEIGHTS = (5, 2, 1)     # by a source's place in code point order, repeating
BUDGET = (3, 2)         # of all sizes: three halves
EPOCHS = 2              # most copies of a document
SEED = "mix"
WORD = r"[^\x20\x09-\x0D]+"


def shuffled_key(id_col: str, text_col: str, seed: str) -> Column:
    parts = [F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit("")),
             F.coalesce(F.col(text_col).cast("string"), F.lit(""))]
    return F.md5(F.concat_ws(":", *parts))


def _upto(limit: Row, *columns: str) -> Column:
    """Whether ``columns``, in lexicographic order, are no more than ``limit``'s fields of the same names."""
    before, same = F.lit(False), F.lit(True)
    for c in columns:
        before = before | (same & (F.col(c) < F.lit(limit[c])))
        same = same & (F.col(c) == F.lit(limit[c]))
    return before | same


def source_targets(sized: DataFrame, weights: Sequence[int] = WEIGHTS, budget: tuple[int, int] = BUDGET,
                   epochs: int = EPOCHS) -> tuple[DataFrame, int]:
    """``(source, source_size, source_rank, source_start, target)`` of each source of ``(source, size)``, and the budget."""
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("one", F.lit(1).cast("long"))
    ranked = running_sums(sources, [F.col("source").isNull(), F.col("source")],
                          {"source_rank": "one", "source_end": "source_size"}, "sources")
    weight = F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]),
                          (F.pmod(F.col("source_rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = ranked.withColumns({"weight": weight, "cap": F.col("source_size") * epochs})
    ranked = ranked.withColumn("level", F.col("cap") / F.col("weight"))
    total, all_weights = ranked.agg(F.coalesce(F.sum("source_size"), F.lit(0)),
                                    F.coalesce(F.sum("weight"), F.lit(0))).first()
    words = total * budget[0] // budget[1]
    share = total * budget[0] / budget[1]
    by_level = running_sums(ranked.select("level", "source_rank", "cap", "weight"), ["level", "source_rank"],
                            {"caps": "cap", "weights": "weight"}, "levels")
    full = by_level.where(F.col("caps") + F.col("level") * (all_weights - F.col("weights")) <= share)
    last = full.agg(F.max(F.struct("level", "source_rank", "caps", "weights")).alias("m")).first()["m"]
    caps, used = (last["caps"], last["weights"]) if last else (0, 0)
    level = (share - caps) / (all_weights - used) if all_weights > used else 0.0
    drop_saved(by_level)
    capped = _upto(last, "level", "source_rank") if last else F.lit(False)
    return ranked.select("source", "source_size", "source_rank",
                         (F.col("source_end") - F.col("source_size")).alias("source_start"),
                         F.when(capped, F.col("cap").cast("double")).otherwise(F.col("weight") * F.lit(float(level)))
                         .alias("target")), words


def mix_plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
             weights: Sequence[int] = WEIGHTS, budget: tuple[int, int] = BUDGET, epochs: int = EPOCHS,
             seed: str = SEED) -> DataFrame:
    """What the mix takes of every row.

    ``id, source, key`` (shuffle key), ``size, source_size, target, finish`` (virtual
    finish time of each epoch's copy), ``copies`` and ``taken`` (words, repeats counted).
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    sized = saved(docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"),
                              shuffled_key(id_col, text_col, seed).alias("key"),
                              F.regexp_count(text, F.lit(WORD)).cast("long").alias("size")), "sized")
    targets, words = source_targets(sized, weights, budget, epochs)
    queue = running_sums(sized, [F.col("source").isNull(), F.col("source"), F.col("key")], {"upto": "size"}, "queue")
    drop_saved(sized)
    mine = targets.select(F.col("source").alias("its"), "source_size", "source_rank", "source_start", "target")
    end = F.col("upto") - F.col("source_start")
    finish = [F.when(F.col("target") > 0, (end + F.col("source_size") * e) / F.col("target")).otherwise(0.0)
              for e in range(epochs)]
    timed = saved(queue.join(mine, F.col("source").eqNullSafe(F.col("its")))
                  .select("id", "source", "key", "size", "source_size", "source_rank", "target",
                          F.array(*finish).alias("finish")), "timed")
    drop_saved(queue)
    copies = timed.select("source_rank", "key", "size", F.posexplode("finish").alias("epoch", "at"))
    served = running_sums(copies, ["at", "source_rank", "key", "epoch"], {"served": "size"}, "served")
    place = ("at", "source_rank", "key", "epoch")
    cut = served.where(F.col("served") <= words).agg(F.max(F.struct(*place)).alias("m")).first()["m"]
    drop_saved(served)
    if cut is None:
        taken = F.lit(0)
    else:
        within = F.filter(F.transform("finish", lambda at, e: F.struct(at.alias("at"), "source_rank", "key", e.alias("epoch"))),
                          lambda x: x <= F.struct(F.lit(cut["at"]).alias("at"), F.lit(cut["source_rank"]).cast("long")
                                                  .alias("source_rank"), F.lit(cut["key"]).alias("key"),
                                                  F.lit(cut["epoch"]).cast("int").alias("epoch")))
        taken = F.size(within)
    return timed.withColumn("copies", F.when(F.col("size") > 0, taken).otherwise(0).cast("int")).select(
        "id", "source", "key", "size", "source_size", "target", "finish", "copies",
        (F.col("copies") * F.col("size")).alias("taken"))


def mixture(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: str = SEED, **options) -> DataFrame:
    """The mix itself: a row of ``docs`` for each copy taken, range-sorted by ``mix_finish``, its virtual finish time."""
    plan = mix_plan(docs, id_col=id_col, text_col=text_col, seed=seed, **options).where("copies > 0")
    key, at = free_name(docs, "_key"), free_name(docs, "mix_finish")
    source = options.get("source_col", "source")
    rows = docs.withColumn(key, shuffled_key(id_col, text_col, seed)).dropDuplicates([key, source])
    copies = plan.select(F.col("key").alias("its_key"), F.col("source").alias("its_source"),
                         F.explode(F.slice("finish", F.lit(1), F.col("copies"))).alias("its_finish"))
    both = rows.join(copies, (rows[key] == copies.its_key)
                     & rows[source].cast("string").eqNullSafe(copies.its_source))
    return both.select(*[rows[c] for c in docs.columns], F.col("its_finish").alias(at)).orderBy(at)
