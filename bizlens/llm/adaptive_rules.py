"""Operator 3: quality rules whose thresholds come from quantile sketches per language and source.

Each document gets word and line measures by DataFrame functions only. Four
rates are sketched per (language, source): a histogram of the rate in
ten-thousandths, kept to its eight leading bits, so a sketch has a bounded
number of bins, an error of at most 1/128, and merges by adding counts (the
sketches of a language and of the whole corpus are sums of its parts').
A document is kept if every rate lies within the fences
``q25 - spread * (q75 - q25) - slack`` and ``q75 + spread * (q75 - q25) + slack``
of its own group, or of its language, or of the corpus, whichever is the first
with ``least`` documents. Failed base rules are left out of the sketches.

Defined results: a null text has no words and fails the base rule. A null
language or source is a group like any other. Repeated rows each count and
each get a row. Windows that repeat are found by hashes and confirmed by
their words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bizlens.llm.common import saved

LEAST, SPREAD = 100, 3
# rate: (numerator, denominator, slack in ten-thousandths)
RATES = {"mean_word": ("word_chars", "n_words", 10000), "symbols": ("n_symbols", "word_chars", 200),
         "dup_lines": ("n_dup_lines", "n_lines", 5000), "repeats": ("n_repeat_words", "n_words", 2500)}
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
_BLANK = "\t\n\x0b\x0c\r"


def measures(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The base measures of each row as longs, beside the columns ``keep``."""
    keep = keep or []
    d = docs.select(*keep, F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_t"))
    d = d.select(
        *keep,
        F.array_remove(F.split(F.translate("_t", _BLANK, " " * len(_BLANK)), " "), "").alias("_w"),
        F.length(F.translate("_t", " " + _BLANK, "")).cast("long").alias("word_chars"),
        F.expr("length(_t) - length(translate(_t, '#*$%&|<>', ''))").cast("long").alias("n_symbols"),
        F.filter(F.split("_t", "\n"), lambda x: F.length(F.translate(x, " " + _BLANK, "")) > 0).alias("_l"))
    d = d.withColumns({
        "n_words": F.size("_w").cast("long"), "n_lines": F.size("_l").cast("long"),
        "n_dup_lines": (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long"),
        "_high": F.expr("-shiftleft(1L, length(bin(size(_w))))")}).drop("_l")
    # each window's hash with the window's place in its low bits; equal high bits are candidates
    d = d.withColumn("_s", F.expr(
        "if(n_words < 4, cast(array() as array<bigint>), sort_array(transform(sequence(0, size(_w) - 3), "
        "i -> (xxhash64(_w[i], _w[i + 1], _w[i + 2]) & _high) | cast(i as bigint))))"))
    d = d.withColumn("_c", F.expr(
        "filter(_s, (x, i) -> coalesce((x & _high) = (get(_s, i - 1) & _high), false) "
        "or coalesce((x & _high) = (get(_s, i + 1) & _high), false))"))
    d = d.withColumn("_z", F.expr(
        "sort_array(transform(_c, x -> named_struct('t', concat_ws(' ', _w[cast(x & ~_high as int)], "
        "_w[cast(x & ~_high as int) + 1], _w[cast(x & ~_high as int) + 2]), 'p', cast(x & ~_high as int))))"))
    d = d.withColumn("_p", F.expr(
        "sort_array(transform(filter(_z, (x, i) -> coalesce(x.t = get(_z, i - 1).t, false) "
        "or coalesce(x.t = get(_z, i + 1).t, false)), x -> x.p))"))
    d = d.withColumn("n_repeat_words", F.expr(
        "aggregate(transform(_p, (p, i) -> least(3, coalesce(get(_p, i + 1), p + 3) - p)), 0L, (a, x) -> a + x)"))
    return d.select(*keep, *MEASURES, "n_lines")


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (F.lit(100) * F.col("n_repeat_words") > F.lit(50) * F.col("n_words"))


def _rate(num: str, den: str) -> Column:
    return F.expr(f"(10000 * {num}) div greatest({den}, 1)")


def sketches(rows: DataFrame) -> DataFrame:
    """``_lang, _source, rate, bin, n``: mergeable histograms of the rates."""
    values = F.array(*[F.struct(F.lit(name).alias("rate"), _rate(num, den).alias("v"))
                       for name, (num, den, _) in RATES.items()])
    v = rows.where(~base_failed()).select("_lang", "_source", F.inline(values))
    bits = "shiftleft(1L, greatest(length(bin(v)) - 8, 0))"
    return v.groupBy("_lang", "_source", "rate", F.expr(f"v - v % {bits}").alias("bin")).agg(F.count("*").alias("n"))


def thresholds(sketch: DataFrame, spread: int, least: int) -> DataFrame:
    """``_lang, _source`` and per rate its low and high fence, from merged sketches."""
    levels = {"g": ["_lang", "_source"], "l": ["_lang"], "a": []}
    fences = {}
    for level, by in levels.items():
        merged = sketch.groupBy(*by, "rate", "bin").agg(F.sum("n").alias("n"))
        group = ", ".join([*by, "rate"])
        run = merged.select("*", F.expr(f"sum(n) over (partition by {group} order by bin)").alias("upto"),
                            F.expr(f"sum(n) over (partition by {group})").alias("total"))
        q = run.groupBy(*by, "rate").agg(F.first("total").alias("total"),
                                         F.expr("min(if(4 * upto >= total, bin, null))").alias("q25"),
                                         F.expr("min(if(4 * upto >= 3 * total, bin, null))").alias("q75"))
        wide = []
        for name, (_, _, slack) in RATES.items():
            low = f"q25 - {spread} * (q75 - q25) - {slack}"
            high = f"q75 + {spread} * (q75 - q25) + {slack}"
            wide += [F.expr(f"max(if(rate = '{name}', {low}, null))").alias(f"{level}_{name}_low"),
                     F.expr(f"max(if(rate = '{name}', {high}, null))").alias(f"{level}_{name}_high")]
        fences[level] = q.groupBy(*by).agg(F.max("total").alias(f"{level}_n"), *wide)
    lang = fences["l"].withColumnRenamed("_lang", "_l")
    t = fences["g"].join(lang, F.col("_lang").eqNullSafe(F.col("_l")), "left")
    corpus = fences["a"].first()            # one row of a few numbers
    t = t.withColumns({c: F.lit(corpus[c] if corpus else None).cast("long") for c in fences["a"].columns})
    pick = []
    for name in RATES:
        for side in ("low", "high"):
            pick.append(F.expr(f"case when g_n >= {least} then g_{name}_{side} when l_n >= {least} "
                               f"then l_{name}_{side} else a_{name}_{side} end").alias(f"{name}_{side}"))
    return t.select(F.col("_lang").alias("_tl"), F.col("_source").alias("_ts"), *pick)


def adaptive_quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
                     source_col: str = "source", spread: int = SPREAD, least: int = LEAST) -> DataFrame:
    """Measures, ``base_failed`` and ``kept`` of every row."""
    named = docs.select(F.col(id_col).alias("doc_id"), F.col(lang_col).alias("_lang"),
                        F.col(source_col).alias("_source"), F.col(text_col).alias("text"))
    rows = saved(measures(named, keep=["doc_id", "_lang", "_source"]), "measures")
    t = thresholds(sketches(rows), spread, least)
    ok = F.lit(True)
    for name, (num, den, _) in RATES.items():
        ok = ok & _rate(num, den).between(F.col(f"{name}_low"), F.col(f"{name}_high"))
    return (rows.join(t, F.col("_lang").eqNullSafe(F.col("_tl")) & F.col("_source").eqNullSafe(F.col("_ts")), "left")
            .select("doc_id", *MEASURES, base_failed().alias("base_failed"),
                    (~base_failed() & F.coalesce(ok, F.lit(True))).alias("kept")))
