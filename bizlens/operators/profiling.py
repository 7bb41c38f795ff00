"""Table profiling: value counts, statistics, null and duplicate profiles.

Every operator is one or a few aggregates whose output is bounded by the
number of groups or columns, never by the number of rows. Quantiles are
exact and distributed: radix selection on order-preserving 64-bit keys finds
all ranks of all columns in four passes; only one row a rank leaves the executors.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType,
           T.DecimalType)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NUMERIC)]


# ------------------------------------------------------------------ counts


def value_counts(df: DataFrame, col: str) -> DataFrame:
    """A1: rows per value, nulls dropped, most frequent first (L3)."""
    return (df.where(F.col(col).isNotNull()).groupBy(col).count()
            .orderBy(F.desc("count"), F.asc(col)))


def row_value_counts(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """A2: rows per distinct combination of ``cols`` among rows without nulls.

    The result holds every distinct row in order, so whole rows are sorted in any case.
    """
    cols = list(cols or df.columns)
    return df.dropna("any", subset=cols).groupBy(*cols).count().orderBy(F.desc("count"), *cols)


def ordered_counts(df: DataFrame, col: str, order: Sequence[str]) -> DataFrame:
    """A3: rows per category in a fixed category order, absent categories as 0.

    One pass with a conditional count per category, then ``stack`` to rows;
    no join against a category table.
    """
    agg = df.agg(*[F.count_if(F.col(col) == v).alias(f"_n{i}") for i, v in enumerate(order)])
    pairs = ", ".join(f"{i}, '{v}', _n{i}" for i, v in enumerate(order))
    return agg.select(F.expr(f"stack({len(order)}, {pairs}) AS (rank, {col}, count)")) \
              .orderBy("rank")


def flag_share(df: DataFrame, col: str) -> DataFrame:
    """Count and share of ones in a 0/1 column."""
    return df.agg(F.sum(col).cast("bigint").alias("ones"), F.avg(col).alias("share"),
                  F.count(col).alias("rows"))


def banded_counts(df: DataFrame, col: str) -> DataFrame:
    """Rows with 0, 1-2 and 3+ of a count column."""
    c = F.col(col)
    return df.agg(F.count_if(c == 0).alias("flags_0"),
                  F.count_if((c >= 1) & (c <= 2)).alias("flags_1_2"),
                  F.count_if(c >= 3).alias("flags_3_plus"))


def null_profile(df: DataFrame) -> DataFrame:
    """Null cells per column in long form (column, nulls, rows)."""
    agg = df.agg(F.count(F.lit(1)).alias("_rows"),
                 *[F.count_if(F.col(n).isNull()).alias(f"_z{i}") for i, n in enumerate(df.columns)])
    pairs = ", ".join(f"{i}, '{n}', _z{i}" for i, n in enumerate(df.columns))
    return agg.select(F.expr(f"stack({len(df.columns)}, {pairs}) AS (position, column_name, nulls)"),
                      F.col("_rows").alias("rows"))


def row_fingerprint(cols: Sequence[str]) -> Column:
    """128 bits of a row: two seeded hashes of its cells and of which of them are null."""
    nulls = F.array(*[F.col(c).isNull() for c in cols])
    return F.struct(F.xxhash64(F.lit(0x5EED), nulls, *cols), F.xxhash64(*cols, nulls, F.lit(0xFACE)))


def duplicate_rows(df: DataFrame, fingerprint: Column | None = None) -> DataFrame:
    """Rows, distinct rows and duplicates; nulls compare equal.

    What is shuffled of a row without a double is its 128-bit fingerprint; rows
    whose fingerprint occurs again are compared whole, which also tells rows
    apart that share one.
    """
    cols = df.columns
    rows = df.withColumn("_fp", row_fingerprint(cols) if fingerprint is None else fingerprint)
    counts = rows.groupBy("_fp").count()
    single = counts.where("count = 1").agg(F.count("*").alias("rows"), F.count("*").alias("distinct_rows"))
    again = counts.where("count > 1").select("_fp")
    groups = rows.join(again, "_fp", "left_semi").groupBy(*cols).count()
    several = groups.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("rows"), F.count("*").alias("distinct_rows"))
    return (single.unionByName(several).agg(F.sum("rows").alias("rows"), F.sum("distinct_rows").alias("distinct_rows"))
            .withColumn("duplicates", F.col("rows") - F.col("distinct_rows")))


def schema_profile(df: DataFrame) -> DataFrame:
    """A10: one row per column: position, type, non-null count, rows (info/shape/dtypes)."""
    agg = df.agg(F.count(F.lit(1)).alias("_rows"),
                 *[F.count(F.col(n)).alias(f"_c{i}") for i, n in enumerate(df.columns)])
    parts = ", ".join(f"{i}, '{f.name}', '{f.dataType.simpleString()}', _c{i}"
                      for i, f in enumerate(df.schema.fields))
    return agg.select(
        F.expr(f"stack({len(df.columns)}, {parts}) AS (position, column_name, data_type, non_null)"),
        F.col("_rows").alias("rows"))


def type_counts(df: DataFrame) -> DataFrame:
    """A10: columns per type beside the table's number of rows (dtypes and shape)."""
    types = sorted(f.dataType.simpleString() for f in df.schema.fields)
    pairs = ", ".join(f"'{t}', {types.count(t)}" for t in sorted(set(types)))
    return df.agg(F.count(F.lit(1)).alias("rows")).select(
        F.expr(f"stack({len(set(types))}, {pairs}) AS (data_type, columns)"), "rows")


def first_rows(df: DataFrame, n: int = 5, order_by: str = "sme_id") -> DataFrame:
    """L1/L2: the first ``n`` rows in key order (a top-n, the limit is the feature)."""
    return df.orderBy(order_by).limit(n)


# ------------------------------------------------------------------ exact quantiles


def order_keys(x: np.ndarray) -> np.ndarray:
    """64-bit keys in the order of the doubles; -0.0 counts as 0.0."""
    bits = (x + 0.0).view(np.uint64)
    return np.where(bits >> np.uint64(63), ~bits, bits | np.uint64(1 << 63))


def key_value(key: int) -> float:
    """The double of an order-preserving key."""
    bits = key & ~(1 << 63) if key >> 63 else ~key & ((1 << 64) - 1)
    return float(np.array([bits], np.uint64).view(np.float64)[0])


def _digit_counts(shift: int, bits: int, prefixes: dict[int, np.ndarray]):
    """Per column and prefix of the keys: how many keys have each next digit. Held and combined in the task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {c: (np.zeros(0, np.int64), np.zeros(0, np.int64)) for c in prefixes}
        for batch in batches:
            for c, known in prefixes.items():
                column = batch.column(c)
                x = column.drop_null().to_numpy(zero_copy_only=False)
                keys = order_keys(x[~np.isnan(x)])
                above = keys >> np.uint64(shift + bits) if shift + bits < 64 else np.zeros(len(keys), np.uint64)
                at = np.minimum(np.searchsorted(known, above), len(known) - 1)
                mine = known[at] == above
                digit = (keys[mine] >> np.uint64(shift) & np.uint64((1 << bits) - 1)).astype(np.int64)
                code, n = np.unique(at[mine] << bits | digit, return_counts=True)
                both, place = np.unique(np.concatenate([held[c][0], code]), return_inverse=True)
                total = np.bincount(place, weights=np.concatenate([held[c][1], n]), minlength=len(both))
                held[c] = both, total.astype(np.int64)
        for c, (code, n) in held.items():
            if len(code):
                yield pa.RecordBatch.from_pydict({
                    "cid": pa.array(np.full(len(code), c, np.int32)),
                    "prefix": pa.array(prefixes[c][code >> bits].view(np.int64)),
                    "digit": pa.array(code & ((1 << bits) - 1)), "n": pa.array(n)})
    return run


def kth_values(df: DataFrame, ranks: dict[int, list[int]], bits: int = 16) -> dict[tuple[int, int], float]:
    """Exact k-th smallest values (0-based ``ranks`` per column position) of ``df``'s double columns.

    Radix selection from the highest digit: a pass counts, for the prefix of
    every rank still looked for, the keys by their next ``bits`` bits, and the
    running sum over the digits names the rank's digit. Nulls and NaN are left
    out; infinite values and any spread are values like others. The number of
    passes is ``64 / bits`` for any data, and a group of counts has at most ``2 ** bits`` rows.
    """
    spark = df.sparkSession
    left = {(c, k): (0, k) for c, ks in ranks.items() for k in ks}       # (prefix, rank among the keys with it)
    for shift in range(64 - bits, -1, -bits):
        prefixes = {c: np.array(sorted({p for (d, _), (p, _) in left.items() if d == c}), np.uint64)
                    for c in {c for c, _ in left}}
        counts = (df.mapInArrow(_digit_counts(shift, bits, prefixes), "cid int, prefix long, digit long, n long")
                  .groupBy("cid", "prefix", "digit").agg(F.sum("n").alias("n")))
        upto = F.sum("n").over(Window.partitionBy("cid", "prefix").orderBy("digit"))
        wanted = F.broadcast(spark.createDataFrame(
            [(c, k, p, r) for (c, k), (p, r) in left.items()], "cid int, k long, prefix long, r long"))
        found = (counts.withColumn("upto", upto).join(wanted, ["cid", "prefix"])
                 .where((F.col("r") < F.col("upto")) & (F.col("r") >= F.col("upto") - F.col("n"))))
        left = {(x["cid"], x["k"]): (x["prefix"] << bits | x["digit"], x["r"] - x["upto"] + x["n"])
                for x in found.collect()}
    return {at: key_value(key) for at, (key, _) in left.items()}


def quantiles_of(part: DataFrame, cols: Sequence[str], counts: Sequence[int], probs: Sequence[float],
                 bits: int = 16) -> dict[str, dict[float, float | None]]:
    """Quantiles with linear interpolation; ``counts`` are the columns' numbers of values. ``part`` is read four times."""
    doubles = part.select(*[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(cols)])
    ranks = {i: sorted({f(p * (n - 1)) for p in probs for f in (math.floor, math.ceil)})
             for i, n in enumerate(counts) if n}
    kth = kth_values(doubles, ranks, bits) if ranks else {}
    res: dict[str, dict[float, float | None]] = {c: dict.fromkeys(probs) for c in cols}
    for i, c in enumerate(cols):
        for p in probs if counts[i] else ():
            pos = p * (counts[i] - 1)
            lo, hi = kth[i, math.floor(pos)], kth[i, math.ceil(pos)]
            frac = pos - math.floor(pos)
            res[c][p] = lo if frac == 0 or lo == hi else lo + (hi - lo) * frac
    return res


def value_count(c: str) -> Column:
    """Cells of a column that are neither null nor NaN."""
    return F.count_if(F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")))


def exact_quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float],
                    bits: int = 16) -> dict[str, dict[float, float | None]]:
    """Exact quantiles of several columns; the columns are kept for the passes."""
    part = df.select(*cols).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        counts = part.agg(*[value_count(c).alias(f"n{i}") for i, c in enumerate(cols)]).first()
        return quantiles_of(part, cols, list(counts), probs, bits)
    finally:
        part.unpersist()


def _moments(part: DataFrame, cols: Sequence[str], digits: int):
    """One aggregate over the kept columns: values, non-null count, mean, sample std, min and max of each."""
    return part.agg(*[e for i, c in enumerate(cols) for e in (
        value_count(c).alias(f"v{i}"), F.count(c).alias(f"n{i}"), F.bround(F.avg(c), digits).alias(f"m{i}"),
        F.bround(F.stddev_samp(c), digits).alias(f"s{i}"), F.min(c).cast("double").alias(f"lo{i}"),
        F.max(c).cast("double").alias(f"hi{i}"))]).first()


def _cut_off(v: float | None, digits: int) -> float | None:
    return None if v is None else float(round(v, digits))


def column_stats(df: DataFrame, col: str, digits: int = 9) -> DataFrame:
    """A4: mean, median, sample std, min, max of one column (one row)."""
    part = df.select(col).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        row = _moments(part, [col], digits)
        med = quantiles_of(part, [col], [row["v0"]], [0.5])[col][0.5]
    finally:
        part.unpersist()
    return df.sparkSession.createDataFrame(
        [(row["m0"], _cut_off(med, digits), row["s0"], row["lo0"], row["hi0"])],
        "mean DOUBLE, median DOUBLE, std DOUBLE, min DOUBLE, max DOUBLE")


def describe(df: DataFrame, cols: Sequence[str] | None = None, digits: int = 6) -> DataFrame:
    """A5: count, mean, std (n-1), min, quartiles, max per numeric column (long form).

    One statistics pass and four quantile passes read the same projected
    columns, kept for the duration. The result has one row per column.
    """
    cols = list(cols or numeric_columns(df))
    part = df.select(*cols).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        row = _moments(part, cols, digits)
        q = quantiles_of(part, cols, [row[f"v{i}"] for i in range(len(cols))], [0.25, 0.5, 0.75])
    finally:
        part.unpersist()
    rows = [(i, c, row[f"n{i}"], row[f"m{i}"], row[f"s{i}"], row[f"lo{i}"],
             *(_cut_off(q[c][p], digits) for p in (0.25, 0.5, 0.75)), row[f"hi{i}"]) for i, c in enumerate(cols)]
    return df.sparkSession.createDataFrame(
        rows, "position INT, column_name STRING, count BIGINT, mean DOUBLE, std DOUBLE, min DOUBLE, "
              "q25 DOUBLE, q50 DOUBLE, q75 DOUBLE, max DOUBLE")

