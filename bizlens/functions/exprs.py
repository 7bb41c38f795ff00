"""Scalar column expressions with the null/NaN behaviour the scoring rules need.

Every feature, rule and label in the library is built from these helpers, so
the null semantics are decided in one place:

* ``nz(d)``        zero denominator becomes 1, null stays null
* ``clip``         a null input stays null (Spark's ``greatest``/``least`` skip nulls)
* ``flag``         a predicate on null is 0, not null
* ``cut``          right-closed bins, lowest edge excluded, outside -> null
* ``bround``       half-even rounding, as NumPy's ``round``
* ``clean``        null, NaN and +/-inf -> 0.0

All are plain Catalyst expressions: they stay inside whole-stage codegen.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ColumnOrName = Column | str

INF = float("inf")


def null_double() -> Column:
    return F.lit(None).cast("double")


def col(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


# ---------------------------------------------------------------- ratios


def nz(d: ColumnOrName) -> Column:
    """Denominator with 0 replaced by 1 (null stays null)."""
    d = col(d)
    return F.when(d == 0, F.lit(1)).otherwise(d)


def ratio(num: ColumnOrName, den: ColumnOrName) -> Column:
    """``num / d`` with a zero denominator read as 1 (F1)."""
    return col(num) / nz(den)


def ratio_or_null(num: ColumnOrName, den: ColumnOrName) -> Column:
    """``num / d`` with a zero denominator giving null (F2)."""
    return col(num) / F.nullif(col(den), F.lit(0))


# ---------------------------------------------------------------- ranges


def clip(c: ColumnOrName, lo: float | None = None, hi: float | None = None) -> Column:
    """Clip to [lo, hi]; null in, null out, and NaN stays NaN."""
    c = col(c).cast("double")
    out = c
    if lo is not None:
        out = F.greatest(out, F.lit(float(lo)))
    if hi is not None:
        out = F.least(out, F.lit(float(hi)))
    return F.when(c.isNull() | F.isnan(c), c).otherwise(out)


def clip01(c: ColumnOrName) -> Column:
    return clip(c, 0.0, 1.0)


def row_min(a: ColumnOrName, b: ColumnOrName) -> Column:
    """Row-wise minimum of two columns; null if either is null, NaN if either is NaN."""
    a, b = col(a), col(b)
    return (F.when(a.isNull() | b.isNull(), F.lit(None))
            .when(F.isnan(a), a).when(F.isnan(b), b).otherwise(F.least(a, b)))


def cut(c: ColumnOrName, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """Right-closed binning: label i for ``edges[i] < x <= edges[i+1]``.

    The lowest edge is excluded and values outside every bin (or null) give
    null, as in a right-closed histogram cut (F8). Written as one ascending
    ``x <= edge`` ladder so ``x`` is referenced once per edge: a pushed-down
    filter that inlines ``x`` stays small. NaN fails every ``<=`` (Spark
    orders NaN above +inf) and falls out as null.
    """
    if len(edges) != len(labels) + 1:
        raise ValueError("need one more edge than labels")
    c = col(c)
    out = F.when(c <= F.lit(float(edges[0])), F.lit(None).cast("string"))
    for hi, label in zip(edges[1:], labels):
        out = out.when(c <= F.lit(float(hi)), F.lit(label))
    return out


def threshold_label(c: ColumnOrName, limits: Sequence[float], labels: Sequence[str]) -> Column:
    """Left-closed ladder: ``x < limits[0]`` -> labels[0], ..., else the last label.

    A null falls through every test to the last label, as a chain of
    ``if x < limit`` tests does on NaN.
    """
    if len(labels) != len(limits) + 1:
        raise ValueError("need one more label than limits")
    c = col(c)
    out = None
    for lim, label in zip(limits, labels[:-1]):
        cond = c < F.lit(float(lim))
        out = F.when(cond, F.lit(label)) if out is None else out.when(cond, F.lit(label))
    return out.otherwise(F.lit(labels[-1]))


# ---------------------------------------------------------------- predicates


def flag(cond: Column) -> Column:
    """Boolean predicate as 0/1 int; a null predicate counts as 0."""
    return F.coalesce(cond, F.lit(False)).cast("int")


def differs(a: ColumnOrName, b: ColumnOrName) -> Column:
    """``a != b`` where a null on either side counts as different (GF27)."""
    return F.coalesce(col(a) != col(b), F.lit(True))


# ---------------------------------------------------------------- rounding and repair


def bround(c: ColumnOrName, scale: int = 0) -> Column:
    """Half-even rounding."""
    return F.bround(col(c), scale)


def nan_to_null(c: ColumnOrName) -> Column:
    return F.nanvl(col(c), null_double())


def without_nan(df: DataFrame) -> DataFrame:
    """NaN as null in every double and float column: the rules treat the two alike.

    Applied once, where rows enter (tables, CSV, requests) and on the input of
    each feature, rule and label projection, so that a comparison with NaN
    (true in Spark) is the false that the rules expect.
    """
    cols = {f.name: nan_to_null(F.col(f"`{f.name}`")) for f in df.schema.fields
            if isinstance(f.dataType, T.DoubleType | T.FloatType)}
    return df.withColumns(cols) if cols else df


def clean(c: ColumnOrName) -> Column:
    """null, NaN, +inf, -inf -> 0.0 (P10)."""
    c = col(c).cast("double")
    bad = c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(INF))
    return F.when(bad, F.lit(0.0)).otherwise(c)


def repair_nonfinite(c: ColumnOrName, nan: float = 0.5, posinf: float = 1.0,
                     neginf: float = 0.0) -> Column:
    """Separate replacement values for NaN/null, +inf and -inf."""
    c = col(c).cast("double")
    return (F.when(c.isNull() | F.isnan(c), F.lit(nan))
            .when(c == F.lit(INF), F.lit(posinf))
            .when(c == F.lit(-INF), F.lit(neginf))
            .otherwise(c))


def clip01_repaired(c: ColumnOrName, nan: float = 0.5) -> Column:
    """``clip01(repair_nonfinite(c, nan, 1.0, 0.0))`` with ``c`` referenced once.

    +inf and -inf clip to 1 and 0, the repair values, so only null/NaN need
    the explicit replacement.
    """
    filled = F.coalesce(F.nanvl(col(c).cast("double"), F.lit(nan)), F.lit(nan))
    return F.least(F.greatest(filled, F.lit(0.0)), F.lit(1.0))


# ---------------------------------------------------------------- reproducible draws


def hash01_sql(key: str, salt: str) -> str:
    """SQL text of :func:`hash01` for a key column name."""
    return (f"(CAST(conv(substring(md5(concat(CAST(`{key}` AS STRING), '{':' + salt}')), 1, 8), 16, 10)"
            f" AS BIGINT) / 4294967296D)")


def hash01(key: ColumnOrName, salt: str) -> Column:
    """Uniform value in [0, 1) from a key and a salt, equal on every engine.

    First 32 bits of ``md5(key || ':' || salt)`` divided by 2^32. It depends
    only on the row's key, never on partitioning or row order. For a column
    name the expression is parsed from SQL text: one call to the JVM instead
    of one per operator, which matters when dozens are built.
    """
    if isinstance(key, str):
        return F.expr(hash01_sql(key, salt))
    text = F.concat(col(key).cast("string"), F.lit(":" + salt))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)


def noise(key: ColumnOrName, salt: str, mean: float = 0.0, sd: float = 1.0) -> Column:
    """Normal draw ``mean + sd * z`` via Box-Muller on two key hashes.

    ``u1`` is shifted by half a step so that it is never 0.
    """
    u1 = hash01(key, salt + ":a") + F.lit(0.5 / 4294967296.0)
    u2 = hash01(key, salt + ":b")
    z = F.sqrt(F.lit(-2.0) * F.log(u1)) * F.cos(F.lit(2.0 * math.pi) * u2)
    return F.lit(float(mean)) + F.lit(float(sd)) * z


def pick_sql(key: str, salt: str, values: Sequence[str]) -> str:
    arr = ", ".join("'" + v.replace("'", "''") + "'" for v in values)
    return f"element_at(array({arr}), CAST(floor({hash01_sql(key, salt)} * {len(values)}) AS INT) + 1)"


def pick(key: ColumnOrName, salt: str, values: Sequence[str]) -> Column:
    """Element ``floor(hash01 * n)`` of a fixed list."""
    if isinstance(key, str):
        return F.expr(pick_sql(key, salt, values))
    idx = F.floor(hash01(key, salt) * F.lit(len(values))).cast("int") + F.lit(1)
    return F.element_at(F.array(*[F.lit(v) for v in values]), idx)
