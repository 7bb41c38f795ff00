"""One-hot encoding of columns with very many values (A13, M2, M5): vocabulary as a table, sparse vectors.

:mod:`encode` turns every value into an expression, which suits columns of some
dozen values. Here the vocabulary stays a table ``(column_name, position,
value)``: positions come by a join, the indicators are one sparse vector a
column, and nothing is collected per value.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml.feature import OneHotEncoder, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bizlens.operators.encode import EncoderState, encoded_exprs, vocabulary


def fit_vocabulary_table(df: DataFrame, cols: Sequence[str], path: str) -> DataFrame:
    """A13 as a stored table: sorted distinct non-null values of each column, with their positions."""
    vocabulary(df, cols).write.mode("overwrite").partitionBy("column_name").parquet(path)
    return df.sparkSession.read.parquet(path)


def vocabulary_sizes(vocab: DataFrame) -> dict[str, int]:
    return {r["column_name"]: r["n"] for r in vocab.groupBy("column_name").agg(F.count("*").alias("n")).collect()}


def with_positions(df: DataFrame, vocab: DataFrame, cols: Sequence[str], suffix: str = "_position") -> DataFrame:
    """Each column's position in its vocabulary beside it; null for a null and an unknown value."""
    for c in cols:
        known = vocab.where(F.col("column_name") == c).select(F.col("value").alias("_value"),
                                                              F.col("position").alias(f"{c}{suffix}"))
        df = df.join(known, F.col(c).cast("string") == F.col("_value"), "left").drop("_value")
    return df


def encode_wide(df: DataFrame, state: EncoderState, vocab: DataFrame, out: str = "features",
                sizes: Mapping[str, int] | None = None) -> DataFrame:
    """``df`` with one vector: ordinal, one-hot (sparse, drop-first), numeric and binary blocks in this order (M1-M5).

    ``state`` is fitted without one-hot columns' values (``state.vocab`` is not read).
    Null and unknown values have no indicator set, as the first value has none.
    """
    cols = list(state.spec["onehot"])
    sizes = sizes or vocabulary_sizes(vocab)
    blocks = {}
    for name in ("ordinal", "numeric", "binary"):
        spec = {"ordinal": [], "onehot": [], "numeric": [], "binary": [], name: state.spec[name]}
        one = EncoderState(spec, state.ordinal_order, {}, state.mean, state.scale, state.unknown_ordinal)
        blocks[name] = {f"_{name}{i}": e for i, e in enumerate(encoded_exprs(one))}
    rows = with_positions(df.withColumns({n: e for b in blocks.values() for n, e in b.items()}), vocab, cols, "_at")
    # the encoder drops its last category: that of the first value, of nulls and of unknown values
    rows = rows.withColumns({f"{c}_at": F.when(F.col(f"{c}_at") > 0, F.col(f"{c}_at") - 1)
                             .otherwise(max(sizes.get(c, 0), 1) - 1).cast("double") for c in cols})
    hot = [c for c in cols if sizes.get(c, 0) > 1]
    if hot:
        widest = df.sparkSession.createDataFrame([tuple(float(sizes[c] - 1) for c in hot)], [f"{c}_at" for c in hot])
        encoder = OneHotEncoder(inputCols=[f"{c}_at" for c in hot], outputCols=[f"{c}_hot" for c in hot], dropLast=True)
        rows = encoder.fit(widest).transform(rows)
    inputs = [*blocks["ordinal"], *(f"{c}_hot" for c in hot), *blocks["numeric"], *blocks["binary"]]
    made = VectorAssembler(inputCols=inputs, outputCol=out, handleInvalid="keep").transform(rows)
    return made.select(*df.columns, out)
