"""Feature encoding, splits and class weights.

Fitting reads a few statistics per column with one aggregate each (means and
population std; sorted vocabularies) into a small :class:`EncoderState`.
Transforming is a single projection of generated expressions: ordinal
``CASE`` ladders, drop-first one-hot indicators, standard scaling with the
fitted literals and binary casts. No UDF and no join.
"""

from __future__ import annotations

import json
import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bizlens import schema as S
from bizlens.functions.exprs import clean, col
from bizlens.operators.ranking import global_position

SPLIT_BINS = 1 << 16


@dataclass
class EncoderState:
    """Fitted encoder: ordered feature names, vocabularies and scaler statistics."""

    spec: dict
    ordinal_order: dict
    vocab: dict = field(default_factory=dict)       # one-hot column -> sorted values
    mean: dict = field(default_factory=dict)        # numeric column -> mean
    scale: dict = field(default_factory=dict)       # numeric column -> population std (0 -> 1)
    unknown_ordinal: str = "minus_one"              # or "error"

    # ---------------------------------------------------------------- names

    def ordinal_names(self) -> list[str]:
        return [f"ord__{c}" for c in self.spec["ordinal"]]

    def onehot_names(self) -> list[str]:
        return [f"oh__{c}__{v}" for c in self.spec["onehot"] for v in self.vocab.get(c, [])[1:]]

    def numeric_names(self) -> list[str]:
        return [f"num__{c}" for c in self.spec["numeric"]]

    def binary_names(self) -> list[str]:
        return [f"bin__{c}" for c in self.spec["binary"]]

    def feature_names(self) -> list[str]:
        """Block order: ordinal, one-hot, scaled numeric, binary (L4)."""
        return self.ordinal_names() + self.onehot_names() + self.numeric_names() + self.binary_names()

    # ---------------------------------------------------------------- persistence (S3)

    def to_json(self) -> str:
        return json.dumps(self.__dict__, sort_keys=True)

    @classmethod
    def from_json(cls, text: str) -> "EncoderState":
        return cls(**json.loads(text))

    def save(self, spark: SparkSession, path: str) -> None:
        """One-row Parquet table, so the state lives next to the models."""
        spark.createDataFrame([(self.to_json(),)], "state STRING").coalesce(1) \
             .write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "EncoderState":
        return cls.from_json(spark.read.parquet(path).first()["state"])


# ------------------------------------------------------------------ fit


def fit_vocabulary(df: DataFrame, cols: Sequence[str]) -> dict:
    """Sorted distinct non-null values per column (A13), codepoint order.

    The values become part of the encoder; equal values are combined before
    the shuffle, so what is collected is the vocabulary itself.
    """
    out = {c: [] for c in cols}
    for r in vocabulary(df, cols).orderBy("column_name", "position").collect() if cols else []:
        out[r["column_name"]].append(r["value"])
    return out


def fit_scaler(df: DataFrame, cols: Sequence[str]) -> tuple[dict, dict]:
    """Mean and population std per column (A12); a zero std scales by 1."""
    if not cols:
        return {}, {}
    row = df.agg(*[e for i, c in enumerate(cols) for e in (
        F.avg(F.col(c).cast("double")).alias(f"m{i}"),
        F.stddev_pop(F.col(c).cast("double")).alias(f"s{i}"))]).first()
    mean = {c: row[f"m{i}"] for i, c in enumerate(cols)}
    scale = {}
    for i, c in enumerate(cols):
        s = row[f"s{i}"]
        scale[c] = 1.0 if s is None or s == 0 or math.isnan(s) else s
    return mean, scale


def fit_encoder(df: DataFrame, spec: Mapping[str, Sequence[str]],
                ordinal_order: Mapping[str, Sequence[str]] = S.ORDINAL_ORDER,
                unknown_ordinal: str = "minus_one") -> EncoderState:
    """Fit vocabularies and scaler on ``df`` (the training rows by default, Q10)."""
    spec = {k: [c for c in spec[k] if c in df.columns] for k in ("ordinal", "onehot", "numeric",
                                                                  "binary")}
    # the fit reads the input three times: keep just the fitted columns for those passes
    cols = spec["onehot"] + spec["numeric"]
    part = df.select(*cols).persist(StorageLevel.MEMORY_AND_DISK) if cols else df
    try:
        mean, scale = fit_scaler(part, spec["numeric"])
        vocab = fit_vocabulary(part, spec["onehot"])
    finally:
        if cols:
            part.unpersist()
    return EncoderState(spec=spec, ordinal_order={c: list(ordinal_order[c]) for c in spec["ordinal"]},
                        vocab=vocab, mean=mean, scale=scale, unknown_ordinal=unknown_ordinal)


# ------------------------------------------------------------------ transform (M1-M6)


def encode(df: DataFrame, state: EncoderState, keep: Sequence[str] = ("sme_id",),
           clean_values: bool = True, defaults: Mapping | None = None) -> DataFrame:
    """Encoded feature columns in block order (M1-M4), ``keep`` columns first."""
    exprs = encoded_exprs(state, clean_values, df.columns, defaults)
    kept = [k for k in keep if k in df.columns]
    return df.select(*kept, *[e.alias(n) for e, n in zip(exprs, state.feature_names())])


def feature_vector(state: EncoderState, width: int | None = None, columns: Sequence[str] | None = None,
                   defaults: Mapping | None = None) -> Column:
    """All encoded features as one ``vector`` expression (M5, M6), no extra columns.

    ``columns`` and ``defaults`` as in :func:`encoded_sql`.
    """
    arr = F.array(*encoded_exprs(state, columns=columns, defaults=defaults))
    return array_to_vector(pad_trim(arr, width) if width is not None else arr)


def _str(v: str) -> str:
    return "'" + str(v).replace("\\", "\\\\").replace("'", "\\'") + "'"


def _dbl(v: float) -> str:
    return f"CAST('{float(v)!r}' AS DOUBLE)"


def encoded_sql(state: EncoderState, clean_values: bool = True, columns: Sequence[str] | None = None,
                defaults: Mapping | None = None) -> list[str]:
    """SQL text of every encoded feature, in block order (M1-M4, P10).

    M1: index in the order from 0.0, unknown -> -1.0 or an error; M2: drop-first
    indicators, unknown and null -> all zeros; M3: ``(x - mean) / std``; M4: the
    number. As text each feature costs one parse instead of a dozen
    driver-to-JVM calls, which matters when several bundles of ~80 features are
    built per query. ``clean`` is
    ``IF(x * 0 = 0, x, 0)``: false for null, NaN and +/-inf. It is applied to
    the column itself, before scaling; ordinals and indicators are never null.

    ``defaults`` (P4, P5) holds, under ``absent`` and ``null``, the value per block of a
    column that ``columns`` lacks and of a null; ``None`` for an ordinal is the
    first of its order. Numbers and flags are 0 either way. With ``defaults`` an
    unknown ordinal never raises: :func:`unknown_reason` tells such rows.
    """
    out: list[str] = []
    have = None if columns is None else set(columns)

    def text(block: str, c: str) -> str:
        def default(when: str) -> str:
            value = defaults[when][block]
            return _str(state.ordinal_order[c][0] if value is None else value)

        if defaults and have is not None and c not in have:
            return default("absent")
        x = f"CAST(`{c}` AS STRING)"
        return f"coalesce({x}, {default('null')})" if defaults else x

    def number(c: str) -> str:
        return "0.0D" if defaults and have is not None and c not in have else f"CAST(`{c}` AS DOUBLE)"

    for c in state.spec["ordinal"]:
        ladder = " ".join(f"WHEN {text('ordinal', c)} = {_str(v)} THEN {float(i)!r}D"
                          for i, v in enumerate(state.ordinal_order[c]))
        other = (f"raise_error(concat('unknown {c}: ', coalesce({text('ordinal', c)}, 'null')))"
                 if state.unknown_ordinal == "error" and not defaults else "-1.0D")
        out.append(f"CAST(CASE {ladder} ELSE {other} END AS DOUBLE)")
    for c in state.spec["onehot"]:
        for v in state.vocab[c][1:]:
            out.append(f"coalesce(CAST({text('onehot', c)} = {_str(v)} AS DOUBLE), 0.0D)")
    for c in state.spec["numeric"]:
        x = number(c)
        if clean_values:            # a missing number counts as 0 before it is scaled
            x = f"IF({x} * 0.0D = 0.0D, {x}, 0.0D)"
        out.append(f"(({x} - {_dbl(state.mean[c])}) / {_dbl(state.scale[c])})")
    for c in state.spec["binary"]:
        x = number(c)
        out.append(f"IF({x} * 0.0D = 0.0D, {x}, 0.0D)" if clean_values else x)
    return out


def unknown_reason(state: EncoderState, columns: Sequence[str]) -> Column:
    """Why a row can't be scored: given ordinal values outside their order, where the encoder allows none; else null."""
    tests = []
    for c in state.spec["ordinal"] if state.unknown_ordinal == "error" else ():
        if c in columns:
            known = ", ".join(_str(v) for v in state.ordinal_order[c])
            tests.append(f"IF(CAST(`{c}` AS STRING) NOT IN ({known}), "
                         f"{_str(c + ' not in ' + '/'.join(state.ordinal_order[c]))}, NULL)")
    return F.expr(f"nullif(concat_ws('; ', {', '.join(tests)}), '')" if tests else "CAST(NULL AS STRING)")


def unknown_counts(state: EncoderState, columns: Sequence[str]) -> list[Column]:
    """Per categorical column, aggregates of how many values are given and how many of these are unknown (Q6)."""
    known = {**{c: state.ordinal_order[c] for c in state.spec["ordinal"]},
             **{c: state.vocab[c] for c in state.spec["onehot"]}}
    out = []
    for c, values in known.items():
        if c in columns:
            x = F.col(c).cast("string")
            out += [F.count(x).alias(f"given__{c}"),
                    F.count_if(x.isNotNull() & ~x.isin(list(values))).alias(f"unknown__{c}")]
    return out


def encoded_exprs(state: EncoderState, clean_values: bool = True, columns: Sequence[str] | None = None,
                  defaults: Mapping | None = None) -> list[Column]:
    return [F.expr(e) for e in encoded_sql(state, clean_values, columns, defaults)]


def assemble(df: DataFrame, names: Sequence[str], out: str = "features",
             width: int | None = None) -> DataFrame:
    """M5/M6: one ``vector`` column in the given order, padded or cut to ``width``."""
    arr = F.array(*[F.col(n) for n in names])
    if width is not None:
        arr = pad_trim(arr, width)
    return df.withColumn(out, array_to_vector(arr))


def pad_trim(arr: Column, width: int) -> Column:
    """M6: zeros on the right, or cut, to exactly ``width`` elements."""
    return F.slice(F.concat(arr, F.array_repeat(F.lit(0.0), width)), 1, width)


# ------------------------------------------------------------------ split and weights


def split_hash(key: str, seed: int = 42) -> Column:
    """Uniform [0, 1) value from the row key: 52 bits of ``md5(key:split:seed)``."""
    text = F.concat(F.col(key).cast("string"), F.lit(f":split:{seed}"))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("bigint") / F.lit(float(2 ** 52))


def split(df: DataFrame, test_frac: float, key: str = "sme_id", seed: int = 42,
          stratify: str | None = None, col_name: str = "is_test") -> DataFrame:
    """M7: add a boolean ``is_test`` column; repeatable under any partitioning.

    Plain: the hash is below ``test_frac``. Stratified: per label, exactly
    ``floor(test_frac * n_label + 0.5)`` rows with the smallest hash go to
    test. The label's threshold comes from counts per hash bin: only the rows
    of the one bin that holds it are ranked, so no window holds a label's rows
    and any number of labels will do. Labels and thresholds, a row a label, are
    broadcast: a shuffle by label would leave as many tasks with rows as there are
    labels, here and in all that reads the result. Nothing runs before the result does.
    """
    u = split_hash(key, seed)
    if stratify is None:
        return df.withColumn(col_name, u < F.lit(float(test_frac)))
    rows = df.where(F.col(stratify).isNotNull()).select(F.col(stratify).alias("_label"), u.alias("_u"))
    rows = rows.withColumn("_bin", F.floor(F.col("_u") * SPLIT_BINS).cast("int"))
    by_label = Window.partitionBy("_label")
    bins = (rows.groupBy("_label", "_bin").agg(F.count("*").alias("_n"))
            .withColumn("_upto", F.sum("_n").over(by_label.orderBy("_bin")))
            .withColumn("_want", F.floor(F.lit(test_frac) * F.sum("_n").over(by_label) + 0.5)))
    edge = (bins.where((F.col("_upto") >= F.col("_want")) & (F.col("_upto") - F.col("_n") < F.col("_want")))
            .select("_label", "_bin", (F.col("_want") - F.col("_upto") + F.col("_n")).alias("_rank")))
    ranked = rows.join(edge, ["_label", "_bin"]).withColumn(
        "_at", F.row_number().over(Window.partitionBy("_label").orderBy("_u")))
    limit = (ranked.where(F.col("_at") == F.col("_rank"))
             .select(F.col("_label").alias("_limit_label"), F.col("_u").alias("_limit")))
    out = df.join(F.broadcast(limit), F.col(stratify) == F.col("_limit_label"), "left")
    return out.select(*[df[c] for c in df.columns],
                      F.coalesce(u <= F.col("_limit"), F.lit(False)).alias(col_name))


def _label_counts(df: DataFrame, label: str) -> dict:
    """Rows per class: a class label's values, which a model holds anyway."""
    return {r[0]: r[1] for r in df.where(F.col(label).isNotNull()).groupBy(label).count().collect()}


def class_weights(df: DataFrame, label: str) -> dict:
    """M8: balanced weights ``n / (k * n_class)``, one small aggregate."""
    counts = _label_counts(df, label)
    n, k = sum(counts.values()), len(counts)
    return {lab: n / (k * cnt) for lab, cnt in counts.items()}


def weight_expr(label: str, weights: Mapping) -> Column:
    out = None
    for lab, w in sorted(weights.items()):
        cond = F.col(label) == lab
        out = F.when(cond, F.lit(float(w))) if out is None else out.when(cond, F.lit(float(w)))
    return out


def label_index(df: DataFrame, label: str) -> list:
    """Label vocabulary in alphabetical order (index = position)."""
    return fit_vocabulary(df, [label])[label]


def index_expr(label: str, labels: Sequence) -> Column:
    out = None
    for i, lab in enumerate(labels):
        cond = col(label) == lab
        out = F.when(cond, F.lit(float(i))) if out is None else out.when(cond, F.lit(float(i)))
    return out


# ------------------------------------------------------------------ table views of the fitted state


def scaler_stats(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """A12 as a table: position, column_name, mean, std (population; 0 -> 1)."""
    agg = df.agg(*[e for i, c in enumerate(cols) for e in (
        F.avg(F.col(c).cast("double")).alias(f"m{i}"),
        F.stddev_pop(F.col(c).cast("double")).alias(f"s{i}"))])
    parts = ", ".join(f"{i}, '{c}', m{i}, CASE WHEN s{i} = 0 THEN 1.0D ELSE s{i} END"
                      for i, c in enumerate(cols))
    return agg.select(F.expr(f"stack({len(cols)}, {parts}) AS (position, column_name, mean, std)"))


def vocabulary(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """A13 as a table: column_name, position, value (sorted, nulls left out); any number of values."""
    cells = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value")) for c in cols])
    values = df.select(F.inline(cells)).where("value IS NOT NULL").distinct()
    placed = global_position(values, "column_name", "value", name="_place")
    first = placed.groupBy("column_name").agg(F.min("_place").alias("_first"))      # a row a column
    return placed.join(first, "column_name").select(
        "column_name", (F.col("_place") - F.col("_first")).cast("int").alias("position"), "value")


def class_weight_table(df: DataFrame, label: str) -> DataFrame:
    """M8 as a table: label, count, weight = n / (k * count)."""
    counts = df.where(F.col(label).isNotNull()).groupBy(label).count()
    n, k = counts.agg(F.sum("count")).scalar(), counts.agg(F.count("*")).scalar()
    return counts.withColumn("weight", n / (k * F.col("count")))


def label_index_table(df: DataFrame, label: str) -> DataFrame:
    """M13 as a table: label, index in alphabetical order; any number of labels."""
    labels = df.where(F.col(label).isNotNull()).select(label).distinct()
    return global_position(labels, label, name="index").withColumn("index", F.col("index").cast("int"))
