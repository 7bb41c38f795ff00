"""Evaluation metrics as aggregates.

Classification metrics start from the confusion counts, ``groupBy(label,
prediction).count()``, whose size is bounded by the number of classes
squared; everything after that works on that small table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def accuracy(df: DataFrame, label: str, pred: str) -> DataFrame:
    """Share of rows whose prediction equals the label."""
    return df.agg(F.avg(F.coalesce(F.col(label) == F.col(pred), F.lit(False)).cast("double"))
                  .alias("accuracy"), F.count(F.lit(1)).alias("rows"))


def _div0(a, b):
    return F.when(b == 0, F.lit(0.0)).otherwise(a / b)


def classification_report(df: DataFrame, label: str, pred: str) -> DataFrame:
    """Precision, recall, F1 and support per class, plus accuracy, macro and weighted.

    Zero division gives 0. Rows: one per class (``kind = 'class'``), then
    ``accuracy``, ``macro avg`` and ``weighted avg``. Each confusion cell becomes
    a record for its true and its predicted class; the summary rows are one
    aggregate over the classes' rows, so any number of classes will do.
    """
    y, p = F.col(label).cast("string"), F.col(pred).cast("string")
    cm = df.groupBy(y.alias("y"), p.alias("p")).count()
    cnt, zero = F.col("count"), F.lit(0).cast("bigint")
    rec = cm.select(F.explode(F.array(
        F.struct(F.col("y").alias("cls"), F.when(F.col("y") == F.col("p"), cnt).otherwise(zero).alias("tp"),
                 cnt.alias("support"), zero.alias("predicted")),
        F.struct(F.col("p").alias("cls"), zero.alias("tp"), zero.alias("support"),
                 cnt.alias("predicted")))).alias("r")).select("r.*").where(F.col("cls").isNotNull())
    per = rec.groupBy("cls").agg(F.sum("tp").alias("tp"), F.sum("support").alias("support"),
                                 F.sum("predicted").alias("predicted"))
    per = per.select("cls", "tp", "support",
                     _div0(F.col("tp"), F.col("predicted")).alias("precision"),
                     _div0(F.col("tp"), F.col("support")).alias("recall"))
    per = per.withColumn("f1", _div0(2 * F.col("precision") * F.col("recall"),
                                     F.col("precision") + F.col("recall")))
    fields = ["cls", "precision", "recall", "f1", "support", "kind"]
    by_class = per.select("cls", "precision", "recall", "f1", F.col("support").cast("bigint").alias("support"),
                          F.lit("class").alias("kind"))
    n = F.sum("support")
    mean = lambda c: F.sum(F.col(c) * F.col("support")) / n
    whole = per.agg(n.cast("bigint").alias("n"), (F.sum("tp") / n).alias("acc"),
                    *[F.avg(c).alias(f"m_{c}") for c in fields[1:4]], *[mean(c).alias(f"w_{c}") for c in fields[1:4]])
    null = F.lit(None).cast("double")

    def row(name, p_, r_, f_, kind):
        return F.struct(F.lit(name).alias("cls"), p_.alias("precision"), r_.alias("recall"), f_.alias("f1"),
                        F.col("n").alias("support"), F.lit(kind).alias("kind"))
    summary = whole.where("n > 0").select(F.inline(F.array(
        row("accuracy", null, null, F.col("acc"), "accuracy"),
        *[row(f"{kind} avg", *[F.col(f"{kind[0]}_{c}") for c in fields[1:4]], f"{kind} avg")
          for kind in ("macro", "weighted")])))
    return by_class.unionByName(summary)


def confusion_matrix(df: DataFrame, label: str, pred: str, labels: Sequence[str]) -> DataFrame:
    """Counts with true labels as rows and predictions as columns, in ``labels`` order."""
    y, p = F.col(label), F.col(pred)
    aggs = [F.count_if((y == a) & (p == b)).alias(f"c{i}_{j}")
            for i, a in enumerate(labels) for j, b in enumerate(labels)]
    cols = ", ".join(f"`pred_{b}`" for b in labels)
    parts = ", ".join(f"{i}, '{a}', " + ", ".join(f"c{i}_{j}" for j in range(len(labels)))
                      for i, a in enumerate(labels))
    return df.agg(*aggs).select(F.expr(
        f"stack({len(labels)}, {parts}) AS (position, label, {cols})"))


def regression_metrics(df: DataFrame, label: str, pred: str) -> DataFrame:
    """RMSE, MAE and R-squared in one aggregate; the label's spread is its population variance."""
    y, p = F.col(label).cast("double"), F.col(pred).cast("double")
    both = df.where(y.isNotNull() & p.isNotNull())
    err, n = y - p, F.count(F.lit(1))
    return both.agg(F.sqrt(F.avg(err * err)).alias("rmse"), F.avg(F.abs(err)).alias("mae"),
                    (1 - F.sum(err * err) / F.nullif(F.var_pop(y) * n, F.lit(0.0))).alias("r2"), n.alias("rows"))
