"""Training tables are spread over all cores, whatever their labels, keys and former partitions."""

import pytest
from pyspark.sql import functions as F

from bizlens.operators import encode as EN
from bizlens.plans import models as MD


@pytest.fixture
def many_shuffle_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def sizes(df):
    return sorted(r["count"] for r in df.groupBy(F.spark_partition_id().alias("at")).count().collect())


def test_a_stratified_split_does_not_gather_a_labels_rows(spark, many_shuffle_partitions):
    df = spark.range(0, 8000, 1, 8).select(F.col("id").alias("sme_id"), F.when(F.col("id") % 20 == 0, "rare").otherwise("usual").alias("label"))
    out = EN.split(df, 0.25, stratify="label").checkpoint()
    assert sizes(out) == [1000] * 8
    got = {r["label"]: r["t"] for r in out.groupBy("label").agg(F.count_if("is_test").alias("t")).collect()}
    assert got == {"rare": 100, "usual": 1900}


def test_rows_are_dealt_out_by_their_values(spark, monkeypatch):
    monkeypatch.setattr(MD, "FEWEST_ROWS", 1000)
    df = spark.range(0, 9000, 1, 3).select(F.when(F.col("id") % 10 == 0, F.col("id")).alias("sme_id"),
                                           (F.col("id") % 4500).cast("double").alias("x"), F.lit(None).cast("string").alias("s"))
    one, other = MD.dealt_out(df), MD.dealt_out(df.repartition(7, "x"))
    placed = lambda t: t.rdd.glom().map(lambda rows: [tuple(r) for r in rows]).collect()
    assert placed(one) == placed(other)
    assert sum(sizes(one)) == 9000 and len(sizes(one)) == 4 and sizes(one)[-1] < 1.2 * 9000 / 4


def test_training_partitions_grow_with_the_rows():
    few, most = MD.FEWEST_ROWS, MD.MOST_ROWS
    assert [MD.training_partitions(n, 12) for n in (0, 1, few + 1, 100 * few, 12 * most, 12 * most + 1, 30 * most)] == [1, 1, 2, 12, 12, 24, 36]
