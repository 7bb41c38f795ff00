import math

from pyspark.sql import functions as F

from bizlens.functions import exprs as X


def one(spark, expr, data, schema="x DOUBLE"):
    return [r[0] for r in spark.createDataFrame(data, schema).select(expr.alias("o")).collect()]


def test_nz_and_ratios(spark):
    df = spark.createDataFrame([(10.0, 0.0), (10.0, 4.0), (10.0, None), (None, 2.0)], "n DOUBLE, d DOUBLE")
    got = df.select(X.ratio("n", "d").alias("a"), X.ratio_or_null("n", "d").alias("b")).collect()
    assert [(r.a, r.b) for r in got] == [(10.0, None), (2.5, 2.5), (None, None), (None, None)]


def test_clip_keeps_null(spark):
    got = one(spark, X.clip("x", 0, 1), [(None,), (-1.0,), (0.5,), (3.0,)])
    assert got == [None, 0.0, 0.5, 1.0]


def test_row_min_null(spark):
    df = spark.createDataFrame([(1, None), (3, 2), (None, None)], "a INT, b INT")
    assert [r[0] for r in df.select(X.row_min("a", "b")).collect()] == [None, 2, None]


def test_cut_right_closed_edges(spark):
    edges, labels = [0, 2, 5, math.inf], ["Startup", "Growth", "Mature"]
    data = [(0.0,), (0.1,), (2.0,), (2.0001,), (5.0,), (6.0,), (None,), (float("nan"),), (-1.0,)]
    got = one(spark, X.cut("x", edges, labels), data)
    assert got == [None, "Startup", "Startup", "Growth", "Growth", "Mature", None, None, None]


def test_cut_infinite_edges(spark):
    edges, labels = [-math.inf, 0, 0.15, math.inf], ["L", "T", "H"]
    got = one(spark, X.cut("x", edges, labels), [(-5.0,), (0.0,), (0.15,), (0.16,), (float("inf"),)])
    assert got == ["L", "L", "T", "H", "H"]


def test_threshold_label_left_closed(spark):
    cats = ["Critical", "At Risk", "Stable", "Thriving"]
    got = one(spark, X.threshold_label("x", [0.25, 0.5, 0.75], cats),
              [(0.0,), (0.2499,), (0.25,), (0.5,), (0.75,), (1.0,), (None,)])
    assert got == ["Critical", "Critical", "At Risk", "Stable", "Thriving", "Thriving", "Thriving"]


def test_flag_and_differs(spark):
    assert one(spark, X.flag(F.col("x") < 2), [(1.0,), (3.0,), (None,)]) == [1, 0, 0]
    df = spark.createDataFrame([("a", "a"), ("a", "b"), (None, "a"), (None, None)], "a STRING, b STRING")
    assert [r[0] for r in df.select(X.flag(X.differs("a", "b"))).collect()] == [0, 1, 1, 1]


def test_bround_half_even(spark):
    got = one(spark, X.bround("x", 1), [(0.15,), (0.25,), (0.35,), (-0.25,)])
    assert got == [0.2, 0.2, 0.4, -0.2]


def test_clean_and_repair(spark):
    data = [(None,), (float("nan"),), (float("inf"),), (float("-inf"),), (1.5,)]
    assert one(spark, X.clean("x"), data) == [0.0, 0.0, 0.0, 0.0, 1.5]
    assert one(spark, X.repair_nonfinite("x"), data) == [0.5, 0.5, 1.0, 0.0, 1.5]
    assert one(spark, X.clip01_repaired("x"), data + [(-3.0,), (7.0,)]) == [0.5, 0.5, 1.0, 0.0, 1.0, 0.0, 1.0]


def test_hash_and_noise_repeatable_under_repartition(spark):
    df = spark.range(2000).withColumn("u", X.hash01("id", "s")).withColumn("z", X.noise("id", "n"))
    a = {r.id: (r.u, r.z) for r in df.collect()}
    b = {r.id: (r.u, r.z) for r in df.repartition(7).collect()}
    assert a == b
    us = [v[0] for v in a.values()]
    zs = [v[1] for v in a.values()]
    assert min(us) >= 0 and max(us) < 1
    mean = sum(zs) / len(zs)
    sd = (sum((z - mean) ** 2 for z in zs) / len(zs)) ** 0.5
    assert abs(mean) < 0.1 and abs(sd - 1) < 0.1
