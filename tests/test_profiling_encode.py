"""Properties of profiling, exact quantiles, encoders, splits and metrics."""

import random

import numpy as np
from pyspark.sql import functions as F

from bizlens import schema as S
from bizlens.operators import encode as EN
from bizlens.operators import metrics as MT
from bizlens.operators import profiling as PR
from bizlens.plans import catalog as C
from tests.conftest import SF001


def test_exact_quantiles_match_numpy_with_hot_value(spark):
    rnd = random.Random(7)
    n = 30000
    vals = [rnd.gauss(0, 1) for _ in range(n)]
    vals[: n // 3] = [0.5] * (n // 3)          # one value holds a third of the rows
    vals += [None] * 50
    df = spark.createDataFrame([(v,) for v in vals], "x DOUBLE").repartition(6)
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0]
    # narrow digits force many passes
    got = PR.exact_quantiles(df, ["x"], probs, bits=4)["x"]
    assert got == PR.exact_quantiles(df, ["x"], probs)["x"]
    clean = np.array([v for v in vals if v is not None])
    for p in probs:
        assert abs(got[p] - float(np.quantile(clean, p))) < 1e-12


def test_value_counts_and_ordered_counts(spark):
    df = spark.createDataFrame([("a",), ("b",), ("a",), (None,)], "c STRING")
    assert [tuple(r) for r in PR.value_counts(df, "c").collect()] == [("a", 2), ("b", 1)]
    oc = PR.ordered_counts(df, "c", ["z", "a", "b"]).collect()
    assert [(r.c, r["count"]) for r in oc] == [("z", 0), ("a", 2), ("b", 1)]


def test_duplicates_treat_nulls_equal(spark):
    df = spark.createDataFrame([(1, None), (1, None), (2, "x")], "a INT, b STRING")
    r = PR.duplicate_rows(df).first()
    assert (r.rows, r.distinct_rows, r.duplicates) == (3, 2, 1)


def test_onehot_scaler_ordinal_properties(spark):
    sme = C.sme_table(spark, SF001)
    state = EN.fit_encoder(sme, S.FUNDING_FEATURES, unknown_ordinal="minus_one")
    enc = EN.encode(sme, state)
    # 2 ordinal + one-hot (vocab size - 1 each) + 28 numeric + 8 binary
    n_onehot = sum(len(state.vocab[c]) - 1 for c in S.FUNDING_FEATURES["onehot"])
    assert len(state.feature_names()) == 2 + n_onehot + 28 + 8
    for c in S.FUNDING_FEATURES["onehot"]:
        cols = [n for n in state.onehot_names() if n.startswith(f"oh__{c}__")]
        assert enc.select(F.max(sum((F.col(f"`{n}`") for n in cols), F.lit(0.0)))).first()[0] <= 1
    stats = enc.agg(*[F.avg(f"num__{c}").alias(f"m_{c}") for c in ("revenue", "debt_ratio")],
                    *[F.stddev_pop(f"num__{c}").alias(f"s_{c}") for c in ("revenue", "debt_ratio")]).first()
    assert abs(stats["m_revenue"]) < 1e-9 and abs(stats["s_revenue"] - 1) < 1e-9
    # unknown categories -> all zeros; unknown ordinal -> -1
    odd = sme.limit(1).withColumns({"sector": F.lit("space"), "business_stage": F.lit("scaleup")})
    row = EN.encode(odd, state).first()
    assert row["ord__business_stage"] == -1.0
    assert all(row[n] == 0.0 for n in state.onehot_names() if n.startswith("oh__sector__"))


def test_unknown_ordinal_error_mode(spark):
    df = spark.createDataFrame([("scaleup",)], "business_stage STRING")
    import pytest
    spec = {"ordinal": ["business_stage"], "onehot": [], "numeric": [], "binary": []}
    strict = EN.fit_encoder(df, spec, unknown_ordinal="error")
    with pytest.raises(Exception):
        EN.encode(df, strict, keep=()).collect()
    assert EN.encode(df, strict, keep=(), defaults=S.SERVING_DEFAULTS["funding"]).first()[0] == -1.0
    assert df.select(EN.unknown_reason(strict, df.columns)).first()[0] == "business_stage not in startup/growth/mature"


def test_constant_column_scales_to_zero(spark):
    df = spark.createDataFrame([(1, 5.0), (2, 5.0)], "sme_id INT, k DOUBLE")
    st = EN.fit_encoder(df, {"ordinal": [], "onehot": [], "numeric": ["k"], "binary": []}, {})
    assert [r.num__k for r in EN.encode(df, st).collect()] == [0.0, 0.0]


def test_pad_trim(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0],)], "a ARRAY<DOUBLE>")
    assert df.select(EN.pad_trim(F.col("a"), 5)).first()[0] == [1.0, 2.0, 3.0, 0.0, 0.0]
    assert df.select(EN.pad_trim(F.col("a"), 2)).first()[0] == [1.0, 2.0]


def test_split_disjoint_complete_repeatable_stratified(spark):
    sme = C.sme_table(spark, SF001).where(F.col("default_risk").isNotNull())
    a = EN.split(sme, 0.2, stratify="default_risk")
    b = EN.split(sme.repartition(5), 0.2, stratify="default_risk")
    ra = {r.sme_id: r.is_test for r in a.select("sme_id", "is_test").collect()}
    rb = {r.sme_id: r.is_test for r in b.select("sme_id", "is_test").collect()}
    assert ra == rb and len(ra) == sme.count()
    for r in a.groupBy("default_risk").agg(F.count(F.lit(1)).alias("n"), F.count_if("is_test").alias("t")).collect():
        assert abs(r.t - 0.2 * r.n) <= 1


def test_classification_metrics_by_hand(spark):
    data = [("a", "a"), ("a", "b"), ("b", "b"), ("b", "b"), ("c", "a")]
    df = spark.createDataFrame(data, "y STRING, p STRING")
    rep = {r.cls: r for r in MT.classification_report(df, "y", "p").collect()}
    assert abs(rep["a"].precision - 0.5) < 1e-12 and abs(rep["a"].recall - 0.5) < 1e-12
    assert abs(rep["b"].precision - 2 / 3) < 1e-12 and rep["b"].recall == 1.0
    assert rep["c"].precision == 0.0 and rep["c"].f1 == 0.0           # zero division -> 0
    assert abs(rep["accuracy"].f1 - 0.6) < 1e-12 and rep["accuracy"].support == 5
    assert abs(MT.accuracy(df, "y", "p").first().accuracy - 0.6) < 1e-12
    cm = {r.label: r for r in MT.confusion_matrix(df, "y", "p", ["a", "b", "c"]).collect()}
    assert (cm["a"].pred_a, cm["a"].pred_b, cm["c"].pred_a) == (1, 1, 1)


def test_regression_metrics_vs_numpy(spark):
    rnd = random.Random(3)
    y = [rnd.random() for _ in range(200)]
    p = [v + rnd.gauss(0, 0.1) for v in y]
    m = MT.regression_metrics(spark.createDataFrame(list(zip(y, p)), "y DOUBLE, p DOUBLE"), "y", "p").first()
    y, p = np.array(y), np.array(p)
    assert abs(m.rmse - np.sqrt(np.mean((y - p) ** 2))) < 1e-12
    assert abs(m.mae - np.mean(np.abs(y - p))) < 1e-12
    assert abs(m.r2 - (1 - np.sum((y - p) ** 2) / np.sum((y - y.mean()) ** 2))) < 1e-12


def test_exact_quantiles_with_infinities_and_any_spread(spark):
    rnd = random.Random(3)
    vals = [10.0 ** rnd.uniform(-300, 299) * rnd.choice([1, -1]) for _ in range(20000)]
    vals += [float("inf")] * 7 + [float("-inf")] * 3 + [0.0] * 5000 + [float("nan"), None]
    df = spark.createDataFrame([(v, 1.0) for v in vals], "x DOUBLE, one DOUBLE").repartition(5)
    ordered = sorted(v for v in vals if v is not None and v == v)
    n = len(ordered)
    ranks = [0, 1, 2, 3, n // 4, n // 2, n - 8, n - 7, n - 1]
    got = PR.kth_values(df.select("x"), {0: ranks}, bits=8)
    assert [got[0, k] for k in ranks] == [ordered[k] for k in ranks]
    assert PR.exact_quantiles(df, ["one"], [0.1, 0.5])["one"] == {0.1: 1.0, 0.5: 1.0}


def test_split_takes_any_number_of_labels(spark):
    rows = [(i, f"label{i % 4000}" if i % 3 else "hot") for i in range(20000)] + [(-1, None)]
    df = spark.createDataFrame(rows, "sme_id BIGINT, label STRING")
    got = {r["label"]: (r["n"], r["t"]) for r in EN.split(df, 0.3, stratify="label").groupBy("label").agg(
        F.count("*").alias("n"), F.count_if("is_test").alias("t")).collect()}
    assert got.pop(None) == (1, 0)
    assert all(t == int(0.3 * n + 0.5) for n, t in got.values()) and sum(n for n, _ in got.values()) == 20000


def test_wide_vocabulary_is_whole_and_sorted(spark):
    df = spark.range(30000).select((F.col("id") % 12000).cast("string").alias("c"))
    assert EN.fit_vocabulary(df, ["c"])["c"] == sorted(str(i) for i in range(12000))


def test_missing_numbers_count_as_zero_before_scaling(spark):
    df = spark.createDataFrame([(1, 2.0), (2, 4.0), (3, 6.0)], "sme_id BIGINT, x DOUBLE")
    spec = {"ordinal": [], "onehot": [], "numeric": ["x"], "binary": []}
    state = EN.fit_encoder(df, spec)
    bad = spark.createDataFrame([(1, None), (2, float("nan")), (3, float("inf")), (4, 0.0)], "sme_id BIGINT, x DOUBLE")
    assert {r["num__x"] for r in EN.encode(bad, state).collect()} == {-state.mean["x"] / state.scale["x"]}


def test_duplicates_of_colliding_fingerprints_are_told_apart(spark):
    rows = [(i % 40, "x" if i % 3 else None) for i in range(200)]
    df = spark.createDataFrame(rows, "a INT, b STRING")
    want = (200, len(set(rows)), 200 - len(set(rows)))
    for fingerprint in (None, F.lit(1), F.col("a") % 2):        # all rows collide, half of them, and none
        assert tuple(PR.duplicate_rows(df, fingerprint).first()) == want


def test_global_position_is_the_order_without_one_partition(spark):
    from bizlens.operators.ranking import global_position
    df = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("v")).repartition(6)
    got = global_position(df, "v")
    assert all(r.v == r.position for r in got.collect())
    assert "SinglePartition" not in got._jdf.queryExecution().executedPlan().toString()
    assert global_position(df.where("v < 0"), "v").collect() == []


def test_wide_columns_encode_as_the_narrow_way_does(spark, tmp_path):
    from pyspark.ml.functions import vector_to_array
    from bizlens.operators import wide as WD
    sme = C.sme_table(spark, SF001)
    state = EN.fit_encoder(sme, S.FUNDING_FEATURES)
    vocab = WD.fit_vocabulary_table(sme, S.FUNDING_FEATURES["onehot"], str(tmp_path / "v"))
    odd = sme.limit(60).withColumns({"sector": F.when(F.col("sme_id") % 3 == 0, F.lit("space")).otherwise(F.col("sector")),
                                     "location": F.when(F.col("sme_id") % 4 != 0, F.col("location"))}).cache()
    got = {r.sme_id: r.x for r in WD.encode_wide(odd, state, vocab).select("sme_id", vector_to_array("features").alias("x")).collect()}
    for r in EN.encode(odd, state).collect():
        assert np.allclose(got[r.sme_id], r[1:]), r.sme_id


def test_a_hundred_thousand_values_fit_encode_and_score(spark, tmp_path):
    from pyspark.ml.classification import LogisticRegression
    from bizlens.operators import wide as WD
    n = 100_000
    df = spark.range(n + 1000).select("id", F.when(F.col("id") < n, F.col("id")).otherwise(7).cast("string").alias("c"),
                                      (F.col("id") % 2).cast("double").alias("label"), F.rand(1).alias("x"))
    spec = {"ordinal": [], "onehot": ["c"], "numeric": ["x"], "binary": []}
    state = EN.EncoderState(spec, {}, mean={"x": 0.5}, scale={"x": 1.0})
    vocab = WD.fit_vocabulary_table(df, ["c"], str(tmp_path / "v"))
    made = WD.encode_wide(df, state, vocab)
    row = made.where("id = 12345").first()
    assert row.features.size == n and len(row.features.indices) == 2
    model = LogisticRegression(maxIter=2).fit(made)
    assert model.transform(made).where("prediction in (0, 1)").count() == n + 1000
