"""Models (quality, save/load), requests (defaults, rejects) and stream == batch."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from bizlens.plans import catalog as C
from bizlens.plans import jobs as J
from bizlens.plans.models import Bundle
from bizlens.sources import requests as RQ
from bizlens.streaming import scoring as ST
from tests.conftest import SF001, SF01

SMALL = {"eligibility": {"numTrees": 20}, "default_risk": {"numTrees": 20},
         "business_health": {"numTrees": 20}, "health_category": {"maxIter": 10},
         "growth_rate": {"maxIter": 20}, "category_jump": {"numTrees": 20},
         "growth_stage": {"numTrees": 20}}


def _bundles(spark):
    return J.trained_bundles(spark, C.sme_table(spark, SF01), "tests", overrides=SMALL)


def test_models_beat_trivial_baselines(spark):
    b = _bundles(spark)
    sme = C.sme_table(spark, SF01)
    elig_share = sme.agg(F.avg("eligible_for_funding")).first()[0]
    majority = max(elig_share, 1 - elig_share)
    m = b["funding"].metrics
    assert m["eligibility"]["accuracy"] >= majority
    assert m["business_health"]["r2"] > 0.5
    assert b["growth"].metrics["growth_rate"]["r2"] > 0.5
    assert b["health"].metrics["health_category"]["accuracy"] > 0.5


def test_save_load_same_scores(spark):
    b = _bundles(spark)["funding"]
    sme = C.sme_table(spark, SF01)
    path = os.path.join(tempfile.mkdtemp(prefix="bizlens-bundle-"), "funding")
    b.save(spark, path)
    again = Bundle.load(spark, path)
    x = J.score_funding(b, sme).orderBy("sme_id").collect()
    y = J.score_funding(again, sme).orderBy("sme_id").collect()
    assert x == y and len(x) == sme.count()


def test_score_all_shape(spark):
    out = J.score_all(_bundles(spark), C.sme_table(spark, SF01))
    assert out.columns == ["sme_id", "growth", "health", "funding", "compliance"]
    r = out.first()
    assert r.compliance.compliance_risk in ("LOW", "MEDIUM", "HIGH")
    assert r.health.risk_flags.total == sum(r.health.risk_flags[:6])


def test_request_defaults_and_rejects(spark):
    raw = spark.createDataFrame([
        ("{}",),
        ('{"sme_id": "a", "revenue": null, "business_stage": "mature"}',),
        ('{"sme_id": "b", "business_stage": "scaleup"}',),
        ('{"sme_id": "c", "revenue": "lots"}',),
        ('{"sme_id": "d", "unknown_field": 1, "cash_months": 7.5, "low_cash": 1}',),
        ("not json",)], "value STRING")
    parsed = RQ.parse_requests(raw.coalesce(1)).collect()    # one partition keeps line order
    empty, a, b, c, _, junk = parsed
    assert empty.sme_id == "unknown" and empty.reject_reason is None and empty.employee_count == 1.0
    assert empty.education_level == "highschool" and empty.tax_registered == 1
    assert a.revenue is None and a.reject_reason is None     # an explicit null is no absent field
    assert "business_stage" in b.reject_reason
    assert c.reject_reason == "revenue is not a number" and junk.reject_reason.startswith("malformed")
    valid, rejected = RQ.split_requests(RQ.parse_requests(raw))
    assert valid.count() == 3 and rejected.count() == 3
    filled = {r.sme_id: r for r in RQ.fill_flags(RQ.fill_ratios(valid)).collect()}
    assert filled["d"].cash_months == 7.5          # given value kept
    assert filled["d"].low_cash == 1               # given flag kept
    assert filled["unknown"].liquidity_ratio == 0.0 and filled["unknown"].low_cash == 1   # computed
    assert filled["unknown"].missing_docs == 0


def test_lenient_numbers_and_explicit_nulls(spark):
    rows = ['{"revenue": "12.5", "tax_registered": 1.0, "low_cash": true}', '{"tax_registered": null}',
            '{"tax_registered": 1.5, "education_level": null}', "[1, 2]", '{"revenue": 1', None, '{"employee_count": null}',
            '{"revenue": "NaN", "sme_id": null}']
    got = RQ.parse_requests(spark.createDataFrame([(r,) for r in rows], "value STRING").coalesce(1)).collect()
    assert (got[0].revenue, got[0].tax_registered, got[0].low_cash, got[0].reject_reason) == (12.5, 1, 1, None)
    assert got[1].reject_reason == "tax_registered is not a whole number"
    assert set(got[2].reject_reason.split("; ")) == {"education_level not in none/highschool/bachelor/master/phd",
                                                     "tax_registered is not a whole number"}
    assert all(got[i].reject_reason.startswith("malformed") for i in (3, 4, 5))
    assert got[6].reject_reason is None and got[6].employee_count is None
    assert got[7].reject_reason is None and got[7].revenue is None and got[7].sme_id is None


def test_absent_columns_and_nulls_take_the_bundle_defaults(spark):
    b = _bundles(spark)
    sme = C.sme_table(spark, SF01).limit(50)
    less = sme.drop("sector", "location", "profit_margin").withColumn("owner_gender", F.lit(None).cast("string"))
    full = (less.withColumns({"sector": F.lit("0"), "location": F.lit("0"), "profit_margin": F.lit(0.0)})
            .withColumn("owner_gender", F.lit("unknown")))
    key = ["sme_id", "eligible_for_funding", "default_risk", "business_health_score"]
    assert sorted(map(str, J.score_funding(b["funding"], less).select(key).collect())) == sorted(
        map(str, J.score_funding(b["funding"], full).select(key).collect()))


def test_training_takes_missing_ordinals_as_scoring_does_and_raises_on_unknown_ones(spark):
    from bizlens.plans import models as MD
    small = {n: {"numTrees": 2, "maxDepth": 3} for n in ("eligibility", "default_risk", "business_health")}
    sme = C.sme_table(spark, SF001)
    level = lambda odd: F.when(F.col("sme_id") % 9 != 0, F.col("education_level")).otherwise(F.lit(odd))
    none, null = (sme.withColumn("education_level", level(v)).checkpoint() for v in ("none", None))
    x, y = (J.score_funding(MD.train_bundle(spark, t, "funding", overrides=small), t).orderBy("sme_id").collect()
            for t in (none, null))
    assert x == y and len(x) == sme.count()
    with pytest.raises(Exception, match="unknown education_level: diploma"):
        MD.train_bundle(spark, sme.withColumn("education_level", level("diploma")), "funding", overrides=small)


def test_training_after_an_observation_in_the_same_session(spark):
    from pyspark.sql import Observation

    from bizlens.plans import models as MD
    spark = spark.newSession()          # other tests' models may hold the shared one
    watch = Observation("before-training")
    spark.range(3).observe(watch, F.count(F.lit(1)).alias("n")).count()
    assert watch.get == {"n": 3}
    small = {n: {"numTrees": 2, "maxDepth": 3} for n in ("eligibility", "default_risk", "business_health")}
    b = MD.train_bundle(spark, C.sme_table(spark, SF001), "funding", overrides=small)
    assert J.score_funding(b, C.sme_table(spark, SF001)).count() == 150
    assert not b.models["eligibility"].hasSummary


def test_hold_out_reports_and_encoder_rows(spark):
    from bizlens.plans import models as MD
    bundles = list(_bundles(spark).values())
    rep = MD.report_table(spark, bundles).where("class = 'accuracy'").collect()
    con = MD.confusion_table(spark, bundles).groupBy("bundle", "model").agg(
        F.sum("count").alias("n"), F.sum(F.when(F.col("label") == F.col("predicted"), F.col("count")).otherwise(0)).alias("ok")).collect()
    right = {(r.bundle, r.model): r.ok / r.n for r in con}
    assert len(rep) == len(right) >= 5
    assert all(abs(right[r.bundle, r.model] - r.f1) < 1e-9 for r in rep)
    assert "fit_seconds" not in {r.metric for r in MD.metrics_table(spark, bundles).collect()}


def test_bundle_pads_and_trims_to_its_models(spark):
    from bizlens.operators import encode as EN
    b = _bundles(spark)["funding"]
    assert b.width() is None
    state = EN.EncoderState.from_json(b.state.to_json())
    state.spec["binary"] = state.spec["binary"][:-1]
    short = Bundle(b.name, state, b.specs, b.models, b.labels, b.metrics)
    sme = C.sme_table(spark, SF01).limit(20)
    assert short.width() == len(b.state.feature_names())
    last = b.state.spec["binary"][-1]
    x = J.score_funding(short, sme).orderBy("sme_id").collect()
    assert x == J.score_funding(b, sme.withColumn(last, F.lit(0))).orderBy("sme_id").collect()


def test_stream_equals_batch(spark):
    b = _bundles(spark)
    sme = C.sme_table(spark, SF01)
    base = tempfile.mkdtemp(prefix="bizlens-stream-")
    RQ.request_json(sme).write.text(os.path.join(base, "req"))
    q = ST.start_scoring_stream(spark, b, os.path.join(base, "req"), os.path.join(base, "out"),
                                os.path.join(base, "ck"))
    q.awaitTermination()
    streamed = spark.read.schema("sme_id STRING, result STRING").json(os.path.join(base, "out"))
    valid, _ = RQ.split_requests(RQ.parse_requests(spark.read.text(os.path.join(base, "req"))))
    batch = ST.result_json(ST.score_requests(b, valid))
    assert streamed.count() == sme.count()
    assert streamed.exceptAll(batch).count() == 0 and batch.exceptAll(streamed).count() == 0
