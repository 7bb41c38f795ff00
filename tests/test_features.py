"""Golden edges for feature, rule, label and decision operators (tiny frames)."""

from pyspark.sql import functions as F

from bizlens import schema as S
from bizlens.operators import decisions as D
from bizlens.operators import features as FT
from bizlens.operators import labels as LB
from bizlens.operators import quality as QL
from bizlens.plans import catalog as C
from tests.conftest import SF001


def base_row(**kw):
    row = {n: None for n, _ in S.SME_COLUMNS + S.HISTORY_COLUMNS}
    row.update(dict(
        sme_id=1, business_name="b", revenue=200000.0, profit_margin=0.1, debt_ratio=0.3,
        collateral_value=1000.0, marketing_spend=1000.0, employee_count=10, staff_count=5,
        age_of_business=4, sector="retail", previous_funding_received=1, previous_funding_amount=5e4,
        default_history=0, loan_applications_count=1, funding_requested_amount=2e5,
        expected_roi=0.2, project_duration_months=12, business_stage="growth", collateral_offered=1,
        business_registration_uploaded=1, tax_clearance_uploaded=1, financial_statements_uploaded=1,
        tax_registered=1, tax_paid_last_year=1, licenses_required=1, licenses_up_to_date=1,
        total_payroll=1e5, cost_per_hire=1e4, nssf_contribution_percent=0.06,
        nhif_contribution_percent=0.03, staff_turnover_rate=0.1, bank_balance=5e4,
        m_pesa_balance=1e4, pending_invoices=2, paid_invoices=8, late_payments=3,
        campaign_spend=500.0, clicks=100, impressions=1000, conversions=10, target_segment="low",
        total_customers=600, active_customers=300, repeat_customers=100, channels_used="online",
        owner_age=40, owner_gender="male", education_level="bachelor",
        employment_status="employed", location="Nairobi", revenue_6m_ago=150000.0,
        customers_6m_ago=500, marketing_spend_6m_ago=900.0))
    row.update(kw)
    return row


def frame(spark, rows):
    return spark.createDataFrame([tuple(r[n] for n in S.PROFILE_SCHEMA.names) for r in rows],
                                 S.PROFILE_SCHEMA)


def test_funding_bins_on_edges(spark):
    rows = [base_row(sme_id=i, profit_margin=pm, age_of_business=age, total_customers=tc,
                     funding_requested_amount=amt)
            for i, (pm, age, tc, amt) in enumerate([(0.0, 2, 500, 100000.0), (0.15, 5, 2000, 500000.0),
                                                    (0.1500001, 6, 2001, 500001.0), (-0.01, 0, 0, 0.0)])]
    out = FT.funding_features(frame(spark, rows), drop_nulls=False).orderBy("sme_id").collect()
    assert [r.profitability for r in out] == ["Loss-making", "Thin Margin", "Healthy Margin", "Loss-making"]
    assert [r.business_maturity for r in out] == ["Startup", "Growth", "Mature", None]
    assert [r.customer_base_size for r in out] == ["Small", "Medium", "Large", None]
    assert [r.funding_size_category for r in out] == ["Small", "Medium", "Large", None]
    # profit margin 0 -> debt_profit_ratio null -> financial_health null; P7 drops those rows
    assert out[0].debt_profit_ratio is None and out[0].financial_health is None
    kept = FT.funding_features(frame(spark, rows)).count()
    assert kept == 2


def test_zero_denominators(spark):
    r = base_row(employee_count=0, age_of_business=0, marketing_spend=0.0, revenue=0.0,
                 active_customers=0, paid_invoices=0, pending_invoices=0, clicks=0, total_customers=0,
                 revenue_6m_ago=0.0, customers_6m_ago=0)
    f = FT.funding_features(frame(spark, [r]), drop_nulls=False).first()
    assert f.profit_per_employee == 0.0 and f.late_payment_rate == 3.0
    assert f.invoice_completion_rate == 0.0 and f.liquidity_ratio == 6e4
    g = FT.growth_features(frame(spark, [r])).first()
    assert g.revenue_growth_6m == 0.0 and g.cash_runway_months == 6e4
    assert g.current_revenue_category is None and g.will_jump_category == 1   # null != null


def test_health_categories_all_four(spark):
    rows = [base_row(sme_id=1, profit_margin=-0.5, debt_ratio=1.0, bank_balance=0.0, m_pesa_balance=0.0,
                     paid_invoices=0, repeat_customers=0, revenue=1.0, tax_registered=0,
                     business_registration_uploaded=0),
            base_row(sme_id=2), base_row(sme_id=3, profit_margin=0.3, bank_balance=2e6)]
    h = FT.health_features(frame(spark, rows)).orderBy("sme_id").collect()
    assert h[0].health_category == "Critical" and h[0].health_probability == 0.0
    assert h[2].health_category == "Thriving"
    assert all(0 <= r.health_probability <= 1 for r in h)
    assert h[0].missing_docs == 1 and h[0].tax_noncompliant == 1 and h[0].low_cash == 1


def test_growth_ranges_on_profile(spark):
    g = FT.growth_features(C.sme_table(spark, SF001), noise_on=True)
    agg = g.agg(F.min("predicted_6m_growth_rate"), F.max("predicted_6m_growth_rate"),
                F.min("composite_growth_score"), F.max("composite_growth_score"),
                F.min("debt_capacity"), F.max("marketing_efficiency")).first()
    assert -0.3 <= agg[0] and agg[1] <= 0.4 and 0 <= agg[2] and agg[3] <= 100
    assert agg[4] >= 0 and agg[5] <= 1
    assert g.where(F.col("growth_stage").isNull()).count() == 0


def test_rules_idempotent_and_report(spark):
    prof = C.build_profile(spark, SF001)
    before = {r.rule: r.rows_breaking for r in QL.rule_report(prof).collect()}
    assert before["C5_nesting"] > 0
    once = QL.apply_rules(prof)
    assert all(r.rows_breaking == 0 for r in QL.rule_report(once).collect())
    twice = QL.apply_rules(once)
    assert once.exceptAll(twice).count() == 0


def test_masked_assign_null_mask(spark):
    df = spark.createDataFrame([(None, 5), (0.0, 5), (1.0, 5)], "s DOUBLE, c BIGINT")
    out = QL.masked_assign(df, F.col("s") == 0, ["c"], 0)
    assert [r.c for r in out.collect()] == [5, 0, 5]


def test_targets_default_risk_edges(spark):
    # risk = debt*0.4 + dh*0.4 + (1-pm)*0.2: choose rows landing on 0 and near bin edges
    rows = [base_row(sme_id=1, debt_ratio=0.0, default_history=0, profit_margin=1.0),
            base_row(sme_id=2, debt_ratio=1.0, default_history=1, profit_margin=-5.0),
            base_row(sme_id=3, debt_ratio=0.8, default_history=0, profit_margin=0.5)]  # 0.42
    t = LB.add_targets(frame(spark, rows), keep_scores=True).orderBy("sme_id").collect()
    assert t[0].default_risk_score == 0.0 and t[0].default_risk is None   # exactly 0 -> null
    assert t[1].default_risk_score == 1.0 and t[1].default_risk == "high"
    assert t[2].default_risk == "medium"
    assert all(0 <= r.business_health_score <= 100 for r in t)


def test_growth_action_edges(spark):
    df = spark.createDataFrame([(0.25,), (0.2499,), (0.10,), (0.0,), (-0.01,), (None,)], "r DOUBLE")
    got = [r[0] for r in df.select(D.growth_action("r")).collect()]
    assert got == ["fast_track_funding", "growth_support", "growth_support", "stability_support",
                   "intervention_required", "intervention_required"]


def test_compliance_branches(spark):
    df = spark.createDataFrame([(0.1, 0, 90.0), (0.6, 1, 90.0), (0.59, 1, 49.9), (0.7, 1, 10.0),
                                (0.1, 1, 50.0)], "p DOUBLE, e INT, h DOUBLE")
    level, reasons = D.compliance("p", "e", "h")
    got = [(r[0], list(r[1])) for r in df.select(level, reasons).collect()]
    assert got == [("HIGH", ["FUNDING_POLICY_VIOLATION"]), ("HIGH", ["HIGH_DEFAULT_RISK"]),
                   ("MEDIUM", ["POOR_BUSINESS_HEALTH"]),
                   ("HIGH", ["HIGH_DEFAULT_RISK", "POOR_BUSINESS_HEALTH"]), ("LOW", ["ALL_OK"])]


def test_join_with_suffix(spark):
    a = spark.createDataFrame([(1, 1.0, "x")], "sme_id INT, v DOUBLE, s STRING")
    b = spark.createDataFrame([(1, 2.0, 3)], "sme_id INT, v DOUBLE, w INT")
    out = D.join_with_suffix(a, b)
    assert out.columns == ["sme_id", "v", "s", "v_growth", "w"]
    assert tuple(out.first()) == (1, 1.0, "x", 2.0, 3)


def test_nan_is_null_to_every_rule(spark):
    """A NaN behaves as a missing number: no comparison with it holds, no band or score takes it."""
    from bizlens.operators import decisions as D, features as FT, labels as LB
    from bizlens.plans import catalog as C
    base = C.build_profile(spark, SF001).limit(4)
    doubles = [f.name for f in base.schema.fields if f.dataType.simpleString() == "double"]
    for name in doubles[::3]:
        nan = base.withColumn(name, F.lit(float("nan")))
        null = base.withColumn(name, F.lit(None).cast("double"))
        for make in (lambda d: FT.funding_features(d, drop_nulls=False), FT.health_features, FT.growth_features, LB.add_targets):
            a = [{k: v for k, v in r.asDict().items() if k != name} for r in make(nan).orderBy("sme_id").collect()]
            b = [{k: v for k, v in r.asDict().items() if k != name} for r in make(null).orderBy("sme_id").collect()]
            assert a == b, name
    df = spark.createDataFrame([(float("nan"),), (None,), (0.3,)], "r DOUBLE").select(D.growth_action("r").alias("a"))
    assert [r.a for r in df.collect()] == ["intervention_required", "intervention_required", "fast_track_funding"]


def test_clip_and_row_min_keep_nan(spark):
    from bizlens.functions.exprs import clip, row_min
    r = spark.createDataFrame([(float("nan"), 1.0)], "a DOUBLE, b DOUBLE").select(
        clip("a", 0, 1).alias("c"), row_min("a", "b").alias("m"), row_min("b", "a").alias("n")).first()
    assert all(x != x for x in r)
