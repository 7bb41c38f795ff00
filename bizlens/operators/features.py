"""Funding (FF), health (HF) and growth (GF) feature projections.

Each function is a narrow transformation: a few stages of ``withColumns``
that Catalyst collapses into one projection, no shuffle. A later stage may
use columns made by an earlier one, in the order the rules are defined.

Noise (N1) is off by default; with ``noise=True`` each draw is a function of
the row key only, so results do not depend on partitioning.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bizlens import schema as S
from bizlens.functions.exprs import (bround, clip, clip01, cut, differs, flag, noise,
                                     ratio, ratio_or_null, threshold_label, without_nan)

INF = math.inf

# Bin edges and labels of the categorical features.
PROFITABILITY = ([-INF, 0, 0.15, INF], ["Loss-making", "Thin Margin", "Healthy Margin"])
FINANCIAL_HEALTH = ([-INF, 1, 3, INF], ["Stable", "Manageable", "Risky"])
PAYMENT_BEHAVIOR = ([-INF, 0.5, 2, INF], ["Reliable", "Occasional", "Problematic"])
OPERATIONAL_EFFICIENCY = ([-INF, 50000, 100000, INF], ["Lean", "Balanced", "High-performing"])
MARKETING_ROI_BANDS = ([-INF, 5, 15, INF], ["Low ROI", "Moderate ROI", "High ROI"])
BUSINESS_MATURITY = ([0, 2, 5, INF], ["Startup", "Growth", "Mature"])
CUSTOMER_BASE_SIZE = ([0, 500, 2000, INF], ["Small", "Medium", "Large"])
FUNDING_SIZE = ([0, 100000, 500000, INF], ["Small", "Medium", "Large"])
REVENUE_SIZE = ([0, 100000, 500000, INF], S.SIZE_CATEGORIES)
GROWTH_STAGE_BINS = ([-1, -0.05, 0.05, 0.15, 1], S.GROWTH_STAGES)
HEALTH_LIMITS = [0.25, 0.50, 0.75]

# Noise spread of the labels, and the growth stage priors by age.
HEALTH_NOISE_SD = 0.15
STAGE_FACTOR = [(3, 0.03, 0.08), (7, 0.02, 0.06), (None, 0.0, 0.04)]  # (age below, mean, sd)
MARKET_NOISE_SD = 0.05
MEAN_GROWTH = 0.10


def c(name: str):
    return F.col(name)


def liquid() -> F.Column:
    return c("bank_balance") + c("m_pesa_balance")


# ------------------------------------------------------------------ funding (FF1-FF19)


def funding_features(df: DataFrame, drop_nulls: bool = True) -> DataFrame:
    """Funding ratios and bands; rows with any null are dropped."""
    out = without_nan(df).withColumns({
        "log_revenue": F.log1p(c("revenue")),
        "profit_per_employee": ratio("revenue", "employee_count"),
        "late_payment_rate": ratio("late_payments", "age_of_business"),
        "debt_profit_ratio": ratio_or_null("debt_ratio", "profit_margin"),
        "marketing_efficiency": ratio("revenue", "marketing_spend"),
        "funding_request_ratio": ratio("funding_requested_amount", "revenue"),
        "customer_retention_rate": ratio("repeat_customers", "active_customers"),
        "invoice_completion_rate": ratio("paid_invoices", c("paid_invoices") + c("pending_invoices")),
        "liquidity_ratio": ratio(liquid(), "revenue"),
        "payroll_to_revenue": ratio("total_payroll", "revenue"),
        "marketing_conversion_rate": ratio("conversions", "clicks"),
    }).withColumns({
        "profitability": cut("profit_margin", *PROFITABILITY),
        "financial_health": cut("debt_profit_ratio", *FINANCIAL_HEALTH),
        "payment_behavior": cut("late_payment_rate", *PAYMENT_BEHAVIOR),
        "operational_efficiency": cut("profit_per_employee", *OPERATIONAL_EFFICIENCY),
        "marketing_roi": cut("marketing_efficiency", *MARKETING_ROI_BANDS),
        "business_maturity": cut("age_of_business", *BUSINESS_MATURITY),
        "customer_base_size": cut("total_customers", *CUSTOMER_BASE_SIZE),
        "funding_size_category": cut("funding_requested_amount", *FUNDING_SIZE),
    })
    return out.dropna("any") if drop_nulls else out


# ------------------------------------------------------------------ health (HF1-HF18)


def health_ratios(df: DataFrame) -> DataFrame:
    """HF1-HF10."""
    return without_nan(df).withColumns({
        "liquidity_ratio": ratio(liquid(), "revenue"),
    }).withColumns({
        "cash_months": c("liquidity_ratio") * 12,
        "revenue_per_employee": ratio("revenue", "employee_count"),
        "payroll_to_revenue": ratio("total_payroll", "revenue"),
        "invoice_paid_rate": ratio("paid_invoices", c("paid_invoices") + c("pending_invoices")),
        "staff_retention_rate": 1 - c("staff_turnover_rate"),
        "customer_active_rate": ratio("active_customers", "total_customers"),
        "customer_repeat_rate": ratio("repeat_customers", "active_customers"),
        "marketing_roi": ratio("revenue", "marketing_spend"),
        "conversion_rate": ratio("conversions", "clicks"),
    })


def risk_flags(df: DataFrame) -> DataFrame:
    """HF11-HF15 (needs ``cash_months``)."""
    return without_nan(df).withColumns({
        "low_cash": flag(c("cash_months") < 2),
        "high_debt": flag(c("debt_ratio") > 0.6),
        "low_profit": flag(c("profit_margin") < 0.05),
        "late_payer": flag(c("late_payments") > c("age_of_business")),
        "missing_docs": flag((c("business_registration_uploaded") == 0)
                             | (c("tax_clearance_uploaded") == 0)
                             | (c("financial_statements_uploaded") == 0)),
        "tax_noncompliant": flag((c("tax_registered") == 0) | (c("tax_paid_last_year") == 0)),
        "license_expired": flag(c("licenses_up_to_date") == 0),
    })


def base_health() -> F.Column:
    """HF16: weighted health score in [0, 1]."""
    return clip01(
        (c("profit_margin") / 0.30) * 0.20
        + (c("cash_months") / 12) * 0.20
        + ((1 - c("debt_ratio")) / 1.0) * 0.15
        + c("invoice_paid_rate") * 0.10
        + c("customer_repeat_rate") * 0.10
        + clip01(c("revenue") / 500000) * 0.10
        + (1 - c("missing_docs")) * 0.08
        + (1 - c("tax_noncompliant")) * 0.07)


def health_features(df: DataFrame, noise_on: bool = False, key: str = "sme_id") -> DataFrame:
    """HF1-HF18: ratios, risk flags, health probability and category."""
    out = risk_flags(health_ratios(df)).withColumn("base_health", base_health())
    prob = c("base_health")
    if noise_on:
        prob = prob + noise(key, "health", 0.0, HEALTH_NOISE_SD)
    out = out.withColumn("health_probability", clip01(prob))
    out = out.withColumn("health_category",
                         threshold_label("health_probability", HEALTH_LIMITS, S.HEALTH_CATEGORIES))
    return out.drop("base_health")


# ------------------------------------------------------------------ growth (GF2-GF28)


def growth_features(df: DataFrame, noise_on: bool = False, key: str = "sme_id") -> DataFrame:
    """GF2-GF28 on a table that carries the ``*_6m_ago`` history columns."""
    cust_delta = c("total_customers") - c("customers_6m_ago")
    out = without_nan(df).withColumns({
        "revenue_growth_6m": ratio(c("revenue") - c("revenue_6m_ago"), "revenue_6m_ago"),
        "customer_growth_6m": ratio(cust_delta, "customers_6m_ago"),
        "customer_retention_rate": ratio("repeat_customers", "active_customers"),
        "customer_activation_rate": ratio("active_customers", "total_customers"),
        "customer_acquisition_rate": cust_delta / 6,
        "cash_runway_months": ratio(liquid(), c("revenue") / 12),
        "debt_capacity": clip01(1 - c("debt_ratio")),
        "reinvestment_capacity": c("profit_margin") * c("revenue"),
        "revenue_per_employee": ratio("revenue", "employee_count"),
        "staff_stability": 1 - c("staff_turnover_rate"),
        "customer_base_growth": ratio(cust_delta, "customers_6m_ago"),
        "marketing_roi": ratio("revenue", "marketing_spend"),
        "marketing_intensity": ratio("marketing_spend", "revenue"),
        "conversion_rate": ratio("conversions", "clicks"),
        "has_funding_track": c("previous_funding_received").cast("int"),
        "funding_growth_boost": F.when(c("previous_funding_received") == 1,
                                       clip01(ratio("previous_funding_amount", "revenue")))
                                 .otherwise(F.lit(0.0)),
    }).withColumns({
        "revenue_velocity": c("revenue_growth_6m") / 6,
        "customer_velocity": c("customer_growth_6m") / 6,
        "operational_leverage": clip(c("revenue_per_employee") / 50000, 0, 5),
        "market_penetration_velocity": c("customer_base_growth") / 6,
        "marketing_efficiency": clip01(F.log1p(c("marketing_roi")) / 10),
        "marketing_growth_potential": clip01(c("marketing_roi") * c("marketing_intensity")),
    }).withColumns({
        "composite_growth_score": bround(clip(
            (c("revenue_velocity") * 6) * 20
            + (c("customer_velocity") * 6) * 15
            + clip01(c("cash_runway_months") / 6) * 15
            + c("debt_capacity") * 15
            + clip01(c("operational_leverage") / 2) * 15
            + c("marketing_efficiency") * 20, 0, 100), 1),
    })
    return growth_targets(out, noise_on, key)


def stage_factor(noise_on: bool, key: str) -> F.Column:
    age = c("age_of_business")
    out = None
    for below, mean, sd in STAGE_FACTOR:
        val = noise(key, f"stage{below}", mean, sd) if noise_on else F.lit(float(mean))
        if below is None:
            return out.otherwise(val)
        cond = age < below
        out = F.when(cond, val) if out is None else out.when(cond, val)
    return out


def growth_targets(df: DataFrame, noise_on: bool = False, key: str = "sme_id") -> DataFrame:
    """GF21-GF28: predicted growth rate, revenue, categories and stage."""
    market = noise(key, "market", 0.0, MARKET_NOISE_SD) if noise_on else F.lit(0.0)
    health_boost = (F.when((c("profit_margin") > 0.10) & (c("debt_ratio") < 0.4), F.lit(0.05))
                    .when(c("profit_margin") < 0, F.lit(-0.10)).otherwise(F.lit(0.0)))
    raw = clip(c("revenue_growth_6m"), -0.30, 0.50) * 0.40 + health_boost \
        + stage_factor(noise_on, key) + market
    out = without_nan(df).withColumn(
        "predicted_6m_growth_rate",
        bround(clip(raw * 0.70 + F.lit(MEAN_GROWTH * 0.30), -0.30, 0.40), 3))
    out = out.withColumn("predicted_6m_revenue",
                         c("revenue") * (1 + c("predicted_6m_growth_rate")))
    out = out.withColumns({
        "current_revenue_category": cut("revenue", *REVENUE_SIZE),
        "predicted_revenue_category": cut("predicted_6m_revenue", *REVENUE_SIZE),
        "growth_stage": cut("predicted_6m_growth_rate", *GROWTH_STAGE_BINS),
    })
    return out.withColumn("will_jump_category",
                          flag(differs("predicted_revenue_category", "current_revenue_category")))


# Columns each feature set adds, in order (used to line up joined tables).
HEALTH_ADDED = ["liquidity_ratio", "cash_months", "revenue_per_employee", "payroll_to_revenue",
                "invoice_paid_rate", "staff_retention_rate", "customer_active_rate",
                "customer_repeat_rate", "marketing_roi", "conversion_rate", "low_cash",
                "high_debt", "low_profit", "late_payer", "missing_docs", "tax_noncompliant",
                "license_expired", "health_probability", "health_category"]
GROWTH_ADDED = ["revenue_growth_6m", "customer_growth_6m", "customer_retention_rate",
                "customer_activation_rate", "customer_acquisition_rate", "cash_runway_months",
                "debt_capacity", "reinvestment_capacity", "revenue_per_employee",
                "staff_stability", "customer_base_growth", "marketing_roi",
                "marketing_intensity", "conversion_rate", "has_funding_track",
                "funding_growth_boost", "revenue_velocity", "customer_velocity",
                "operational_leverage", "market_penetration_velocity", "marketing_efficiency",
                "marketing_growth_potential", "composite_growth_score",
                "predicted_6m_growth_rate", "predicted_6m_revenue", "current_revenue_category",
                "predicted_revenue_category", "growth_stage", "will_jump_category"]
