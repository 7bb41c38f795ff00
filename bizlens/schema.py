"""Schemas, vocabularies and feature lists of the SME scoring tables.

The SME table has one row per business, key ``sme_id``. Its columns, their
order and the category vocabularies are a fixed contract: models trained on
one table must see the same names and categories at scoring time.
"""

from __future__ import annotations

from pyspark.sql import types as T

# ----------------------------------------------------------------------------
# Category vocabularies, in the order the contract lists them.
# ----------------------------------------------------------------------------
SECTORS = ["agriculture", "retail", "tech", "manufacturing", "beauty", "transport", "services"]
BUSINESS_STAGES = ["startup", "growth", "mature"]
CHANNELS = ["physical", "online", "mobile"]
TARGET_SEGMENTS = ["low", "medium", "high"]
OWNER_GENDERS = ["male", "female"]
EDUCATION_LEVELS = ["none", "highschool", "bachelor", "master", "phd"]
EMPLOYMENT_STATUSES = ["self-employed", "employed"]
LOCATIONS = ["Nairobi", "Mombasa", "Kisumu", "Eldoret", "Other"]

# Label vocabularies of derived columns.
HEALTH_CATEGORIES = ["Critical", "At Risk", "Stable", "Thriving"]
GROWTH_STAGES = ["Declining", "Stable", "Growing", "Rapid Growth"]
RISK_LEVELS = ["low", "medium", "high"]
SIZE_CATEGORIES = ["Small", "Medium", "Large"]
RISK_FLAG_COLS = ["low_cash", "high_debt", "low_profit",
                  "missing_docs", "tax_noncompliant", "license_expired"]

CATEGORICAL_VOCAB = {
    "sector": SECTORS,
    "business_stage": BUSINESS_STAGES,
    "channels_used": CHANNELS,
    "target_segment": TARGET_SEGMENTS,
    "owner_gender": OWNER_GENDERS,
    "education_level": EDUCATION_LEVELS,
    "employment_status": EMPLOYMENT_STATUSES,
    "location": LOCATIONS,
}

_D, _L, _I, _S = T.DoubleType(), T.LongType(), T.IntegerType(), T.StringType()

# Base SME table, in contract order (targets separate).
SME_COLUMNS: list[tuple[str, T.DataType]] = [
    ("sme_id", _L), ("business_name", _S),
    ("revenue", _D), ("profit_margin", _D), ("debt_ratio", _D), ("collateral_value", _D),
    ("marketing_spend", _D),
    ("employee_count", _L), ("staff_count", _L), ("age_of_business", _L), ("sector", _S),
    ("previous_funding_received", _I), ("previous_funding_amount", _D), ("default_history", _I),
    ("loan_applications_count", _L),
    ("funding_requested_amount", _D), ("expected_roi", _D), ("project_duration_months", _L),
    ("business_stage", _S), ("collateral_offered", _I),
    ("business_registration_uploaded", _I), ("tax_clearance_uploaded", _I),
    ("financial_statements_uploaded", _I),
    ("tax_registered", _I), ("tax_paid_last_year", _I), ("licenses_required", _L),
    ("licenses_up_to_date", _I),
    ("total_payroll", _D), ("cost_per_hire", _D), ("nssf_contribution_percent", _D),
    ("nhif_contribution_percent", _D), ("staff_turnover_rate", _D),
    ("bank_balance", _D), ("m_pesa_balance", _D), ("pending_invoices", _L), ("paid_invoices", _L),
    ("late_payments", _L),
    ("campaign_spend", _D), ("clicks", _L), ("impressions", _L), ("conversions", _L),
    ("target_segment", _S),
    ("total_customers", _L), ("active_customers", _L), ("repeat_customers", _L),
    ("channels_used", _S),
    ("owner_age", _L), ("owner_gender", _S), ("education_level", _S), ("employment_status", _S),
    ("location", _S),
]
# History columns the profile derives from the previous period.
HISTORY_COLUMNS: list[tuple[str, T.DataType]] = [
    ("revenue_6m_ago", _D), ("customers_6m_ago", _L), ("marketing_spend_6m_ago", _D),
]
# Targets.
TARGET_COLUMNS: list[tuple[str, T.DataType]] = [
    ("eligible_for_funding", _I), ("default_risk", _S), ("business_health_score", _D),
]

SME_SCHEMA = T.StructType([T.StructField(n, t, True) for n, t in SME_COLUMNS])
PROFILE_SCHEMA = T.StructType([T.StructField(n, t, True) for n, t in SME_COLUMNS + HISTORY_COLUMNS])
SME_TABLE_SCHEMA = T.StructType(
    [T.StructField(n, t, True) for n, t in SME_COLUMNS + HISTORY_COLUMNS + TARGET_COLUMNS])

# ----------------------------------------------------------------------------
# Model feature blocks (ordinal -> one-hot -> numeric -> binary).
# ----------------------------------------------------------------------------
ORDINAL_FEATURES = ["business_stage", "education_level"]
ORDINAL_ORDER = {"business_stage": BUSINESS_STAGES, "education_level": EDUCATION_LEVELS}

FUNDING_FEATURES = {
    "ordinal": ORDINAL_FEATURES,
    "onehot": ["sector", "channels_used", "target_segment", "owner_gender",
               "employment_status", "location"],
    "numeric": ["revenue", "profit_margin", "debt_ratio", "collateral_value",
                "marketing_spend", "employee_count", "age_of_business",
                "previous_funding_amount", "loan_applications_count",
                "funding_requested_amount", "expected_roi", "project_duration_months",
                "staff_count", "total_payroll", "cost_per_hire",
                "staff_turnover_rate", "bank_balance", "m_pesa_balance",
                "pending_invoices", "paid_invoices", "total_customers",
                "active_customers", "repeat_customers", "campaign_spend",
                "clicks", "impressions", "conversions", "owner_age"],
    "binary": ["previous_funding_received", "collateral_offered",
               "business_registration_uploaded", "tax_clearance_uploaded",
               "financial_statements_uploaded", "tax_registered",
               "tax_paid_last_year", "licenses_up_to_date"],
}

HEALTH_FEATURES = {
    "ordinal": ORDINAL_FEATURES,
    "onehot": ["sector", "channels_used", "owner_gender", "location"],
    "numeric": ["revenue", "profit_margin", "debt_ratio", "collateral_value",
                "marketing_spend", "employee_count", "age_of_business",
                "bank_balance", "m_pesa_balance",
                "total_payroll", "staff_turnover_rate",
                "pending_invoices", "paid_invoices", "late_payments",
                "total_customers", "active_customers", "repeat_customers",
                "clicks", "conversions",
                "liquidity_ratio", "cash_months",
                "revenue_per_employee", "payroll_to_revenue",
                "invoice_paid_rate", "staff_retention_rate",
                "customer_active_rate", "customer_repeat_rate",
                "marketing_roi", "conversion_rate"],
    "binary": ["previous_funding_received", "default_history",
               "business_registration_uploaded", "tax_clearance_uploaded",
               "financial_statements_uploaded", "tax_registered",
               "tax_paid_last_year", "licenses_up_to_date",
               "low_cash", "high_debt", "low_profit",
               "missing_docs", "tax_noncompliant", "license_expired"],
}

GROWTH_FEATURES = {
    "ordinal": ORDINAL_FEATURES,
    "onehot": ["sector", "channels_used", "target_segment", "owner_gender",
               "employment_status", "location", "current_revenue_category"],
    "numeric": ["revenue", "profit_margin", "debt_ratio", "collateral_value",
                "marketing_spend", "employee_count", "age_of_business",
                "previous_funding_amount", "loan_applications_count",
                "funding_requested_amount", "expected_roi", "project_duration_months",
                "staff_count", "total_payroll", "cost_per_hire",
                "staff_turnover_rate", "bank_balance", "m_pesa_balance",
                "pending_invoices", "paid_invoices", "total_customers",
                "active_customers", "repeat_customers", "campaign_spend",
                "clicks", "impressions", "conversions", "owner_age",
                "late_payments",
                "revenue_6m_ago", "customers_6m_ago", "marketing_spend_6m_ago",
                "revenue_growth_6m", "revenue_velocity",
                "customer_growth_6m", "customer_velocity",
                "customer_retention_rate", "customer_activation_rate",
                "customer_acquisition_rate",
                "cash_runway_months", "debt_capacity", "reinvestment_capacity",
                "revenue_per_employee", "operational_leverage", "staff_stability",
                "customer_base_growth", "market_penetration_velocity",
                "marketing_roi", "marketing_efficiency", "marketing_intensity",
                "conversion_rate", "marketing_growth_potential",
                "funding_growth_boost", "composite_growth_score"],
    # will_jump_category is the jump model's own target: left out by default
    "binary": ["previous_funding_received", "collateral_offered", "default_history",
               "business_registration_uploaded", "tax_clearance_uploaded",
               "financial_statements_uploaded", "tax_registered",
               "tax_paid_last_year", "licenses_up_to_date",
               "has_funding_track"],
}


# What a bundle's features take for a column that a table or request
# lacks, and for a null (None: the first value of the ordinal's order, as in funding,
# whose encoder knows no other values).
SERVING_DEFAULTS = {
    "growth": {"absent": {"ordinal": "startup", "onehot": "unknown"},
               "null": {"ordinal": "startup", "onehot": "unknown"}},
    "health": {"absent": {"ordinal": None, "onehot": "missing"},
               "null": {"ordinal": "startup", "onehot": "missing"}},
    "funding": {"absent": {"ordinal": None, "onehot": "0"},
                "null": {"ordinal": None, "onehot": "unknown"}},
}
