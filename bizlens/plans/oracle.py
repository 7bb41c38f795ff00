"""DuckDB SQL for the correctness oracle.

Each registered query has a SQL twin written independently of the Spark
plan (plain CTEs, ``COUNT(DISTINCT ...)``, window-free). The helpers below
produce SQL text for the same null rules as :mod:`bizlens.functions.exprs`.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from bizlens import schema as S
from bizlens.sources import profile as P

# ------------------------------------------------------------------ SQL helpers


def lit(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, str):
        return "'" + v.replace("'", "''") + "'"
    if isinstance(v, float):
        if math.isinf(v):
            return "CAST('inf' AS DOUBLE)" if v > 0 else "CAST('-inf' AS DOUBLE)"
        return f"CAST({v!r} AS DOUBLE)"
    return str(v)


def nz(d: str) -> str:
    return f"(CASE WHEN ({d}) = 0 THEN 1 ELSE ({d}) END)"


def ratio(n: str, d: str) -> str:
    return f"(({n}) / {nz(d)})"


def ratio_or_null(n: str, d: str) -> str:
    return f"(({n}) / NULLIF(({d}), 0))"


def clip(x: str, lo: float | None = None, hi: float | None = None) -> str:
    out = f"({x})"
    if lo is not None:
        out = f"greatest({out}, {lit(float(lo))})"
    if hi is not None:
        out = f"least({out}, {lit(float(hi))})"
    return f"(CASE WHEN ({x}) IS NULL THEN NULL ELSE {out} END)"


def clip01(x: str) -> str:
    return clip(x, 0.0, 1.0)


def row_min(a: str, b: str) -> str:
    return f"(CASE WHEN ({a}) IS NULL OR ({b}) IS NULL THEN NULL ELSE least({a}, {b}) END)"


def cut(x: str, edges: Sequence[float], labels: Sequence[str]) -> str:
    parts = [f"WHEN ({x}) > {lit(float(lo))} AND ({x}) <= {lit(float(hi))} THEN {lit(lab)}"
             for lo, hi, lab in zip(edges[:-1], edges[1:], labels)]
    return "(CASE " + " ".join(parts) + " END)"


def threshold_label(x: str, limits: Sequence[float], labels: Sequence[str]) -> str:
    parts = [f"WHEN ({x}) < {lit(float(v))} THEN {lit(lab)}" for v, lab in zip(limits, labels)]
    return "(CASE " + " ".join(parts) + f" ELSE {lit(labels[-1])} END)"


def flag(cond: str) -> str:
    return f"CAST(COALESCE(({cond}), false) AS INTEGER)"


def differs(a: str, b: str) -> str:
    return f"COALESCE(({a}) <> ({b}), true)"


def bround(x: str, n: int = 0) -> str:
    return f"round_even(({x}), {n})"


def clean(x: str) -> str:
    return (f"(CASE WHEN ({x}) IS NULL OR isnan(CAST(({x}) AS DOUBLE)) OR "
            f"abs(CAST(({x}) AS DOUBLE)) = CAST('inf' AS DOUBLE) THEN 0.0 "
            f"ELSE CAST(({x}) AS DOUBLE) END)")


def h(key: str, salt: str) -> str:
    return (f"(CAST('0x' || substr(md5(CAST({key} AS VARCHAR) || ':{salt}'), 1, 8) AS BIGINT)"
            f" / CAST(4294967296 AS DOUBLE))")


def noise(key: str, salt: str, mean: float = 0.0, sd: float = 1.0) -> str:
    u1 = f"({h(key, salt + ':a')} + {lit(0.5 / 4294967296.0)})"
    u2 = h(key, salt + ":b")
    return (f"({lit(float(mean))} + {lit(float(sd))} * sqrt(-2.0 * ln({u1})) * "
            f"cos({lit(2.0 * math.pi)} * {u2}))")


def pick(key: str, salt: str, values: Sequence[str]) -> str:
    arr = "[" + ", ".join(lit(v) for v in values) + "]"
    return f"({arr})[CAST(floor({h(key, salt)} * {len(values)}) AS BIGINT) + 1]"


# ------------------------------------------------------------------ profile


def profile_sql(start: str = P.PERIOD_START, months: int = P.PERIOD_MONTHS) -> str:
    cur_start, prev_start, cur_end = P._period_bounds(start, months)
    sql_types = {"LongType()": "BIGINT", "DoubleType()": "DOUBLE", "IntegerType()": "INTEGER",
                 "StringType()": "VARCHAR"}
    made = P.attributes(months)
    select = ",\n  ".join(f"CAST({made[f.name]} AS {sql_types[repr(f.dataType)]}) AS {f.name}"
                          for f in S.PROFILE_SCHEMA.fields)
    whole = ", ".join(f"CAST(COALESCE({c}, 0) AS BIGINT) AS {c}" for c in P.COUNTS)

    def units(x: str) -> str:
        return f"CAST(floor({x} * {P.NET_SCALE} + 0.5) AS BIGINT)"

    return f"""
WITH o AS (
  SELECT o_orderkey AS orderkey, o_custkey AS custkey,
         CASE WHEN o_orderdate >= TIMESTAMP '{cur_end:%Y-%m-%d}' THEN 0
              WHEN o_orderdate >= TIMESTAMP '{cur_start:%Y-%m-%d}' THEN 1
              WHEN o_orderdate >= TIMESTAMP '{prev_start:%Y-%m-%d}' THEN 2 ELSE 0 END AS period
  FROM orders),
li AS (
  SELECT l_orderkey AS orderkey, l_partkey, CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18,4)) AS net,
         {units('l_extendedprice * l_discount')} AS off, {units('l_extendedprice * l_tax')} AS tax,
         CAST(floor(l_discount * 100 + 0.5) AS BIGINT) AS off_pct, CAST(l_quantity AS BIGINT) AS pieces,
         l_returnflag, l_linestatus
  FROM lineitem),
st AS (
  SELECT custkey,
         SUM(net) FILTER (WHERE period = 1) * {P.NET_SCALE} AS net_cur,
         SUM(net) FILTER (WHERE period = 2) * {P.NET_SCALE} AS net_prev,
         SUM(off) FILTER (WHERE period = 1) AS off_cur, SUM(off) FILTER (WHERE period = 2) AS off_prev,
         SUM(tax) FILTER (WHERE period = 1) AS tax_cur, SUM(off_pct) AS off_pct, SUM(pieces) AS pieces,
         COUNT(*) AS n_lines,
         COUNT(*) FILTER (WHERE l_linestatus = 'F') AS n_f, COUNT(*) FILTER (WHERE l_linestatus = 'O') AS n_o,
         COUNT(*) FILTER (WHERE l_returnflag = 'R') AS n_r, COUNT(*) FILTER (WHERE l_returnflag = 'A') AS n_a,
         COUNT(*) FILTER (WHERE l_returnflag = 'N') AS n_n,
         COUNT(*) FILTER (WHERE pieces > {P.BIG_LINE}) AS n_big,
         COUNT(*) FILTER (WHERE pieces <= {P.SMALL_LINE}) AS n_small,
         COUNT(DISTINCT CASE WHEN period = 1 THEN l_partkey END) AS parts_cur,
         COUNT(DISTINCT CASE WHEN period = 2 THEN l_partkey END) AS parts_prev,
         COUNT(DISTINCT l_partkey) AS parts_all
  FROM li JOIN o USING (orderkey)
  GROUP BY custkey),
os AS (
  SELECT o_custkey AS custkey, COUNT(*) AS n_orders,
         {', '.join(f"COUNT(*) FILTER (WHERE o_orderstatus = '{x}') AS n_s{x.lower()}" for x in 'FOP')},
         {', '.join(f"COUNT(*) FILTER (WHERE o_orderpriority = '{p}') AS n_p{i}" for i, p in enumerate(P.PRIORITIES, 1))},
         SUM(CAST(floor(o_totalprice * 100 + 0.5) AS BIGINT)) AS cents,
         MAX(CAST(floor(o_totalprice * 100 + 0.5) AS BIGINT)) AS cents_max,
         MIN(CAST(floor(o_totalprice * 100 + 0.5) AS BIGINT)) AS cents_min,
         date_diff('month', MIN(o_orderdate), MAX(o_orderdate)) AS span
  FROM orders GROUP BY o_custkey),
tp AS (
  SELECT o_custkey AS custkey, o_orderpriority AS top_priority FROM orders GROUP BY o_custkey, o_orderpriority
  QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY COUNT(*) DESC, o_orderpriority) = 1),
e AS (
  SELECT user_id AS custkey, event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events
  WHERE event_type IN ('click', 'view', 'purchase')),
ev AS (
  SELECT custkey,
         COUNT(*) FILTER (WHERE event_type = 'click') AS n_click,
         COUNT(*) FILTER (WHERE event_type = 'view') AS n_view,
         COUNT(*) FILTER (WHERE event_type = 'purchase') AS n_purchase
  FROM e GROUP BY custkey),
tk AS (
  SELECT custkey, k AS top_k FROM e WHERE k IS NOT NULL GROUP BY custkey, k
  QUALIFY row_number() OVER (PARTITION BY custkey ORDER BY COUNT(*) DESC, k) = 1),
base AS (
  SELECT c.c_custkey AS custkey, c.c_name, c.c_acctbal, c.c_nationkey AS nationkey, n.n_regionkey AS regionkey,
         tp.top_priority, tk.top_k, {whole}
  FROM customer c
  LEFT JOIN nation n ON n.n_nationkey = c.c_nationkey
  LEFT JOIN st ON st.custkey = c.c_custkey
  LEFT JOIN os ON os.custkey = c.c_custkey
  LEFT JOIN tp ON tp.custkey = c.c_custkey
  LEFT JOIN ev ON ev.custkey = c.c_custkey
  LEFT JOIN tk ON tk.custkey = c.c_custkey)
SELECT
  {select}
FROM base"""


def monthly_series_sql(first: str, last: str, trailing: int = 6) -> str:
    return f"""
WITH m AS (
  SELECT o_custkey AS custkey, CAST(date_trunc('month', o_orderdate) AS DATE) AS month,
         SUM(CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18,4))) AS net
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL),
g AS (SELECT c_custkey AS custkey, CAST(unnest(generate_series(DATE '{first}-01' - INTERVAL {2 * trailing} MONTH,
             DATE '{last}-01', INTERVAL 1 MONTH)) AS DATE) AS month FROM customer),
f AS (SELECT g.custkey, g.month, COALESCE(net, 0) AS net FROM g LEFT JOIN m USING (custkey, month)),
s AS (SELECT a.custkey, a.month, any_value(a.net) AS net,
        SUM(b.net) FILTER (WHERE b.month > a.month - INTERVAL {trailing} MONTH) AS trail,
        SUM(b.net) FILTER (WHERE b.month <= a.month - INTERVAL {trailing} MONTH) AS before
      FROM f a JOIN f b ON b.custkey = a.custkey AND b.month <= a.month
        AND b.month > a.month - INTERVAL {2 * trailing} MONTH
      WHERE a.month >= DATE '{first}-01' GROUP BY a.custkey, a.month)
SELECT custkey AS sme_id, strftime(month, '%Y-%m') AS month, CAST(net * {P.NET_SCALE} AS DOUBLE) / {P.NET_SCALE} AS revenue,
       CAST(trail * {P.NET_SCALE} AS DOUBLE) / {P.NET_SCALE} AS trailing_revenue,
       CAST(before * {P.NET_SCALE} AS DOUBLE) / {P.NET_SCALE} AS previous_revenue,
       CASE WHEN before > 0 THEN CAST(trail * {P.NET_SCALE} AS DOUBLE) / CAST(before * {P.NET_SCALE} AS DOUBLE) - 1 END AS growth
FROM s"""


def with_profile(body: str, extra_ctes: Sequence[tuple[str, str]] = ()) -> str:
    """``WITH profile AS (...) [, name AS (...)]* body``."""
    ctes = [("profile", profile_sql())] + list(extra_ctes)
    return "WITH " + ",\n".join(f"{n} AS ({q})" for n, q in ctes) + "\n" + body


# ------------------------------------------------------------------ features


def _bands(name):
    from bizlens.operators import features as FT
    return getattr(FT, name)


def funding_sql(src: str, drop_nulls: bool = True) -> str:
    """FF1-FF19 over relation ``src``; returns a SELECT."""
    liquid = "(bank_balance + m_pesa_balance)"
    stage1 = ",\n    ".join([
        f"ln(1 + revenue) AS log_revenue",
        f"{ratio('revenue', 'employee_count')} AS profit_per_employee",
        f"{ratio('late_payments', 'age_of_business')} AS late_payment_rate",
        f"{ratio_or_null('debt_ratio', 'profit_margin')} AS debt_profit_ratio",
        f"{ratio('revenue', 'marketing_spend')} AS marketing_efficiency",
        f"{ratio('funding_requested_amount', 'revenue')} AS funding_request_ratio",
        f"{ratio('repeat_customers', 'active_customers')} AS customer_retention_rate",
        f"{ratio('paid_invoices', 'paid_invoices + pending_invoices')} AS invoice_completion_rate",
        f"{ratio(liquid, 'revenue')} AS liquidity_ratio",
        f"{ratio('total_payroll', 'revenue')} AS payroll_to_revenue",
        f"{ratio('conversions', 'clicks')} AS marketing_conversion_rate",
    ])
    bands = [("profitability", "profit_margin", "PROFITABILITY"),
             ("financial_health", "debt_profit_ratio", "FINANCIAL_HEALTH"),
             ("payment_behavior", "late_payment_rate", "PAYMENT_BEHAVIOR"),
             ("operational_efficiency", "profit_per_employee", "OPERATIONAL_EFFICIENCY"),
             ("marketing_roi", "marketing_efficiency", "MARKETING_ROI_BANDS"),
             ("business_maturity", "age_of_business", "BUSINESS_MATURITY"),
             ("customer_base_size", "total_customers", "CUSTOMER_BASE_SIZE"),
             ("funding_size_category", "funding_requested_amount", "FUNDING_SIZE")]
    stage2 = ",\n    ".join(f"{cut(x, *_bands(b))} AS {n}" for n, x, b in bands)
    q = f"(SELECT *, {stage2} FROM (SELECT *, {stage1} FROM {src}))"
    if not drop_nulls:
        return f"SELECT * FROM {q}"
    return f"SELECT * FROM {q} AS t WHERE COLUMNS(*) IS NOT NULL"


def health_ratio_cols() -> list[tuple[str, str]]:
    return [
        ("cash_months", "liquidity_ratio * 12"),
        ("revenue_per_employee", ratio("revenue", "employee_count")),
        ("payroll_to_revenue", ratio("total_payroll", "revenue")),
        ("invoice_paid_rate", ratio("paid_invoices", "paid_invoices + pending_invoices")),
        ("staff_retention_rate", "1 - staff_turnover_rate"),
        ("customer_active_rate", ratio("active_customers", "total_customers")),
        ("customer_repeat_rate", ratio("repeat_customers", "active_customers")),
        ("marketing_roi", ratio("revenue", "marketing_spend")),
        ("conversion_rate", ratio("conversions", "clicks")),
    ]


def risk_flag_cols() -> list[tuple[str, str]]:
    return [
        ("low_cash", flag("cash_months < 2")),
        ("high_debt", flag("debt_ratio > 0.6")),
        ("low_profit", flag("profit_margin < 0.05")),
        ("late_payer", flag("late_payments > age_of_business")),
        ("missing_docs", flag("business_registration_uploaded = 0 OR tax_clearance_uploaded = 0 "
                              "OR financial_statements_uploaded = 0")),
        ("tax_noncompliant", flag("tax_registered = 0 OR tax_paid_last_year = 0")),
        ("license_expired", flag("licenses_up_to_date = 0")),
    ]


def _sel(cols: list[tuple[str, str]]) -> str:
    return ",\n    ".join(f"{e} AS {n}" for n, e in cols)


def health_sql(src: str, noise_on: bool = False, key: str = "sme_id") -> str:
    from bizlens.operators import features as FT
    d = lit
    base = clip01(
        f"(profit_margin / {d(0.30)}) * {d(0.20)}"
        f" + (cash_months / 12) * {d(0.20)}"
        f" + ((1 - debt_ratio) / {d(1.0)}) * {d(0.15)}"
        f" + invoice_paid_rate * {d(0.10)}"
        f" + customer_repeat_rate * {d(0.10)}"
        f" + {clip01(f'revenue / 500000')} * {d(0.10)}"
        f" + (1 - missing_docs) * {d(0.08)}"
        f" + (1 - tax_noncompliant) * {d(0.07)}")
    prob = "base_health"
    if noise_on:
        prob = f"base_health + {noise(key, 'health', 0.0, FT.HEALTH_NOISE_SD)}"
    liquid = "(bank_balance + m_pesa_balance)"
    s1 = f"SELECT *, {ratio(liquid, 'revenue')} AS liquidity_ratio FROM {src}"
    s2 = f"SELECT *, {_sel(health_ratio_cols())} FROM ({s1})"
    s3 = f"SELECT *, {_sel(risk_flag_cols())} FROM ({s2})"
    s4 = f"SELECT *, {base} AS base_health FROM ({s3})"
    s5 = f"SELECT * EXCLUDE (base_health), {clip01(prob)} AS health_probability FROM ({s4})"
    cat = threshold_label("health_probability", FT.HEALTH_LIMITS, S.HEALTH_CATEGORIES)
    return f"SELECT *, {cat} AS health_category FROM ({s5})"


def growth_sql(src: str, noise_on: bool = False, key: str = "sme_id") -> str:
    from bizlens.operators import features as FT
    d = lit
    delta = "(total_customers - customers_6m_ago)"
    liquid = "(bank_balance + m_pesa_balance)"
    g1 = [
        ("revenue_growth_6m", ratio("revenue - revenue_6m_ago", "revenue_6m_ago")),
        ("customer_growth_6m", ratio(delta, "customers_6m_ago")),
        ("customer_retention_rate", ratio("repeat_customers", "active_customers")),
        ("customer_activation_rate", ratio("active_customers", "total_customers")),
        ("customer_acquisition_rate", f"{delta} / 6"),
        ("cash_runway_months", ratio(liquid, "revenue / 12")),
        ("debt_capacity", clip01("1 - debt_ratio")),
        ("reinvestment_capacity", "profit_margin * revenue"),
        ("revenue_per_employee", ratio("revenue", "employee_count")),
        ("staff_stability", "1 - staff_turnover_rate"),
        ("customer_base_growth", ratio(delta, "customers_6m_ago")),
        ("marketing_roi", ratio("revenue", "marketing_spend")),
        ("marketing_intensity", ratio("marketing_spend", "revenue")),
        ("conversion_rate", ratio("conversions", "clicks")),
        ("has_funding_track", "CAST(previous_funding_received AS INTEGER)"),
        ("funding_growth_boost", f"CASE WHEN previous_funding_received = 1 THEN "
                                 f"{clip01(ratio('previous_funding_amount', 'revenue'))} ELSE 0.0 END"),
    ]
    g2 = [
        ("revenue_velocity", "revenue_growth_6m / 6"),
        ("customer_velocity", "customer_growth_6m / 6"),
        ("operational_leverage", clip("revenue_per_employee / 50000", 0, 5)),
        ("market_penetration_velocity", "customer_base_growth / 6"),
        ("marketing_efficiency", clip01("ln(1 + marketing_roi) / 10")),
        ("marketing_growth_potential", clip01("marketing_roi * marketing_intensity")),
    ]
    score = bround(clip(
        "(revenue_velocity * 6) * 20"
        " + (customer_velocity * 6) * 15"
        f" + {clip01('cash_runway_months / 6')} * 15"
        " + debt_capacity * 15"
        f" + {clip01('operational_leverage / 2')} * 15"
        " + marketing_efficiency * 20", 0, 100), 1)
    q = f"SELECT *, {_sel(g1)} FROM {src}"
    q = f"SELECT *, {_sel(g2)} FROM ({q})"
    q = f"SELECT *, {score} AS composite_growth_score FROM ({q})"
    return growth_targets_sql(f"({q})", noise_on, key)


def growth_targets_sql(src: str, noise_on: bool = False, key: str = "sme_id") -> str:
    from bizlens.operators import features as FT
    d = lit
    market = noise(key, "market", 0.0, FT.MARKET_NOISE_SD) if noise_on else d(0.0)
    boost = (f"(CASE WHEN profit_margin > {d(0.10)} AND debt_ratio < {d(0.4)} THEN {d(0.05)} "
             f"WHEN profit_margin < 0 THEN {d(-0.10)} ELSE {d(0.0)} END)")
    parts = []
    for below, mean, sd in FT.STAGE_FACTOR:
        val = noise(key, f"stage{below}", mean, sd) if noise_on else d(float(mean))
        parts.append(f"ELSE {val}" if below is None else f"WHEN age_of_business < {below} THEN {val}")
    stage = "(CASE " + " ".join(parts) + " END)"
    raw = f"({clip('revenue_growth_6m', -0.30, 0.50)} * {d(0.40)} + {boost} + {stage} + {market})"
    rate = bround(clip(f"{raw} * {d(0.70)} + {d(FT.MEAN_GROWTH * 0.30)}", -0.30, 0.40), 3)
    q = f"SELECT *, {rate} AS predicted_6m_growth_rate FROM {src}"
    q = f"SELECT *, revenue * (1 + predicted_6m_growth_rate) AS predicted_6m_revenue FROM ({q})"
    q = (f"SELECT *, {cut('revenue', *FT.REVENUE_SIZE)} AS current_revenue_category, "
         f"{cut('predicted_6m_revenue', *FT.REVENUE_SIZE)} AS predicted_revenue_category, "
         f"{cut('predicted_6m_growth_rate', *FT.GROWTH_STAGE_BINS)} AS growth_stage FROM ({q})")
    jump = flag(differs("predicted_revenue_category", "current_revenue_category"))
    return f"SELECT *, {jump} AS will_jump_category FROM ({q})"


def rounded(sql: str, cols: Sequence[str], digits: int = 9) -> str:
    """Round columns computed with log/exp/cos, whose last bit differs by engine."""
    rep = ", ".join(f"round_even({c}, {digits}) AS {c}" for c in cols)
    return f"SELECT * REPLACE ({rep}) FROM ({sql})"


# ------------------------------------------------------------------ rules, labels, decisions


def repaired_sql(src: str) -> str:
    """C1-C6 over ``src``."""
    rep = ", ".join([
        "CASE WHEN previous_funding_received = 1 THEN previous_funding_amount ELSE 0.0 END "
        "AS previous_funding_amount",
        "CASE WHEN previous_funding_received = 1 THEN default_history ELSE 0 END AS default_history",
        "CASE WHEN collateral_offered = 1 THEN collateral_value ELSE 0.0 END AS collateral_value",
        "CASE WHEN staff_count > 0 THEN total_payroll ELSE 0.0 END AS total_payroll",
        "CASE WHEN campaign_spend = 0 THEN 0 ELSE clicks END AS clicks",
        "CASE WHEN campaign_spend = 0 THEN 0 ELSE impressions END AS impressions",
        "CASE WHEN campaign_spend = 0 THEN 0 ELSE conversions END AS conversions",
        f"{row_min('active_customers', 'total_customers')} AS active_customers",
    ])
    q = f"SELECT * REPLACE ({rep}) FROM {src}"
    q = (f"SELECT * REPLACE ({row_min('repeat_customers', 'active_customers')} AS repeat_customers)"
         f" FROM ({q})")
    late = (f"CAST(CASE WHEN age_of_business > 0 THEN "
            f"{row_min('late_payments', 'age_of_business * 12')} ELSE 0 END AS BIGINT)")
    return f"SELECT * REPLACE ({late} AS late_payments) FROM ({q})"


RULES_SQL = [
    ("C1_funding", "COALESCE(previous_funding_received <> 1, true) AND "
                   "(previous_funding_amount <> 0 OR default_history <> 0)"),
    ("C2_collateral", "COALESCE(collateral_offered <> 1, true) AND collateral_value <> 0"),
    ("C3_payroll", "COALESCE(NOT (staff_count > 0), true) AND total_payroll <> 0"),
    ("C4_campaign", "campaign_spend = 0 AND (clicks <> 0 OR impressions <> 0 OR conversions <> 0)"),
    ("C5_nesting", "active_customers > total_customers OR "
                   "repeat_customers > least(active_customers, total_customers)"),
    ("C6_late_payments", "CASE WHEN age_of_business > 0 THEN late_payments > age_of_business * 12 "
                         "ELSE late_payments <> 0 END"),
]


def rule_report_sql(src: str) -> str:
    parts = " UNION ALL ".join(
        f"SELECT '{n}' AS rule, COUNT(*) FILTER (WHERE COALESCE({p}, false)) AS rows_breaking, "
        f"COUNT(*) AS rows_total FROM {src}" for n, p in RULES_SQL)
    return parts


def targets_sql(src: str, noise_on: bool = False, key: str = "sme_id",
                keep_scores: bool = False) -> str:
    from bizlens.operators import labels as LB
    d = lit
    elig = (f"{flag('revenue > 100000')} * {d(0.3)} + {flag(f'profit_margin > {d(0.12)}')} * {d(0.2)}"
            f" + {flag(f'debt_ratio < {d(0.45)}')} * {d(0.2)} + {flag('default_history = 0')} * {d(0.2)}"
            f" + {flag('tax_registered = 1')} * {d(0.1)}")
    if noise_on:
        elig += f" + {noise(key, 'eligibility', 0.0, LB.ELIGIBILITY_NOISE_SD)}"
    risk = f"debt_ratio * {d(0.4)} + default_history * {d(0.4)} + (1 - profit_margin) * {d(0.2)}"
    if noise_on:
        risk += f" + {noise(key, 'risk', 0.0, LB.RISK_NOISE_SD)}"
    risk = (f"(CASE WHEN ({risk}) IS NULL OR isnan({risk}) THEN {d(0.5)} "
            f"WHEN ({risk}) = CAST('inf' AS DOUBLE) THEN {d(1.0)} "
            f"WHEN ({risk}) = CAST('-inf' AS DOUBLE) THEN {d(0.0)} ELSE ({risk}) END)")
    health = (f"profit_margin * 40 + (1 - debt_ratio) * 30 + ln(1 + revenue) / "
              f"{d(math.log1p(LB.HEALTH_SCORE_REVENUE_REF))} * 30")
    if noise_on:
        health += f" + {noise(key, 'health_score', 0.0, LB.HEALTH_SCORE_NOISE_SD)}"
    q = (f"SELECT *, {flag(f'({elig}) > {d(LB.ELIGIBILITY_LIMIT)}')} AS eligible_for_funding, "
         f"{clip01(risk)} AS default_risk_score, "
         f"{bround(clip(health, 0, 100), 1)} AS business_health_score FROM {src}")
    q = (f"SELECT * EXCLUDE (business_health_score), "
         f"{cut('default_risk_score', [float(x) for x in LB.RISK_BINS], S.RISK_LEVELS)} AS default_risk, "
         f"business_health_score FROM ({q})")
    return q if keep_scores else f"SELECT * EXCLUDE (default_risk_score) FROM ({q})"


def growth_action_sql(r: str) -> str:
    from bizlens.operators import decisions as D
    parts = " ".join(f"WHEN ({r}) >= {lit(float(v))} THEN {lit(n)}" for v, n in D.GROWTH_ACTIONS)
    return f"(CASE {parts} ELSE {lit(D.GROWTH_ACTION_ELSE)} END)"


def health_decisions_sql(src: str) -> str:
    total = " + ".join(f"COALESCE({n}, 0)" for n in S.RISK_FLAG_COLS)
    return (f"SELECT sme_id, health_category, {', '.join(S.RISK_FLAG_COLS)}, "
            f"{total} AS total_risk_flags FROM {src}")


def growth_decisions_sql(src: str) -> str:
    r = "predicted_6m_growth_rate"
    return (f"SELECT sme_id, revenue AS current_revenue, {bround(f'{r} * 100', 1)} AS {r}, "
            f"{bround(f'revenue * (1 + {r})', 0)} AS predicted_6m_revenue, growth_stage, "
            f"will_jump_category, current_revenue_category, composite_growth_score, "
            f"{growth_action_sql(r)} AS growth_action FROM {src}")


def compliance_decisions_sql(src: str, p: str = "default_risk_score") -> str:
    from bizlens.operators import decisions as D
    ok = "COALESCE(CAST(eligible_for_funding AS BOOLEAN), false)"
    found = (f"concat_ws('|', CASE WHEN {p} >= {lit(D.HIGH_DEFAULT_RISK_P)} THEN '{D.REASON_DEFAULT}' END, "
             f"CASE WHEN business_health_score < {D.POOR_HEALTH_SCORE} THEN '{D.REASON_HEALTH}' END)")
    reasons = (f"CASE WHEN NOT {ok} THEN '{D.REASON_POLICY}' WHEN {found} = '' THEN '{D.REASON_OK}' "
               f"ELSE {found} END")
    level = (f"CASE WHEN NOT {ok} THEN 'HIGH' WHEN {found} = '' THEN 'LOW' "
             f"WHEN {p} >= {lit(D.HIGH_DEFAULT_RISK_P)} THEN 'HIGH' ELSE 'MEDIUM' END")
    return (f"SELECT sme_id, eligible_for_funding, {bround(p, 3)} AS default_risk_probability, "
            f"{bround('business_health_score', 1)} AS business_health_score, "
            f"{level} AS compliance_risk, {reasons} AS reasons FROM {src}")


def suffix_join_sql(left: str, right: str, left_cols: Sequence[str], right_cols: Sequence[str],
                    key: str = "sme_id", suffix: str = "_growth") -> str:
    clash = set(left_cols) & set(right_cols)
    rsel = ", ".join(f"r.{c} AS {c + suffix if c in clash else c}" for c in right_cols if c != key)
    lsel = ", ".join(f"l.{c}" for c in left_cols)
    return f"SELECT {lsel}, {rsel} FROM {left} l JOIN {right} r ON l.{key} = r.{key}"


# ------------------------------------------------------------------ encoding and metrics


def split_hash_sql(key: str = "sme_id", seed: int = 42) -> str:
    return (f"(CAST('0x' || substr(md5(CAST({key} AS VARCHAR) || ':split:{seed}'), 1, 13) AS BIGINT)"
            f" / CAST({2 ** 52} AS DOUBLE))")


def encode_sql(src: str, spec: dict, vocab: dict, ordinal_order: dict, digits: int = 9,
               keep: Sequence[str] = ("sme_id",), fit_src: str | None = None) -> str:
    """M1-M4 with statistics computed over ``fit_src`` (default: ``src`` itself, all rows)."""
    cols = list(keep)
    fit_src = fit_src or src
    for c in spec["ordinal"]:
        ladder = " ".join(f"WHEN CAST({c} AS VARCHAR) = {lit(v)} THEN {lit(float(i))}"
                          for i, v in enumerate(ordinal_order[c]))
        cols.append(f"round_even({clean(f'CASE {ladder} ELSE -1.0 END')}, {digits}) AS ord__{c}")
    for c in spec["onehot"]:
        for v in vocab[c][1:]:
            cols.append(f"round_even({clean(f'COALESCE(CAST(CAST({c} AS VARCHAR) = {lit(v)} AS DOUBLE), 0.0)')}"
                        f", {digits}) AS \"oh__{c}__{v}\"")
    for c in spec["numeric"]:
        m = f"(SELECT avg(CAST({c} AS DOUBLE)) FROM {fit_src})"
        s = (f"(SELECT CASE WHEN stddev_pop(CAST({c} AS DOUBLE)) = 0 THEN 1.0 "
             f"ELSE stddev_pop(CAST({c} AS DOUBLE)) END FROM {fit_src})")
        cols.append(f"round_even(({clean(c)} - {m}) / {s}, {digits}) AS num__{c}")
    for c in spec["binary"]:
        cols.append(f"round_even({clean(f'CAST({c} AS DOUBLE)')}, {digits}) AS bin__{c}")
    return f"SELECT {', '.join(cols)} FROM {src}"


def stratified_split_sql(src: str, label: str, test_frac: float, key: str = "sme_id",
                         seed: int = 42) -> str:
    u = split_hash_sql(key, seed)
    return f"""SELECT {key}, {label}, rn <= floor({lit(float(test_frac))} * n + 0.5) AS is_test FROM (
  SELECT {key}, {label}, row_number() OVER (PARTITION BY {label} ORDER BY {u}) AS rn,
         COUNT(*) OVER (PARTITION BY {label}) AS n
  FROM {src} WHERE {label} IS NOT NULL)"""


def classification_report_sql(src: str, y: str, p: str) -> str:
    return f"""SELECT * FROM (WITH cm AS (SELECT CAST({y} AS VARCHAR) AS y, CAST({p} AS VARCHAR) AS p, COUNT(*) AS cnt
              FROM {src} GROUP BY ALL),
cls AS (SELECT y AS cls FROM cm WHERE y IS NOT NULL UNION SELECT p FROM cm WHERE p IS NOT NULL),
per AS (
  SELECT cls.cls,
         COALESCE((SELECT SUM(cnt) FROM cm WHERE cm.y = cls.cls AND cm.p = cls.cls), 0) AS tp,
         COALESCE((SELECT SUM(cnt) FROM cm WHERE cm.y = cls.cls), 0) AS support,
         COALESCE((SELECT SUM(cnt) FROM cm WHERE cm.p = cls.cls), 0) AS predicted
  FROM cls),
pr AS (SELECT cls, tp, support,
              CASE WHEN predicted = 0 THEN 0.0 ELSE tp / predicted END AS precision,
              CASE WHEN support = 0 THEN 0.0 ELSE tp / support END AS recall FROM per),
f AS (SELECT *, CASE WHEN precision + recall = 0 THEN 0.0
                     ELSE 2 * precision * recall / (precision + recall) END AS f1 FROM pr),
t AS (SELECT SUM(support) AS n, SUM(tp) AS tp, avg(precision) AS mp, avg(recall) AS mr,
             avg(f1) AS mf, SUM(precision * support) / SUM(support) AS wp,
             SUM(recall * support) / SUM(support) AS wr, SUM(f1 * support) / SUM(support) AS wf
      FROM f)
SELECT cls, round_even(precision, 9) AS precision, round_even(recall, 9) AS recall,
       round_even(f1, 9) AS f1, CAST(support AS BIGINT) AS support, 'class' AS kind FROM f
UNION ALL SELECT 'accuracy', NULL, NULL, round_even(tp / n, 9), CAST(n AS BIGINT), 'accuracy' FROM t
UNION ALL SELECT 'macro avg', round_even(mp, 9), round_even(mr, 9), round_even(mf, 9), CAST(n AS BIGINT), 'macro avg' FROM t
UNION ALL SELECT 'weighted avg', round_even(wp, 9), round_even(wr, 9), round_even(wf, 9), CAST(n AS BIGINT), 'weighted avg' FROM t)"""


# ------------------------------------------------------------------ requests


def request_parse_sql(src: str, src_cols: Sequence[str]) -> str:
    """The typed request rows a JSON round trip of ``src`` gives."""
    from bizlens.sources import requests as RQ
    types = {"DoubleType()": "DOUBLE", "IntegerType()": "INTEGER", "StringType()": "VARCHAR"}
    cols = []
    for n, t, d in RQ.REQUEST_FIELDS:
        st = types[repr(t)]
        if n in src_cols:
            e = f"CAST({n} AS {st})"
            cols.append(f"COALESCE({e}, CAST({lit(d)} AS {st})) AS {n}" if d is not None else f"{e} AS {n}")
        else:
            cols.append(f"CAST({lit(d)} AS {st}) AS {n}")
    checks = ", ".join(
        f"CASE WHEN NOT ({n} IN ({', '.join(lit(v) for v in vals)})) THEN '{n} not in {'/'.join(vals)}' END"
        for n, vals in RQ.REQUEST_VOCAB.items())
    q = f"SELECT {', '.join(cols)} FROM {src}"
    return f"SELECT *, NULLIF(concat_ws('; ', {checks}), '') AS reject_reason FROM ({q})"
