"""Policy decisions on score columns (D1-D4), the J1 suffix join and J3 structs.

Row-wise rules are expressions, not loops or UDFs: each decision is a
``CASE`` chain, the reasons list is an array filtered of nulls.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bizlens import schema as S
from bizlens.functions.exprs import bround, col, nan_to_null

# Decision limits and names.
GROWTH_ACTIONS = [(0.25, "fast_track_funding"), (0.10, "growth_support"),
                  (0.0, "stability_support")]
GROWTH_ACTION_ELSE = "intervention_required"
HIGH_DEFAULT_RISK_P = 0.6
POOR_HEALTH_SCORE = 50
REASON_POLICY = "FUNDING_POLICY_VIOLATION"
REASON_DEFAULT = "HIGH_DEFAULT_RISK"
REASON_HEALTH = "POOR_BUSINESS_HEALTH"
REASON_OK = "ALL_OK"


def growth_action(rate) -> Column:
    """Action for a predicted six-month growth rate (fraction); null and NaN need intervention."""
    r = nan_to_null(col(rate).cast("double"))
    out = None
    for limit, name in GROWTH_ACTIONS:
        out = F.when(r >= limit, F.lit(name)) if out is None else out.when(r >= limit, F.lit(name))
    return out.otherwise(F.lit(GROWTH_ACTION_ELSE))


def compliance(p_default, eligible, health) -> tuple[Column, Column]:
    """(risk level, reasons array)."""
    p, h = nan_to_null(col(p_default).cast("double")), nan_to_null(col(health).cast("double"))
    e = col(eligible)
    is_eligible = F.coalesce(e.cast("boolean"), F.lit(False))
    found = F.filter(F.array(F.when(p >= HIGH_DEFAULT_RISK_P, F.lit(REASON_DEFAULT)),
                             F.when(h < POOR_HEALTH_SCORE, F.lit(REASON_HEALTH))),
                     lambda x: x.isNotNull())
    reasons = (F.when(~is_eligible, F.array(F.lit(REASON_POLICY)))
               .when(F.size(found) == 0, F.array(F.lit(REASON_OK)))
               .otherwise(found))
    level = (F.when(~is_eligible, F.lit("HIGH"))
             .when(F.size(found) == 0, F.lit("LOW"))
             .when(F.array_contains(found, REASON_DEFAULT), F.lit("HIGH"))
             .otherwise(F.lit("MEDIUM")))
    return level, reasons


def total_risk_flags() -> Column:
    """Sum of the six risk flags, a missing flag counting 0."""
    total = F.lit(0)
    for n in S.RISK_FLAG_COLS:
        total = total + F.coalesce(F.col(n), F.lit(0))
    return total


def risk_flag_struct() -> Column:
    """D3: the six flags and their total as one struct."""
    return F.struct(*[F.coalesce(F.col(n), F.lit(0)).alias(n) for n in S.RISK_FLAG_COLS],
                    total_risk_flags().alias("total"))


def health_decisions(df: DataFrame, category: str = "health_category") -> DataFrame:
    """Health decision table (P12, D3 flat)."""
    return df.select("sme_id", F.col(category).alias("health_category"),
                     *[F.col(n) for n in S.RISK_FLAG_COLS],
                     total_risk_flags().alias("total_risk_flags"))


def growth_decisions(df: DataFrame, rate: str = "predicted_6m_growth_rate",
                     jump: str = "will_jump_category", stage: str = "growth_stage") -> DataFrame:
    """Growth result columns with the D1 action."""
    r = F.col(rate)
    return df.select(
        "sme_id",
        F.col("revenue").alias("current_revenue"),
        bround(r * 100, 1).alias("predicted_6m_growth_rate"),
        bround(F.col("revenue") * (1 + r), 0).alias("predicted_6m_revenue"),
        F.col(stage).alias("growth_stage"),
        F.col(jump).alias("will_jump_category"),
        "current_revenue_category",
        "composite_growth_score",
        growth_action(r).alias("growth_action"))


def compliance_decisions(df: DataFrame, p_default: str, eligible: str = "eligible_for_funding",
                         health: str = "business_health_score") -> DataFrame:
    """Compliance table: level and bar-joined reasons."""
    level, reasons = compliance(p_default, eligible, health)
    return df.select(
        "sme_id",
        F.col(eligible).alias("eligible_for_funding"),
        bround(F.col(p_default), 3).alias("default_risk_probability"),
        bround(F.col(health), 1).alias("business_health_score"),
        level.alias("compliance_risk"),
        F.concat_ws("|", reasons).alias("reasons"))


def join_with_suffix(left: DataFrame, right: DataFrame, key: str = "sme_id",
                     suffix: str = "_growth", how: str = "inner") -> DataFrame:
    """Equi-join on ``key``; right columns that clash get ``suffix``."""
    clash = (set(left.columns) & set(right.columns)) - {key}
    r = right.select(*[F.col(n).alias(n + suffix if n in clash else n) for n in right.columns])
    return left.join(r, key, how)

