"""Funding targets (T1-T3) computed from an SME table.

With ``noise_on`` each draw is a function of the row key (N1), so the labels
are the same however the table is partitioned or ordered.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bizlens import schema as S
from bizlens.functions.exprs import bround, clip, clip01_repaired, cut, flag, noise, without_nan

# Target weights, limits and noise spreads.
ELIGIBILITY_LIMIT = 0.55
ELIGIBILITY_NOISE_SD = 0.1
RISK_NOISE_SD = 0.1
RISK_BINS = [0, 0.33, 0.66, 1]
HEALTH_SCORE_NOISE_SD = 8.0
HEALTH_SCORE_REVENUE_REF = 1_000_000


def eligibility_score(noise_on: bool = False, key: str = "sme_id") -> Column:
    c = F.col
    score = (flag(c("revenue") > 100_000) * 0.3
             + flag(c("profit_margin") > 0.12) * 0.2
             + flag(c("debt_ratio") < 0.45) * 0.2
             + flag(c("default_history") == 0) * 0.2
             + flag(c("tax_registered") == 1) * 0.1)
    if noise_on:
        score = score + noise(key, "eligibility", 0.0, ELIGIBILITY_NOISE_SD)
    return score


def default_risk_score(noise_on: bool = False, key: str = "sme_id") -> Column:
    """Clipped risk score in [0, 1] that T2 bins."""
    c = F.col
    raw = c("debt_ratio") * 0.4 + c("default_history") * 0.4 + (1 - c("profit_margin")) * 0.2
    if noise_on:
        raw = raw + noise(key, "risk", 0.0, RISK_NOISE_SD)
    return clip01_repaired(raw, nan=0.5)


def health_score(noise_on: bool = False, key: str = "sme_id") -> Column:
    c = F.col
    raw = (c("profit_margin") * 40 + (1 - c("debt_ratio")) * 30
           + F.log1p(c("revenue")) / F.lit(math.log1p(HEALTH_SCORE_REVENUE_REF)) * 30)
    if noise_on:
        raw = raw + noise(key, "health_score", 0.0, HEALTH_SCORE_NOISE_SD)
    return bround(clip(raw, 0, 100), 1)


def add_targets(df: DataFrame, noise_on: bool = False, key: str = "sme_id",
                keep_scores: bool = False) -> DataFrame:
    """Add ``eligible_for_funding`` (T1), ``default_risk`` (T2), ``business_health_score``."""
    out = without_nan(df).withColumns({
        "_eligibility_score": eligibility_score(noise_on, key),
        "default_risk_score": default_risk_score(noise_on, key),
        "business_health_score": health_score(noise_on, key),
    })
    out = out.withColumns({
        "eligible_for_funding": flag(F.col("_eligibility_score") > ELIGIBILITY_LIMIT),
        "default_risk": cut("default_risk_score", RISK_BINS, S.RISK_LEVELS),
    }).drop("_eligibility_score")
    out = out.select(*[n for n in out.columns if n != "business_health_score"],
                     "business_health_score")
    return out if keep_scores else out.drop("default_risk_score")
