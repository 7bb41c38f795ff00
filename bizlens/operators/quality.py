"""Consistency rules, null policies and column guards.

All are narrow projections or filters; the rule report is one aggregate
with map-side partial counts.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bizlens.functions.exprs import clean, repair_nonfinite, row_min

# ------------------------------------------------------------------ C1-C6


def apply_rules(df: DataFrame) -> DataFrame:
    """Repair an SME table so dependent columns agree (C1-C6), in rule order."""
    c = F.col
    funded = c("previous_funding_received") == 1
    out = df.withColumns({
        # C1 funding dependency
        "previous_funding_amount": F.when(funded, c("previous_funding_amount")).otherwise(F.lit(0.0)),
        "default_history": F.when(funded, c("default_history")).otherwise(F.lit(0)),
        # C2 collateral dependency
        "collateral_value": F.when(c("collateral_offered") == 1, c("collateral_value"))
                             .otherwise(F.lit(0.0)),
        # C3 payroll dependency
        "total_payroll": F.when(c("staff_count") > 0, c("total_payroll")).otherwise(F.lit(0.0)),
    })
    # C4 campaign dependency: one mask over three columns
    out = masked_assign(out, c("campaign_spend") == 0, ["clicks", "impressions", "conversions"], 0)
    # C5 customer nesting, in this order
    out = out.withColumn("active_customers", row_min("active_customers", "total_customers"))
    out = out.withColumn("repeat_customers", row_min("repeat_customers", "active_customers"))
    # C6 late payments at most one per month of age
    return out.withColumn(
        "late_payments",
        F.when(c("age_of_business") > 0,
               row_min("late_payments", c("age_of_business") * 12)).otherwise(F.lit(0))
         .cast(df.schema["late_payments"].dataType))


def rule_breaks() -> dict[str, Column]:
    """Predicates that are true on rows breaking a rule before repair."""
    c = F.col
    not_funded = F.coalesce(c("previous_funding_received") != 1, F.lit(True))
    return {
        "C1_funding": not_funded & ((c("previous_funding_amount") != 0) | (c("default_history") != 0)),
        "C2_collateral": F.coalesce(c("collateral_offered") != 1, F.lit(True))
                         & (c("collateral_value") != 0),
        "C3_payroll": F.coalesce(~(c("staff_count") > 0), F.lit(True)) & (c("total_payroll") != 0),
        "C4_campaign": (c("campaign_spend") == 0)
                       & ((c("clicks") != 0) | (c("impressions") != 0) | (c("conversions") != 0)),
        "C5_nesting": (c("active_customers") > c("total_customers"))
                      | (c("repeat_customers") > F.least(c("active_customers"), c("total_customers"))),
        "C6_late_payments": F.when(c("age_of_business") > 0,
                                   c("late_payments") > c("age_of_business") * 12)
                             .otherwise(c("late_payments") != 0),
    }


def rule_report(df: DataFrame) -> DataFrame:
    """Rows breaking each rule (long form: rule, rows_breaking, rows_total)."""
    breaks = rule_breaks()
    agg = df.agg(F.count(F.lit(1)).alias("rows_total"),
                 *[F.count_if(F.coalesce(p, F.lit(False))).alias(n) for n, p in breaks.items()])
    pairs = ", ".join(f"'{n}', {n}" for n in breaks)
    return agg.select(F.expr(f"stack({len(breaks)}, {pairs}) AS (rule, rows_breaking)"),
                      "rows_total")


# ------------------------------------------------------------------ P2-P11


def masked_assign(df: DataFrame, mask: Column, cols: Sequence[str], value) -> DataFrame:
    """``df.loc[mask, cols] = value`` (P9); a null mask leaves values as they are."""
    return df.withColumns({
        n: F.when(F.coalesce(mask, F.lit(False)), F.lit(value).cast(df.schema[n].dataType))
            .otherwise(F.col(n))
        for n in cols})


def add_missing(df: DataFrame, defaults: Mapping[str, object]) -> DataFrame:
    """Add absent columns with a per-column default."""
    missing = {n: F.lit(v) for n, v in defaults.items() if n not in df.columns}
    return df.withColumns(missing) if missing else df


def fill_blocks(df: DataFrame, fills: Mapping[str, object], as_string: Sequence[str] = ()) -> DataFrame:
    """Per-column null fill (P5); ``as_string`` columns are cast to string after."""
    out = df.withColumns({n: F.coalesce(F.col(n), F.lit(v).cast(df.schema[n].dataType))
                          for n, v in fills.items() if n in df.columns})
    if as_string:
        out = out.withColumns({n: F.col(n).cast("string") for n in as_string if n in out.columns})
    return out


def fill_all_zero(df: DataFrame) -> DataFrame:
    """Null fill of every column with 0; strings get "0" (P6)."""
    return df.fillna(0).fillna("0")


def null_cell_count(df: DataFrame) -> DataFrame:
    """Null cells and rows with a null: the numbers P7 logs, one row."""
    any_null = F.lit(False)
    for n in df.columns:
        any_null = any_null | F.col(n).isNull()
    return df.agg(
        sum((F.count_if(F.col(n).isNull()) for n in df.columns), F.lit(0)).alias("null_cells"),
        F.count_if(any_null).alias("rows_with_nulls"),
        F.count(F.lit(1)).alias("rows_total"))


def clean_columns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """null / NaN / +-inf -> 0.0 on the given columns (P10)."""
    return df.withColumns({n: clean(n) for n in cols})


def repair_columns(df: DataFrame, cols: Sequence[str], nan: float = 0.5, posinf: float = 1.0,
                   neginf: float = 0.0) -> DataFrame:
    """Non-finite repair with separate values."""
    return df.withColumns({n: repair_nonfinite(n, nan, posinf, neginf) for n in cols})

