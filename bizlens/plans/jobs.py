"""Batch score jobs (M20, M21, J2, J3): table in, decision table out.

Each job is one plan ``scan -> features -> model.transform -> decisions``;
predictions stay on their input row, so no positional alignment or join is
needed. ``score_all`` runs every bundle over the same rows and packs each
result into one struct per model. A row that a bundle's encoder can't take (an
ordinal value that is given and unknown) is left out of that bundle's results
and listed by :func:`rejected`.

Summaries of a batch (``*_summary``) are observed metrics on the scoring plan
itself: counts, bands, mean and median, and the share of unknown categories
come out of the pass that writes the results, in batch and in streams.
"""

from __future__ import annotations

import hashlib
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from bizlens import schema as S
from bizlens.functions.exprs import bround
from bizlens.operators import decisions as D
from bizlens.operators import encode as EN
from bizlens.operators import features as FT
from bizlens.plans.models import Bundle, train_bundle
from bizlens.session import ensure_checkpoint_dir, scratch_path

RISK_CLASS = "high"   # class whose probability is the default probability (Q3)


def funding_table(sme: DataFrame) -> DataFrame:
    """Funding models read the SME columns directly (Q11)."""
    return sme


def health_input(sme: DataFrame) -> DataFrame:
    return FT.health_features(sme)


def growth_input(sme: DataFrame) -> DataFrame:
    return FT.growth_features(sme)


def all_features(sme: DataFrame) -> DataFrame:
    """One row with every column the three bundles read.

    Health and growth share a few names (same formulas); the growth set is
    applied last, only its extra columns are new.
    """
    return FT.growth_features(FT.health_features(sme))


def scorable(bundle: Bundle, df: DataFrame) -> DataFrame:
    """The rows that the bundle's encoder can take."""
    return df.where(EN.unknown_reason(bundle.state, df.columns).isNull())


def rejected(bundle: Bundle, df: DataFrame) -> DataFrame:
    """``(sme_id, reject_reason)`` of the other rows."""
    reason = EN.unknown_reason(bundle.state, df.columns)
    return df.select("sme_id", reason.alias("reject_reason")).where("reject_reason IS NOT NULL")


def score_funding(bundle: Bundle, sme: DataFrame, risk_class: str = RISK_CLASS) -> DataFrame:
    """Funding result per SME: eligibility, default risk label and probability, health score."""
    p = bundle.add_predictions(scorable(bundle, sme))
    return p.select(
        "sme_id",
        F.col("pred_eligibility").alias("eligible_for_funding"),
        F.col("pred_default_risk").alias("default_risk"),
        (F.col("pred_default_risk") == risk_class).alias("is_high_default_risk"),   # Q4
        bround(bundle.probability_of("default_risk", risk_class), 3).alias("default_risk_probability"),
        bround(F.col("pred_business_health"), 2).alias("business_health_score"))


def score_compliance(bundle: Bundle, sme: DataFrame, risk_class: str = RISK_CLASS) -> DataFrame:
    """Compliance decisions (D2) from the funding models."""
    p = bundle.add_predictions(scorable(bundle, sme)).withColumn(
        "_p_default", bundle.probability_of("default_risk", risk_class))
    return D.compliance_decisions(p.withColumn("_elig", F.col("pred_eligibility") == 1), "_p_default",
                                  eligible="_elig", health="pred_business_health") \
            .withColumnRenamed("_elig", "eligible_for_funding")


def score_health(bundle: Bundle, sme: DataFrame) -> DataFrame:
    """Health decisions (D3): predicted category and the risk flags of the row (Q7)."""
    return D.health_decisions(bundle.add_predictions(health_input(sme)), category="pred_health_category")


def score_growth(bundle: Bundle, sme: DataFrame) -> DataFrame:
    """Growth decisions (D1, D4) from the predicted rate, stage and jump."""
    p = bundle.add_predictions(growth_input(sme))
    return D.growth_decisions(p, rate="pred_growth_rate", jump="pred_category_jump",
                              stage="pred_growth_stage")


def score_all(bundles: dict, sme: DataFrame, risk_class: str = RISK_CLASS) -> DataFrame:
    """Every model on every SME, one struct per model."""
    return score_prepared(bundles, all_features(sme), risk_class)


def score_prepared(bundles: dict, t: DataFrame, risk_class: str = RISK_CLASS) -> DataFrame:
    """All bundles over a table that already carries every feature column.

    The funding and compliance results of a row that the funding encoder can't take are null.
    """
    fund = bundles["funding"]
    ok = EN.unknown_reason(fund.state, t.columns).isNull()
    for name in ("funding", "health", "growth"):
        t = bundles[name].add_predictions(t)
    p_def = fund.probability_of("default_risk", risk_class)
    level, reasons = D.compliance(p_def, "pred_eligibility", "pred_business_health")
    rate = F.col("pred_growth_rate")
    return t.select(
        "sme_id",
        F.struct(bround(rate * 100, 1).alias("predicted_6m_growth_rate"),
                 bround(F.col("revenue") * (1 + rate), 0).alias("predicted_6m_revenue"),
                 F.col("pred_growth_stage").alias("growth_stage"),
                 (F.col("pred_category_jump") == 1).alias("will_jump_category"),
                 "current_revenue_category", "composite_growth_score",
                 D.growth_action(rate).alias("growth_action")).alias("growth"),
        F.struct(F.col("pred_health_category").alias("health_category"),
                 D.risk_flag_struct().alias("risk_flags")).alias("health"),
        F.when(ok, F.struct((F.col("pred_eligibility") == 1).alias("eligible_for_funding"),
                            F.col("pred_default_risk").alias("default_risk"),
                            bround(F.col("pred_business_health"), 2).alias("business_health_score"))).alias("funding"),
        F.when(ok, F.struct((F.col("pred_eligibility") == 1).alias("eligible_for_funding"),
                            bround(p_def, 3).alias("default_risk_probability"),
                            bround(F.col("pred_business_health"), 1).alias("business_health_score"),
                            level.alias("compliance_risk"), reasons.alias("reasons"))).alias("compliance"))


# ------------------------------------------------------------------ summaries


def growth_summary() -> list[Column]:
    """Of growth decisions: rows, stages, actions, jumps, mean and median rate (rates are whole tenths of a percent)."""
    rate, jump = F.col("predicted_6m_growth_rate"), F.col("will_jump_category").cast("int")
    return [F.count(F.lit(1)).alias("rows"),
            *[F.count_if(F.col("growth_stage") == s).alias(f"stage: {s}") for s in S.GROWTH_STAGES],
            *[F.count_if(F.col("growth_action") == a).alias(f"action: {a}") for a in [n for _, n in D.GROWTH_ACTIONS] + [D.GROWTH_ACTION_ELSE]],
            F.sum(jump).alias("jumps"), F.avg(jump).alias("jump share"), F.avg(rate).alias("mean rate"),
            F.median(rate).alias("median rate")]


def health_summary() -> list[Column]:
    """Of health decisions: rows, categories and bands of risk flags."""
    flags = F.col("total_risk_flags")
    return [F.count(F.lit(1)).alias("rows"),
            *[F.count_if(F.col("health_category") == c).alias(f"category: {c}") for c in S.HEALTH_CATEGORIES],
            F.count_if(flags == 0).alias("flags: 0"), F.count_if((flags >= 1) & (flags <= 2)).alias("flags: 1-2"),
            F.count_if(flags >= 3).alias("flags: 3+")]


def compliance_summary() -> list[Column]:
    """Of compliance decisions: rows, eligible ones and levels."""
    return [F.count(F.lit(1)).alias("rows"), F.count_if("eligible_for_funding").alias("eligible"),
            *[F.count_if(F.col("compliance_risk") == r).alias(f"level: {r}") for r in ("LOW", "MEDIUM", "HIGH")]]


def observed(df: DataFrame, metrics: list[Column], name: str) -> tuple[DataFrame, Observation]:
    """``df`` with metrics that are known once an action has run over it."""
    watch = Observation(name)
    return df.observe(watch, *metrics), watch


def summary_table(spark: SparkSession, watch: Observation) -> DataFrame:
    """``(metric, value)`` of an observation, after its action."""
    return spark.createDataFrame([(k, None if v is None else float(v)) for k, v in watch.get.items()],
                                 "metric STRING, value DOUBLE")


def unknown_shares(spark: SparkSession, watch: Observation) -> DataFrame:
    """``(column_name, given, unknown, share)`` from observed :func:`encode.unknown_counts` (Q6)."""
    got = watch.get
    cols = [k.removeprefix("given__") for k in got if k.startswith("given__")]
    return spark.createDataFrame(
        [(c, got[f"given__{c}"], got[f"unknown__{c}"],
          got[f"unknown__{c}"] / got[f"given__{c}"] if got[f"given__{c}"] else None) for c in cols],
        "column_name STRING, given BIGINT, unknown BIGINT, share DOUBLE")


# ------------------------------------------------------------------ stored results


def store_result(df: DataFrame, table: str, path: str, buckets: int = 16, key: str = "sme_id") -> DataFrame:
    """A result table bucketed and sorted by its key, one file a bucket, so that later joins on the key need no shuffle."""
    spark = df.sparkSession
    (df.repartition(buckets, key).write.mode("overwrite").format("parquet").option("path", path)
     .bucketBy(buckets, key).sortBy(key).saveAsTable(table))
    return spark.table(table)


def combine_stored(parts: dict[str, DataFrame], key: str = "sme_id") -> DataFrame:
    """Stored results of the same buckets joined on the key, one struct per result; a missing result is null."""
    out = None
    for name, df in parts.items():
        packed = df.select(key, F.struct(*[c for c in df.columns if c != key]).alias(name)).hint("merge")
        out = packed if out is None else out.join(packed, key, "left")
    return out


def training_inputs(sme: DataFrame) -> dict:
    return {"funding": funding_table(sme), "health": health_input(sme),
            "growth": growth_input(sme)}


_CACHE: dict = {}     # (application, key, bundle, overrides) -> saved path
_LOADED: dict = {}    # saved path -> loaded bundle; a path lies under its application's folder


def trained_bundles(spark: SparkSession, sme: DataFrame, key: str, overrides: dict | None = None,
                    names=("funding", "health", "growth")) -> dict:
    """Train (once per process and key), save to the checkpoint folder, load back (S3).

    The three bundles are independent and are trained concurrently.
    """
    app = spark.sparkContext.applicationId
    settings = repr(sorted((overrides or {}).items()))
    todo = [n for n in names if (app, key, n, settings) not in _CACHE]
    if todo:
        ensure_checkpoint_dir(spark)
        sme = sme.checkpoint(eager=True)        # the bundles share one computed profile
    inputs = training_inputs(sme)

    def train(name):
        b = train_bundle(spark, inputs[name], name, overrides=overrides)
        ck = (app, key, name, settings)
        path = scratch_path(spark, f"bundle_{name}_{hashlib.md5(repr((key, settings)).encode()).hexdigest()[:16]}")
        b.save(spark, path)
        return ck, path

    if todo:
        with ThreadPoolExecutor(max_workers=len(todo)) as pool:
            for ck, path in pool.map(train, todo):
                _CACHE[ck] = path
    out = {}
    for name in names:
        path = _CACHE[(app, key, name, settings)]
        if (app, path) not in _LOADED:
            _LOADED[app, path] = Bundle.load(spark, path)
        out[name] = _LOADED[app, path]
    return out

