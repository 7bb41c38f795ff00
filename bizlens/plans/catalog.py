"""Registered queries (Spark) and their DuckDB oracle twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from bizlens.plans import oracle as O
from bizlens.session import stored
from bizlens.sources import profile as _profile
from bizlens.sources.tables import read_table

_PLANS: dict = {}


def _memo(spark: SparkSession, key: tuple, make):
    """Reuse a logical plan within one session.

    A DataFrame is an immutable plan; reusing it only saves building the same
    wide projections again on the driver. Every query still runs it in full.
    """
    k = (spark.sparkContext.applicationId, id(spark)) + key
    if k not in _PLANS:
        _PLANS[k] = make()
    return _PLANS[k]


def build_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _memo(spark, ("profile", sf_dir), lambda: _profile.build_profile(spark, sf_dir))

from pyspark.sql import functions as F

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def rounded(df: DataFrame, cols, digits: int = 9) -> DataFrame:
    """Round columns computed with log/exp/cos; their last bit differs by engine."""
    return df.withColumns({c: F.bround(c, digits) for c in cols})


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE_SQL[name] = sql
        return fn
    return deco


@register("s6_profile", O.with_profile("SELECT * FROM profile"))
def q_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build_profile(spark, sf_dir)


OTHER_PERIOD = {"start": "1997-08-31", "months": 18}


@register("s6_profile_other_period", O.profile_sql(**OTHER_PERIOD))
def q_profile_other_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W1 with other dates: both periods bounded, revenue per year of the period."""
    return _profile.build_profile(spark, sf_dir, **OTHER_PERIOD)


MONTHLY = {"first": "1996-01", "last": "1998-12", "trailing": 6}


@register("w1_monthly_series", O.monthly_series_sql(**MONTHLY))
def q_monthly_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W1 for every month: trailing six months and the six before, per business, without gaps."""
    return _profile.build_monthly_series(spark, sf_dir, **MONTHLY)


# ------------------------------------------------------------------ features

from bizlens.operators import features as FT  # noqa: E402

TRANSCENDENTAL_FF = ["log_revenue"]
TRANSCENDENTAL_GF = ["marketing_efficiency"]


@register("ff_funding_features",
          O.with_profile(O.rounded(O.funding_sql("profile"), TRANSCENDENTAL_FF)))
def q_funding_features(spark, sf_dir):
    return rounded(FT.funding_features(build_profile(spark, sf_dir)), TRANSCENDENTAL_FF)


@register("hf_health_features", O.with_profile(O.health_sql("profile")))
def q_health_features(spark, sf_dir):
    return FT.health_features(build_profile(spark, sf_dir))


@register("gf_growth_features",
          O.with_profile(O.rounded(O.growth_sql("profile"), TRANSCENDENTAL_GF)))
def q_growth_features(spark, sf_dir):
    return rounded(FT.growth_features(build_profile(spark, sf_dir)), TRANSCENDENTAL_GF)


@register("hf_health_features_noise", O.with_profile(
    O.rounded(O.health_sql("profile", noise_on=True), ["health_probability"])))
def q_health_features_noise(spark, sf_dir):
    return rounded(FT.health_features(build_profile(spark, sf_dir), noise_on=True),
                   ["health_probability"])


@register("gf_growth_features_noise", O.with_profile(
    O.rounded(O.growth_sql("profile", noise_on=True), TRANSCENDENTAL_GF)))
def q_growth_features_noise(spark, sf_dir):
    return rounded(FT.growth_features(build_profile(spark, sf_dir), noise_on=True),
                   TRANSCENDENTAL_GF)


# ------------------------------------------------------------------ rules, labels, decisions

from bizlens import schema as S  # noqa: E402
from bizlens.operators import decisions as D  # noqa: E402
from bizlens.operators import labels as LB  # noqa: E402
from bizlens.operators import profiling as PR  # noqa: E402
from bizlens.operators import quality as QL  # noqa: E402


def sme_table(spark: SparkSession, sf_dir: str, noise_on: bool = False,
              keep_scores: bool = False) -> DataFrame:
    """The labelled SME table: profile, consistency rules, targets."""
    return _memo(spark, ("sme", sf_dir, noise_on, keep_scores), lambda: LB.add_targets(
        QL.apply_rules(build_profile(spark, sf_dir)), noise_on=noise_on, keep_scores=keep_scores))


def sme_ctes(noise_on: bool = False, keep_scores: bool = False) -> list[tuple[str, str]]:
    return [("repaired", O.repaired_sql("profile")),
            ("sme", O.targets_sql("repaired", noise_on=noise_on, keep_scores=keep_scores))]


def with_sme(body: str, extra=(), **kw) -> str:
    return O.with_profile(body, sme_ctes(**kw) + list(extra))


@register("c7_rule_report", O.with_profile(O.rule_report_sql("profile")))
def q_rule_report(spark, sf_dir):
    return QL.rule_report(build_profile(spark, sf_dir))


@register("c1_c6_repaired_profile", O.with_profile("SELECT * FROM repaired", sme_ctes()[:1]))
def q_repaired(spark, sf_dir):
    return QL.apply_rules(build_profile(spark, sf_dir))


@register("c1_c6_rules_idempotent",
          O.with_profile(O.rule_report_sql("repaired"), sme_ctes()[:1]))
def q_rules_idempotent(spark, sf_dir):
    return QL.rule_report(QL.apply_rules(build_profile(spark, sf_dir)))


@register("t1_t3_targets", with_sme(
    "SELECT sme_id, eligible_for_funding, default_risk, business_health_score FROM sme"))
def q_targets(spark, sf_dir):
    return sme_table(spark, sf_dir).select(
        "sme_id", "eligible_for_funding", "default_risk", "business_health_score")


@register("t1_t3_targets_noise", with_sme(
    "SELECT sme_id, eligible_for_funding, default_risk, business_health_score FROM sme",
    noise_on=True))
def q_targets_noise(spark, sf_dir):
    return sme_table(spark, sf_dir, noise_on=True).select(
        "sme_id", "eligible_for_funding", "default_risk", "business_health_score")


def health_table(spark, sf_dir):
    return _memo(spark, ("health", sf_dir), lambda: FT.health_features(sme_table(spark, sf_dir)))


def growth_table(spark, sf_dir):
    return _memo(spark, ("growth", sf_dir), lambda: FT.growth_features(sme_table(spark, sf_dir)))


HEALTH_CTE = ("health", O.health_sql("sme"))
GROWTH_CTE = ("growth", O.growth_sql("sme"))


@register("d3_health_decisions", with_sme(O.health_decisions_sql("health"), [HEALTH_CTE]))
def q_health_decisions(spark, sf_dir):
    return D.health_decisions(health_table(spark, sf_dir))


@register("d1_d4_growth_decisions", with_sme(O.growth_decisions_sql("growth"), [GROWTH_CTE]))
def q_growth_decisions(spark, sf_dir):
    return D.growth_decisions(growth_table(spark, sf_dir))


@register("d2_compliance_decisions", with_sme(O.compliance_decisions_sql("sme"), keep_scores=True))
def q_compliance_decisions(spark, sf_dir):
    return D.compliance_decisions(sme_table(spark, sf_dir, keep_scores=True), "default_risk_score")


SME_COLS = [f.name for f in S.SME_TABLE_SCHEMA.fields]
J1_LEFT = SME_COLS + FT.HEALTH_ADDED
J1_RIGHT = SME_COLS + FT.GROWTH_ADDED


@register("j1_health_growth_join", with_sme(
    O.rounded(O.suffix_join_sql("health", "growth", J1_LEFT, J1_RIGHT),
              ["marketing_efficiency"]), [HEALTH_CTE, GROWTH_CTE]))
def q_health_growth_join(spark, sf_dir):
    sme = sme_table(spark, sf_dir)
    return rounded(D.join_with_suffix(FT.health_features(sme), FT.growth_features(sme)),
                   ["marketing_efficiency"])


# ------------------------------------------------------------------ profiling


@register("health_summary", with_sme(f"""
SELECT c.rank, c.health_category,
       COUNT(h.sme_id) AS businesses,
       COUNT(h.sme_id) FILTER (WHERE h.total_risk_flags = 0) AS flags_0,
       COUNT(h.sme_id) FILTER (WHERE h.total_risk_flags BETWEEN 1 AND 2) AS flags_1_2,
       COUNT(h.sme_id) FILTER (WHERE h.total_risk_flags >= 3) AS flags_3_plus
FROM (VALUES {", ".join(f"({i}, '{v}')" for i, v in enumerate(S.HEALTH_CATEGORIES))})
     AS c(rank, health_category)
LEFT JOIN ({O.health_decisions_sql("health")}) h ON h.health_category = c.health_category
GROUP BY c.rank, c.health_category""", [HEALTH_CTE]))
def q_health_summary(spark, sf_dir):
    return health_summary(D.health_decisions(health_table(spark, sf_dir)))


def health_summary(decisions: DataFrame) -> DataFrame:
    """Flagship: businesses per health category (fixed order) and their risk-flag bands.

    One aggregate with a conditional count per (category, band), then
    ``stack`` to one row per category: no join with a category table.
    """
    cat, tot = F.col("health_category"), F.col("total_risk_flags")
    bands = {"businesses": F.lit(True), "flags_0": tot == 0,
             "flags_1_2": (tot >= 1) & (tot <= 2), "flags_3_plus": tot >= 3}
    aggs = [F.count_if((cat == v) & b).alias(f"_{i}_{n}")
            for i, v in enumerate(S.HEALTH_CATEGORIES) for n, b in bands.items()]
    parts = ", ".join(f"{i}, '{v}', " + ", ".join(f"_{i}_{n}" for n in bands)
                      for i, v in enumerate(S.HEALTH_CATEGORIES))
    return decisions.agg(*aggs).select(F.expr(
        f"stack({len(S.HEALTH_CATEGORIES)}, {parts}) AS (rank, health_category, "
        + ", ".join(bands) + ")"))


FLAGSHIP = "health_summary"


@register("a1_value_counts_sector", with_sme(
    "SELECT sector, COUNT(*) AS count FROM sme WHERE sector IS NOT NULL GROUP BY sector"))
def q_value_counts(spark, sf_dir):
    return PR.value_counts(sme_table(spark, sf_dir), "sector")


@register("a1_value_counts_default_risk", with_sme(
    "SELECT default_risk, COUNT(*) AS count FROM sme WHERE default_risk IS NOT NULL "
    "GROUP BY default_risk"))
def q_value_counts_risk(spark, sf_dir):
    return PR.value_counts(sme_table(spark, sf_dir), "default_risk")


A2_COLS = SME_COLS


@register("a2_row_value_counts", with_sme(
    f"SELECT {', '.join(A2_COLS)}, COUNT(*) AS count FROM sme WHERE "
    + " AND ".join(f"{c} IS NOT NULL" for c in A2_COLS) + f" GROUP BY {', '.join(A2_COLS)}"))
def q_row_value_counts(spark, sf_dir):
    return PR.row_value_counts(sme_table(spark, sf_dir).select(*A2_COLS))


@register("a3_growth_stage_counts", with_sme(f"""
SELECT c.rank, c.growth_stage, COUNT(g.sme_id) AS count
FROM (VALUES {", ".join(f"({i}, '{v}')" for i, v in enumerate(S.GROWTH_STAGES))}) AS c(rank, growth_stage)
LEFT JOIN growth g ON g.growth_stage = c.growth_stage
GROUP BY c.rank, c.growth_stage""", [GROWTH_CTE]))
def q_growth_stage_counts(spark, sf_dir):
    return PR.ordered_counts(growth_table(spark, sf_dir), "growth_stage", S.GROWTH_STAGES)


@register("a4_growth_rate_stats", with_sme("""
SELECT round_even(avg(predicted_6m_growth_rate), 9) AS mean,
       round_even(quantile_cont(predicted_6m_growth_rate, 0.5), 9) AS median,
       round_even(stddev_samp(predicted_6m_growth_rate), 9) AS std,
       min(predicted_6m_growth_rate) AS min, max(predicted_6m_growth_rate) AS max
FROM growth""", [GROWTH_CTE]))
def q_growth_rate_stats(spark, sf_dir):
    return PR.column_stats(growth_table(spark, sf_dir), "predicted_6m_growth_rate")


A5_COLS = [f.name for f in S.SME_TABLE_SCHEMA.fields if isinstance(f.dataType, PR.NUMERIC)]


@register("a5_describe", with_sme(" UNION ALL ".join(
    f"SELECT {i} AS position, '{c}' AS column_name, COUNT({c}) AS count, "
    f"round_even(avg({c}), 6) AS mean, round_even(stddev_samp({c}), 6) AS std, "
    f"CAST(min({c}) AS DOUBLE) AS min, round_even(quantile_cont({c}, 0.25), 6) AS q25, "
    f"round_even(quantile_cont({c}, 0.5), 6) AS q50, round_even(quantile_cont({c}, 0.75), 6) AS q75, "
    f"CAST(max({c}) AS DOUBLE) AS max FROM sme" for i, c in enumerate(A5_COLS))))
def q_describe(spark, sf_dir):
    return PR.describe(sme_table(spark, sf_dir), A5_COLS)


@register("a6_jump_share", with_sme(
    "SELECT CAST(SUM(will_jump_category) AS BIGINT) AS ones, AVG(will_jump_category) AS share, "
    "COUNT(will_jump_category) AS rows FROM growth", [GROWTH_CTE]))
def q_jump_share(spark, sf_dir):
    return PR.flag_share(growth_table(spark, sf_dir), "will_jump_category")


@register("a7_risk_bands", with_sme(
    "SELECT COUNT(*) FILTER (WHERE total_risk_flags = 0) AS flags_0, "
    "COUNT(*) FILTER (WHERE total_risk_flags BETWEEN 1 AND 2) AS flags_1_2, "
    "COUNT(*) FILTER (WHERE total_risk_flags >= 3) AS flags_3_plus "
    f"FROM ({O.health_decisions_sql('health')})", [HEALTH_CTE]))
def q_risk_bands(spark, sf_dir):
    return PR.banded_counts(D.health_decisions(health_table(spark, sf_dir)), "total_risk_flags")


FF_ALL = [f.name for f in S.PROFILE_SCHEMA.fields] + [
    "log_revenue", "profit_per_employee", "late_payment_rate", "debt_profit_ratio",
    "marketing_efficiency", "funding_request_ratio", "customer_retention_rate",
    "invoice_completion_rate", "liquidity_ratio", "payroll_to_revenue",
    "marketing_conversion_rate", "profitability", "financial_health", "payment_behavior",
    "operational_efficiency", "marketing_roi", "business_maturity", "customer_base_size",
    "funding_size_category"]


@register("a8_null_profile", O.with_profile(" UNION ALL ".join(
    f"SELECT {i} AS position, '{c}' AS column_name, COUNT(*) FILTER (WHERE {c} IS NULL) AS nulls, "
    f"COUNT(*) AS rows FROM ff" for i, c in enumerate(FF_ALL)),
    [("ff", O.funding_sql("profile", drop_nulls=False))]))
def q_null_profile(spark, sf_dir):
    return PR.null_profile(FT.funding_features(build_profile(spark, sf_dir), drop_nulls=False))


@register("p7_null_cells", O.with_profile(
    "SELECT CAST(" + " + ".join(f"COUNT(*) FILTER (WHERE {c} IS NULL)" for c in FF_ALL)
    + " AS BIGINT) AS null_cells, COUNT(*) FILTER (WHERE "
    + " OR ".join(f"{c} IS NULL" for c in FF_ALL) + ") AS rows_with_nulls, COUNT(*) AS rows_total "
    "FROM ff", [("ff", O.funding_sql("profile", drop_nulls=False))]))
def q_null_cells(spark, sf_dir):
    return QL.null_cell_count(FT.funding_features(build_profile(spark, sf_dir), drop_nulls=False))


A9_COLS = SME_COLS


@register("a9_duplicate_rows", with_sme(
    f"SELECT COUNT(*) AS rows, (SELECT COUNT(*) FROM (SELECT DISTINCT {', '.join(A9_COLS)} FROM sme)) "
    f"AS distinct_rows, COUNT(*) - (SELECT COUNT(*) FROM (SELECT DISTINCT {', '.join(A9_COLS)} "
    f"FROM sme)) AS duplicates FROM sme"))
def q_duplicate_rows(spark, sf_dir):
    return PR.duplicate_rows(sme_table(spark, sf_dir).select(*A9_COLS))


SPARK_TYPE_NAMES = {"LongType()": "bigint", "DoubleType()": "double", "IntegerType()": "int",
                    "StringType()": "string"}


@register("a10_schema_profile", with_sme(" UNION ALL ".join(
    f"SELECT {i} AS position, '{f.name}' AS column_name, "
    f"'{SPARK_TYPE_NAMES[repr(f.dataType)]}' AS data_type, COUNT({f.name}) AS non_null, "
    f"COUNT(*) AS rows FROM sme" for i, f in enumerate(S.SME_TABLE_SCHEMA.fields))))
def q_schema_profile(spark, sf_dir):
    return PR.schema_profile(sme_table(spark, sf_dir))


@register("l1_first_rows", with_sme(
    f"SELECT * FROM ({O.health_decisions_sql('health')}) ORDER BY sme_id LIMIT 5", [HEALTH_CTE]))
def q_first_rows(spark, sf_dir):
    return PR.first_rows(D.health_decisions(health_table(spark, sf_dir)), 5)


# ------------------------------------------------------------------ encoding

from bizlens.operators import encode as EN  # noqa: E402
from bizlens.operators import metrics as MT  # noqa: E402

SORTED_VOCAB = {c: sorted(v) for c, v in S.CATEGORICAL_VOCAB.items()}
SORTED_VOCAB["current_revenue_category"] = sorted(S.SIZE_CATEGORIES)


def round_features(df: DataFrame, names, digits: int = 9) -> DataFrame:
    return df.withColumns({n: F.bround(n, digits) for n in names})


@register("a12_scaler_stats", with_sme(" UNION ALL ".join(
    f"SELECT {i} AS position, '{c}' AS column_name, round_even(avg(CAST({c} AS DOUBLE)), 6) AS mean, "
    f"round_even(CASE WHEN stddev_pop(CAST({c} AS DOUBLE)) = 0 THEN 1.0 "
    f"ELSE stddev_pop(CAST({c} AS DOUBLE)) END, 6) AS std FROM sme"
    for i, c in enumerate(S.FUNDING_FEATURES["numeric"]))))
def q_scaler_stats(spark, sf_dir):
    st = EN.scaler_stats(sme_table(spark, sf_dir), S.FUNDING_FEATURES["numeric"])
    return st.withColumns({"mean": F.bround("mean", 6), "std": F.bround("std", 6)})


@register("a13_vocabulary", with_sme(" UNION ALL ".join(
    f"SELECT '{c}' AS column_name, CAST(row_number() OVER (ORDER BY v) - 1 AS INTEGER) AS position, "
    f"v AS value FROM (SELECT DISTINCT CAST({c} AS VARCHAR) AS v FROM sme WHERE {c} IS NOT NULL)"
    for c in S.FUNDING_FEATURES["onehot"])))
def q_vocabulary(spark, sf_dir):
    return EN.vocabulary(sme_table(spark, sf_dir), S.FUNDING_FEATURES["onehot"])


def _fit_input(df: DataFrame, spec) -> DataFrame:
    """The columns that an encoder reads, stored: the fit and the encoding don't each compute the profile again."""
    return stored(df.select("sme_id", *[c for block in spec.values() for c in block]), "fit_input")


def _encoded(df: DataFrame, spec) -> DataFrame:
    df = _fit_input(df, spec)
    state = EN.fit_encoder(df, spec)
    return round_features(EN.encode(df, state), state.feature_names())


@register("m1_m5_encoded_funding", with_sme(
    O.encode_sql("sme", S.FUNDING_FEATURES, SORTED_VOCAB, S.ORDINAL_ORDER)))
def q_encoded_funding(spark, sf_dir):
    return _encoded(sme_table(spark, sf_dir), S.FUNDING_FEATURES)


@register("m1_m5_encoded_health", with_sme(
    O.encode_sql("health", S.HEALTH_FEATURES, SORTED_VOCAB, S.ORDINAL_ORDER), [HEALTH_CTE]))
def q_encoded_health(spark, sf_dir):
    return _encoded(health_table(spark, sf_dir), S.HEALTH_FEATURES)


@register("m1_m5_encoded_growth", with_sme(
    O.encode_sql("growth", S.GROWTH_FEATURES, SORTED_VOCAB, S.ORDINAL_ORDER), [GROWTH_CTE]))
def q_encoded_growth(spark, sf_dir):
    return _encoded(growth_table(spark, sf_dir), S.GROWTH_FEATURES)


SERVED_ABSENT = ["location", "owner_gender", "profit_margin"]
SERVED_CTE = ("served", f"""SELECT * EXCLUDE ({', '.join(SERVED_ABSENT)}, revenue, sector, business_stage),
  'unknown' AS location, 'unknown' AS owner_gender, 0.0 AS profit_margin,
  CASE WHEN sme_id % 5 = 0 THEN 0.0 ELSE revenue END AS revenue,
  CASE WHEN sme_id % 7 = 0 THEN 'unknown' ELSE sector END AS sector,
  CASE WHEN sme_id % 3 = 0 THEN 'startup' ELSE business_stage END AS business_stage FROM growth""")


@register("p4_p5_serving_features", with_sme(
    O.encode_sql("served", S.GROWTH_FEATURES, SORTED_VOCAB, S.ORDINAL_ORDER, fit_src="growth"),
    [GROWTH_CTE, SERVED_CTE]))
def q_serving_features(spark, sf_dir):
    """A table without some columns and with nulls, encoded for a fitted bundle (P4, P5 before M1-M4)."""
    growth = _fit_input(growth_table(spark, sf_dir), S.GROWTH_FEATURES)
    state = EN.fit_encoder(growth, S.GROWTH_FEATURES)
    k = F.col("sme_id")
    served = growth.drop(*SERVED_ABSENT).withColumns({
        "revenue": F.when(k % 10 == 0, F.lit(None)).when(k % 5 == 0, F.lit(float("nan"))).otherwise(F.col("revenue")),
        "sector": F.when(k % 7 != 0, F.col("sector")),
        "business_stage": F.when(k % 3 != 0, F.col("business_stage"))})
    return round_features(EN.encode(served, state, defaults=S.SERVING_DEFAULTS["growth"]), state.feature_names())


@register("m7_stratified_split", with_sme(
    O.stratified_split_sql("sme", "default_risk", 0.2)))
def q_stratified_split(spark, sf_dir):
    sme = sme_table(spark, sf_dir).where(F.col("default_risk").isNotNull())
    return EN.split(sme, 0.2, stratify="default_risk").select("sme_id", "default_risk", "is_test")


@register("m7_split_shares", with_sme(
    "SELECT default_risk, COUNT(*) AS rows, COUNT(*) FILTER (WHERE is_test) AS test_rows FROM ("
    + O.stratified_split_sql("sme", "default_risk", 0.2) + ") GROUP BY default_risk"))
def q_split_shares(spark, sf_dir):
    sme = sme_table(spark, sf_dir).where(F.col("default_risk").isNotNull())
    return EN.split(sme, 0.2, stratify="default_risk").groupBy("default_risk").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if("is_test").alias("test_rows"))


@register("m7_plain_split", with_sme(
    f"SELECT sme_id, {O.split_hash_sql()} < {O.lit(0.3)} AS is_test FROM sme"))
def q_plain_split(spark, sf_dir):
    return EN.split(sme_table(spark, sf_dir), 0.3).select("sme_id", "is_test")


@register("m8_class_weights", with_sme(
    "SELECT will_jump_category, COUNT(*) AS count, "
    "SUM(COUNT(*)) OVER () / (COUNT(*) OVER () * COUNT(*)) AS weight "
    "FROM growth WHERE will_jump_category IS NOT NULL GROUP BY will_jump_category", [GROWTH_CTE]))
def q_class_weights(spark, sf_dir):
    return EN.class_weight_table(growth_table(spark, sf_dir), "will_jump_category")


@register("m13_label_index", with_sme(
    "SELECT default_risk, CAST(row_number() OVER (ORDER BY default_risk) - 1 AS INTEGER) AS index "
    "FROM (SELECT DISTINCT default_risk FROM sme WHERE default_risk IS NOT NULL)"))
def q_label_index(spark, sf_dir):
    return EN.label_index_table(sme_table(spark, sf_dir), "default_risk")


# ------------------------------------------------------------------ metrics


@register("m16_accuracy", with_sme(
    "SELECT AVG(CAST(COALESCE(current_revenue_category = predicted_revenue_category, false) AS DOUBLE))"
    " AS accuracy, COUNT(*) AS rows FROM growth", [GROWTH_CTE]))
def q_accuracy(spark, sf_dir):
    return MT.accuracy(growth_table(spark, sf_dir), "current_revenue_category",
                       "predicted_revenue_category")


@register("m17_classification_report", with_sme(O.classification_report_sql(
    "growth", "current_revenue_category", "predicted_revenue_category"), [GROWTH_CTE]))
def q_classification_report(spark, sf_dir):
    rep = MT.classification_report(growth_table(spark, sf_dir), "current_revenue_category",
                                   "predicted_revenue_category")
    return round_features(rep, ["precision", "recall", "f1"]).withColumn(
        "support", F.col("support").cast("bigint"))


def noise_pair(df: DataFrame) -> DataFrame:
    """Growth targets without noise (``*_base``) beside the same targets with noise."""
    base = df.select(*[F.col(c) for c in df.columns if c not in (
        "predicted_6m_growth_rate", "growth_stage", "predicted_6m_revenue",
        "predicted_revenue_category", "current_revenue_category", "will_jump_category")],
        F.col("predicted_6m_growth_rate").alias("rate_base"), F.col("growth_stage").alias("stage_base"))
    return FT.growth_targets(base, noise_on=True)


NOISE_PAIR_CTE = ("pair", O.growth_targets_sql(
    "(SELECT * EXCLUDE (predicted_6m_growth_rate, growth_stage, predicted_6m_revenue, "
    "predicted_revenue_category, current_revenue_category, will_jump_category), "
    "predicted_6m_growth_rate AS rate_base, growth_stage AS stage_base FROM growth)", noise_on=True))


@register("m18_confusion_matrix", with_sme(" UNION ALL ".join(
    f"SELECT {i} AS position, '{a}' AS label, " + ", ".join(
        f"COUNT(*) FILTER (WHERE stage_base = '{a}' AND growth_stage = '{b}') AS \"pred_{b}\""
        for b in S.GROWTH_STAGES) + " FROM pair"
    for i, a in enumerate(S.GROWTH_STAGES)), [GROWTH_CTE, NOISE_PAIR_CTE]))
def q_confusion(spark, sf_dir):
    return MT.confusion_matrix(noise_pair(growth_table(spark, sf_dir)), "stage_base",
                               "growth_stage", S.GROWTH_STAGES)


@register("m19_regression_metrics", with_sme(
    "SELECT round_even(sqrt(avg((rate_base - predicted_6m_growth_rate) * "
    "(rate_base - predicted_6m_growth_rate))), 9) AS rmse, "
    "round_even(avg(abs(rate_base - predicted_6m_growth_rate)), 9) AS mae, "
    "round_even(1 - SUM((rate_base - predicted_6m_growth_rate) * (rate_base - predicted_6m_growth_rate))"
    " / SUM((rate_base - (SELECT avg(rate_base) FROM pair)) * (rate_base - (SELECT avg(rate_base) FROM pair))), 9)"
    " AS r2, COUNT(*) AS rows FROM pair", [GROWTH_CTE, NOISE_PAIR_CTE]))
def q_regression_metrics(spark, sf_dir):
    m = MT.regression_metrics(noise_pair(growth_table(spark, sf_dir)), "rate_base",
                              "predicted_6m_growth_rate")
    return round_features(m, ["rmse", "mae", "r2"])


# ------------------------------------------------------------------ models (R: rows-only checks)

from bizlens.plans import jobs as JB  # noqa: E402
from bizlens.plans import models as MD  # noqa: E402


def bundles_for(spark: SparkSession, sf_dir: str) -> dict:
    """Bundles trained on this folder's tables with the reference settings (once per process)."""
    return JB.trained_bundles(spark, sme_table(spark, sf_dir), key=sf_dir)


@register("m9_m10_funding_scores")
def q_funding_scores(spark, sf_dir):
    return JB.score_funding(bundles_for(spark, sf_dir)["funding"], sme_table(spark, sf_dir))


@register("m20_compliance_batch")
def q_compliance_batch(spark, sf_dir):
    return JB.score_compliance(bundles_for(spark, sf_dir)["funding"], sme_table(spark, sf_dir))


@register("m12_health_scores")
def q_health_scores(spark, sf_dir):
    return JB.score_health(bundles_for(spark, sf_dir)["health"], sme_table(spark, sf_dir))


@register("m11_growth_scores")
def q_growth_scores(spark, sf_dir):
    return JB.score_growth(bundles_for(spark, sf_dir)["growth"], sme_table(spark, sf_dir))


@register("m21_score_all")
def q_score_all(spark, sf_dir):
    return JB.score_all(bundles_for(spark, sf_dir), sme_table(spark, sf_dir))


@register("m16_m19_model_metrics")
def q_model_metrics(spark, sf_dir):
    return MD.metrics_table(spark, list(bundles_for(spark, sf_dir).values()))


# ------------------------------------------------------------------ requests and streams

import uuid  # noqa: E402

from bizlens.session import scratch_path  # noqa: E402
from bizlens.sources import requests as RQ  # noqa: E402
from bizlens.streaming import scoring as ST  # noqa: E402

SME_TABLE_COLS = [f.name for f in S.SME_TABLE_SCHEMA.fields]


def parsed_requests(spark, sf_dir):
    return RQ.parse_requests(RQ.request_json(sme_table(spark, sf_dir)))


@register("s4_request_parse", with_sme(O.request_parse_sql("sme", SME_TABLE_COLS)))
def q_request_parse(spark, sf_dir):
    return parsed_requests(spark, sf_dir)


@register("p13_request_validation", with_sme(
    "SELECT reject_reason, COUNT(*) AS count FROM (" + O.request_parse_sql("sme", SME_TABLE_COLS)
    + ") GROUP BY reject_reason"))
def q_request_validation(spark, sf_dir):
    return parsed_requests(spark, sf_dir).groupBy("reject_reason").count()


def mixed_requests(sme: DataFrame) -> DataFrame:
    """Requests of every business, with faults by key: cut off, wrong stage, null flag, wrong and textual numbers."""
    k = F.col("sme_id")
    cols = [F.col(n).cast("string").alias(n) if n == "sme_id" else F.col(n)
            for n, _, _ in RQ.REQUEST_FIELDS if n in sme.columns]
    value = F.to_json(F.struct(*cols))
    return sme.select(
        F.when(k % 17 == 0, F.substring(value, 1, 40))
        .when(k % 13 == 0, F.regexp_replace(value, '"business_stage":"[a-z]+"', '"business_stage":"scaleup"'))
        .when(k % 11 == 0, F.regexp_replace(value, '"tax_registered":[01]', '"tax_registered":null'))
        .when(k % 7 == 0, F.regexp_replace(value, '"revenue":[-+.E0-9]+', '"revenue":"lots"'))
        .when(k % 5 == 0, F.regexp_replace(value, '"profit_margin":[-+.E0-9]+', '"profit_margin":"0.25"'))
        .otherwise(value).alias("value"))


MIXED_SQL = """SELECT CASE WHEN sme_id % 17 = 0 THEN 'unknown' ELSE CAST(sme_id AS VARCHAR) END AS sme_id,
  CASE WHEN sme_id % 17 = 0 THEN 'malformed record or field type'
       WHEN sme_id % 13 = 0 THEN 'business_stage not in startup/growth/mature'
       WHEN sme_id % 11 = 0 THEN 'tax_registered is not a whole number'
       WHEN sme_id % 7 = 0 THEN 'revenue is not a number' END AS reject_reason FROM sme"""


@register("p13_rejected_requests", with_sme(MIXED_SQL))
def q_rejected_requests(spark, sf_dir):
    return RQ.parse_requests(mixed_requests(sme_table(spark, sf_dir))).select("sme_id", "reject_reason")


HF19_COLS = ["liquidity_ratio", "cash_months", "revenue_per_employee", "payroll_to_revenue",
             "invoice_paid_rate", "staff_retention_rate", "customer_active_rate",
             "customer_repeat_rate", "marketing_roi", "conversion_rate"] + S.RISK_FLAG_COLS


@register("hf19_request_ratios", with_sme(
    f"SELECT CAST(sme_id AS VARCHAR) AS sme_id, {', '.join(HF19_COLS)} FROM health", [HEALTH_CTE]))
def q_request_ratios(spark, sf_dir):
    valid, _ = RQ.split_requests(parsed_requests(spark, sf_dir))
    return RQ.fill_flags(RQ.fill_ratios(valid)).select("sme_id", *HF19_COLS)


def health_result_json(decisions: DataFrame) -> DataFrame:
    """The health result of each business as one JSON document."""
    flags = F.struct(*[F.col(n) for n in S.RISK_FLAG_COLS], F.col("total_risk_flags").alias("total"))
    return decisions.select(F.col("sme_id").cast("string").alias("sme_id"), RQ.to_json_result(
        [F.col("sme_id").cast("string").alias("sme_id"), "health_category",
         flags.alias("risk_flags")]).alias("result"))


@register("s5_health_result_json", with_sme(
    "SELECT CAST(sme_id AS VARCHAR) AS sme_id, CAST(to_json({'sme_id': CAST(sme_id AS VARCHAR), "
    "'health_category': health_category, 'risk_flags': {"
    + ", ".join(f"'{n}': {n}" for n in S.RISK_FLAG_COLS)
    + ", 'total': total_risk_flags}}) AS VARCHAR) AS result FROM ("
    + O.health_decisions_sql("health") + ")", [HEALTH_CTE]))
def q_health_result_json(spark, sf_dir):
    return health_result_json(D.health_decisions(health_table(spark, sf_dir)))


def _stream_dirs(spark, name):
    base = scratch_path(spark, f"{name}_{uuid.uuid4().hex}")
    return {k: f"{base}/{k}" for k in ("requests", "out", "rejected", "checkpoint")}


@register("st1_stream_scores")
def q_stream_scores(spark, sf_dir):
    bundles = bundles_for(spark, sf_dir)
    d = _stream_dirs(spark, "st1")
    RQ.request_json(sme_table(spark, sf_dir)).write.mode("overwrite").text(d["requests"])
    q = ST.start_scoring_stream(spark, bundles, d["requests"], d["out"], d["checkpoint"])
    q.awaitTermination()
    return spark.read.schema("sme_id STRING, result STRING").json(d["out"])


@register("st2_stream_with_rejects", with_sme(
    f"SELECT sme_id, CASE WHEN reject_reason IS NULL THEN 'scored' ELSE 'rejected' END AS kind, reject_reason "
    f"FROM ({MIXED_SQL})"))
def q_stream_with_rejects(spark, sf_dir):
    bundles = bundles_for(spark, sf_dir)
    d = _stream_dirs(spark, "st2")
    mixed_requests(sme_table(spark, sf_dir)).write.mode("overwrite").text(d["requests"])
    q = ST.start_scoring_stream_with_rejects(spark, bundles, d["requests"], d["out"], d["rejected"],
                                             d["checkpoint"])
    q.awaitTermination()
    res = spark.read.schema("sme_id STRING, result STRING, batch_id INT").parquet(d["out"])
    rej = spark.read.schema("sme_id STRING, reject_reason STRING, batch_id INT").parquet(d["rejected"])
    scored = res.select("sme_id", F.lit("scored").alias("kind"), F.lit(None).cast("string").alias("reject_reason"))
    return scored.unionByName(rej.select("sme_id", F.lit("rejected").alias("kind"), "reject_reason"))


# ------------------------------------------------------------------ sources, sinks and null policies

from bizlens.sources import tables as TB  # noqa: E402


@register("s1_s2_csv_roundtrip", with_sme("SELECT * FROM sme"))
def q_csv_roundtrip(spark, sf_dir):
    """S2 then S1: write the labelled table as CSV with a header, read it back typed."""
    path = scratch_path(spark, f"sme_csv_{uuid.uuid4().hex}")
    TB.write_table(sme_table(spark, sf_dir), path, fmt="csv")
    return TB.read_csv(spark, path, S.SME_TABLE_SCHEMA)


# Per-block defaults for absent columns and nulls (growth bundle).
BLOCK_DEFAULTS = {"ordinal": "startup", "onehot": "unknown", "numeric": 0.0, "binary": 0}


def fill_growth_blocks(df: DataFrame) -> DataFrame:
    """P4 + P5: absent columns get the block default, nulls are filled per block."""
    spec = S.GROWTH_FEATURES
    defaults = {c: BLOCK_DEFAULTS[b] for b in spec for c in spec[b]}
    out = QL.add_missing(df, defaults)
    out = QL.fill_blocks(out, defaults, as_string=spec["ordinal"] + spec["onehot"])
    return out.select("sme_id", *[c for b in spec for c in spec[b]])


def _fill_growth_sql(src: str) -> str:
    spec = S.GROWTH_FEATURES
    cols = []
    for b in spec:
        for c in spec[b]:
            d = BLOCK_DEFAULTS[b]
            if b in ("ordinal", "onehot"):
                cols.append(f"CAST(COALESCE({c}, {O.lit(d)}) AS VARCHAR) AS {c}")
            else:
                cols.append(f"COALESCE({c}, {O.lit(d)}) AS {c}")
    return f"SELECT sme_id, {', '.join(cols)} FROM {src}"


@register("p4_p5_block_fill", with_sme(
    O.rounded(_fill_growth_sql("growth"), ["marketing_efficiency"]), [GROWTH_CTE]))
def q_block_fill(spark, sf_dir):
    return rounded(fill_growth_blocks(growth_table(spark, sf_dir)), ["marketing_efficiency"])


FF_TYPES = {f.name: f.dataType.simpleString() for f in S.PROFILE_SCHEMA.fields}
FF_TYPES.update({n: "double" for n in FF_ALL[len(S.PROFILE_SCHEMA.fields):len(S.PROFILE_SCHEMA.fields) + 11]})
FF_TYPES.update({n: "string" for n in FF_ALL[len(S.PROFILE_SCHEMA.fields) + 11:]})


@register("p6_fill_zero", O.with_profile(O.rounded("SELECT " + ", ".join(
    f"COALESCE({c}, '0') AS {c}" if FF_TYPES[c] == "string" else
    (f"COALESCE({c}, 0.0) AS {c}" if FF_TYPES[c] == "double" else f"COALESCE({c}, 0) AS {c}")
    for c in FF_ALL) + " FROM ff", ["log_revenue"]), [("ff", O.funding_sql("profile", drop_nulls=False))]))
def q_fill_zero(spark, sf_dir):
    ff = FT.funding_features(build_profile(spark, sf_dir), drop_nulls=False)
    return rounded(QL.fill_all_zero(ff), ["log_revenue"])


P10_COLS = S.GROWTH_FEATURES["numeric"]


@register("p10_p11_nonfinite_repair", with_sme(O.rounded(
    "SELECT sme_id, " + ", ".join(f"{O.clean(c)} AS {c}" for c in P10_COLS)
    + ", CASE WHEN predicted_6m_growth_rate IS NULL OR isnan(predicted_6m_growth_rate) THEN 0.5 "
      "WHEN predicted_6m_growth_rate = CAST('inf' AS DOUBLE) THEN 1.0 "
      "WHEN predicted_6m_growth_rate = CAST('-inf' AS DOUBLE) THEN 0.0 "
      "ELSE predicted_6m_growth_rate END AS predicted_6m_growth_rate FROM growth", TRANSCENDENTAL_GF), [GROWTH_CTE]))
def q_nonfinite(spark, sf_dir):
    g = growth_table(spark, sf_dir)
    out = QL.repair_columns(QL.clean_columns(g, P10_COLS), ["predicted_6m_growth_rate"])
    return rounded(out.select("sme_id", *P10_COLS, "predicted_6m_growth_rate"), TRANSCENDENTAL_GF)


@register("l2_first_row_sample", with_sme(
    f"SELECT * FROM ({O.growth_decisions_sql('growth')}) ORDER BY sme_id LIMIT 1", [GROWTH_CTE]))
def q_first_row(spark, sf_dir):
    return PR.first_rows(D.growth_decisions(growth_table(spark, sf_dir)), 1)


# ------------------------------------------------------------------ defaults and rejects of every bundle

FUNDING_ABSENT = ["business_stage", "owner_gender", "collateral_value"]
FUNDING_SERVED_CTE = ("served", f"""SELECT * EXCLUDE ({', '.join(FUNDING_ABSENT)}, education_level, sector, total_payroll),
  'startup' AS business_stage, '0' AS owner_gender, 0.0 AS collateral_value,
  CASE WHEN sme_id % 3 = 0 THEN 'none' ELSE education_level END AS education_level,
  CASE WHEN sme_id % 7 = 0 THEN 'unknown' ELSE sector END AS sector,
  CASE WHEN sme_id % 5 = 0 THEN 0.0 ELSE total_payroll END AS total_payroll FROM sme""")


@register("p4_p5_serving_funding", with_sme(
    O.encode_sql("served", S.FUNDING_FEATURES, SORTED_VOCAB, S.ORDINAL_ORDER, fit_src="sme"), [FUNDING_SERVED_CTE]))
def q_serving_funding(spark, sf_dir):
    """Absent and null ordinals of the funding bundle count as the first category, nothing is raised."""
    sme = _fit_input(sme_table(spark, sf_dir), S.FUNDING_FEATURES)
    state = EN.fit_encoder(sme, S.FUNDING_FEATURES, unknown_ordinal="error")
    k = F.col("sme_id")
    served = sme.drop(*FUNDING_ABSENT).withColumns({
        "education_level": F.when(k % 3 != 0, F.col("education_level")),
        "sector": F.when(k % 7 != 0, F.col("sector")),
        "total_payroll": F.when(k % 5 != 0, F.col("total_payroll"))})
    return round_features(EN.encode(served, state, defaults=S.SERVING_DEFAULTS["funding"]), state.feature_names())


HEALTH_SERVED_CTE = ("served", """SELECT * EXCLUDE (business_stage, education_level, location, cash_months),
  'startup' AS business_stage, 'missing' AS location,
  CASE WHEN sme_id % 3 = 0 THEN 'startup' ELSE education_level END AS education_level,
  CASE WHEN sme_id % 4 = 0 THEN 0.0 ELSE cash_months END AS cash_months FROM health""")


@register("p4_p5_serving_health", with_sme(
    O.encode_sql("served", S.HEALTH_FEATURES, SORTED_VOCAB, S.ORDINAL_ORDER, fit_src="health"),
    [HEALTH_CTE, HEALTH_SERVED_CTE]))
def q_serving_health(spark, sf_dir):
    health = _fit_input(health_table(spark, sf_dir), S.HEALTH_FEATURES)
    state = EN.fit_encoder(health, S.HEALTH_FEATURES)
    k = F.col("sme_id")
    served = health.drop("business_stage", "location").withColumns({
        "education_level": F.when(k % 3 != 0, F.col("education_level")),
        "cash_months": F.when(k % 4 != 0, F.col("cash_months"))})
    return round_features(EN.encode(served, state, defaults=S.SERVING_DEFAULTS["health"]), state.feature_names())


@register("p13_funding_rejects", with_sme(
    "SELECT sme_id, 'education_level not in none/highschool/bachelor/master/phd' AS reject_reason FROM sme "
    "WHERE sme_id % 6 = 0"))
def q_funding_rejects(spark, sf_dir):
    """Rows of a funding batch that can't be scored: a given education level that the encoder doesn't know."""
    sme = sme_table(spark, sf_dir)
    state = EN.EncoderState(S.FUNDING_FEATURES, S.ORDINAL_ORDER, unknown_ordinal="error")
    odd = sme.withColumn("education_level", F.when(F.col("sme_id") % 6 == 0, F.lit("diploma"))
                         .otherwise(F.col("education_level")))
    return odd.select("sme_id", EN.unknown_reason(state, odd.columns).alias("reject_reason")).where(
        "reject_reason IS NOT NULL")


UNKNOWN_COLS = S.FUNDING_FEATURES["ordinal"] + S.FUNDING_FEATURES["onehot"]
ODD_CTE = ("odd", """SELECT * EXCLUDE (sector, location, employment_status),
  CASE WHEN sme_id % 9 = 0 THEN 'space' ELSE sector END AS sector,
  CASE WHEN sme_id % 4 = 0 THEN lower(location) ELSE location END AS location,
  CASE WHEN sme_id % 5 <> 0 THEN employment_status END AS employment_status FROM sme""")


@register("q6_unknown_shares", with_sme(" UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count({c}) AS given, count(*) FILTER (WHERE {c} NOT IN "
    f"({', '.join(O.lit(v) for v in S.CATEGORICAL_VOCAB[c])})) AS unknown, count(*) FILTER (WHERE {c} NOT IN "
    f"({', '.join(O.lit(v) for v in S.CATEGORICAL_VOCAB[c])})) / count({c}) AS share FROM odd"
    for c in UNKNOWN_COLS), [ODD_CTE]))
def q_unknown_shares(spark, sf_dir):
    """Share of unknown categories per column, observed while the encoded batch is written."""
    sme = _fit_input(sme_table(spark, sf_dir), S.FUNDING_FEATURES)
    state = EN.fit_encoder(sme, S.FUNDING_FEATURES)
    k = F.col("sme_id")
    odd = sme.withColumns({
        "sector": F.when(k % 9 == 0, F.lit("space")).otherwise(F.col("sector")),
        "location": F.when(k % 4 == 0, F.lower("location")).otherwise(F.col("location")),
        "employment_status": F.when(k % 5 != 0, F.col("employment_status"))})
    seen, watch = JB.observed(odd, EN.unknown_counts(state, odd.columns), f"unknown-{uuid.uuid4().hex}")
    EN.encode(seen, state).write.parquet(scratch_path(spark, f"encoded_{uuid.uuid4().hex}"))
    return JB.unknown_shares(spark, watch)


# ------------------------------------------------------------------ wide vocabularies, widths, types

from bizlens.operators import wide as WD  # noqa: E402


@register("m2_wide_positions", "SELECT l_orderkey, l_linenumber, CAST(dense_rank() OVER (ORDER BY CAST(l_partkey AS VARCHAR)) - 1 "
                               "AS INTEGER) AS position FROM lineitem")
def q_wide_positions(spark, sf_dir):
    """Parts as a category with as many values as there are parts: positions by a join with the stored vocabulary."""
    items = read_table(spark, sf_dir, "lineitem", ["l_orderkey", "l_linenumber", "l_partkey"])
    vocab = WD.fit_vocabulary_table(items, ["l_partkey"], scratch_path(spark, f"vocabulary_{uuid.uuid4().hex}"))
    return WD.with_positions(items, vocab, ["l_partkey"]).select(
        "l_orderkey", "l_linenumber", F.col("l_partkey_position").alias("position"))


GROWTH_NAMES = EN.EncoderState(S.GROWTH_FEATURES, S.ORDINAL_ORDER, {c: SORTED_VOCAB[c] for c in S.GROWTH_FEATURES["onehot"]}
                               ).feature_names()
PADDED, TRIMMED = 120, 40


@register("m6_pad_trim", with_sme(
    f"SELECT sme_id, {PADDED} AS padded_size, {TRIMMED} AS trimmed_size, \"{GROWTH_NAMES[-1]}\" AS last_feature, "
    f"0.0::DOUBLE AS padding, \"{GROWTH_NAMES[TRIMMED - 1]}\" AS last_kept FROM ("
    + O.encode_sql("growth", S.GROWTH_FEATURES, SORTED_VOCAB, S.ORDINAL_ORDER) + ")", [GROWTH_CTE]))
def q_pad_trim(spark, sf_dir):
    """The encoded row as an array, padded with zeros and cut to other widths."""
    growth = _fit_input(growth_table(spark, sf_dir), S.GROWTH_FEATURES)
    state = EN.fit_encoder(growth, S.GROWTH_FEATURES)
    both = growth.select("sme_id", F.array(*EN.encoded_exprs(state)).alias("x")).select(
        "sme_id", EN.pad_trim(F.col("x"), PADDED).alias("p"), EN.pad_trim(F.col("x"), TRIMMED).alias("t"))
    return both.select("sme_id", F.size("p").alias("padded_size"), F.size("t").alias("trimmed_size"),
                       F.bround(F.col("p")[len(state.feature_names()) - 1], 9).alias("last_feature"),
                       F.col("p")[PADDED - 1].alias("padding"), F.bround(F.col("t")[TRIMMED - 1], 9).alias("last_kept"))


@register("a10_type_counts", with_sme(" UNION ALL ".join(
    f"SELECT '{SPARK_TYPE_NAMES[t]}' AS data_type, {n} AS columns, COUNT(*) AS rows FROM sme"
    for t, n in sorted({repr(f.dataType): sum(g.dataType == f.dataType for g in S.SME_TABLE_SCHEMA.fields)
                        for f in S.SME_TABLE_SCHEMA.fields}.items()))))
def q_type_counts(spark, sf_dir):
    return PR.type_counts(sme_table(spark, sf_dir))


# ------------------------------------------------------------------ metrics of real pairs, repairs of bad cells, given ratios

SIZE_PAIR_CTE = ("pair", f"SELECT *, {O.cut('revenue_6m_ago', *FT.REVENUE_SIZE)} AS size_before FROM growth")


@register("m18_size_confusion", with_sme(" UNION ALL ".join(
    f"SELECT {i} AS position, '{a}' AS label, " + ", ".join(
        f"COUNT(*) FILTER (WHERE current_revenue_category = '{a}' AND size_before = '{b}') AS \"pred_{b}\""
        for b in S.SIZE_CATEGORIES) + " FROM pair"
    for i, a in enumerate(S.SIZE_CATEGORIES)), [GROWTH_CTE, SIZE_PAIR_CTE]))
def q_size_confusion(spark, sf_dir):
    """The size category now against that of the period before, as a forecast of no change."""
    pair = growth_table(spark, sf_dir).withColumn("size_before", FT.cut("revenue_6m_ago", *FT.REVENUE_SIZE))
    return MT.confusion_matrix(pair, "current_revenue_category", "size_before", S.SIZE_CATEGORIES)


@register("m19_persistence_metrics", with_sme(
    "SELECT round_even(sqrt(avg((revenue - revenue_6m_ago) * (revenue - revenue_6m_ago))), 6) AS rmse, "
    "round_even(avg(abs(revenue - revenue_6m_ago)), 6) AS mae, "
    "round_even(1 - SUM((revenue - revenue_6m_ago) * (revenue - revenue_6m_ago)) / "
    "SUM((revenue - (SELECT avg(revenue) FROM sme)) * (revenue - (SELECT avg(revenue) FROM sme))), 9) AS r2, "
    "COUNT(*) AS rows FROM sme"))
def q_persistence_metrics(spark, sf_dir):
    """Revenue against that of the period before, as a forecast of no change."""
    m = MT.regression_metrics(sme_table(spark, sf_dir), "revenue", "revenue_6m_ago")
    return round_features(round_features(m, ["rmse", "mae"], 6), ["r2"])


BAD = {"revenue": "NaN", "marketing_roi": "Infinity", "cash_runway_months": "-Infinity"}     # by key: column -> bad cell


@register("p10_p11_injected", with_sme("SELECT sme_id, " + ", ".join(
    f"CASE WHEN sme_id % {5 + i} = 0 THEN 0.0 ELSE {c} END AS {c}" for i, c in enumerate(BAD))
    + ", CASE sme_id % 8 WHEN 0 THEN 0.5 WHEN 1 THEN 1.0 WHEN 2 THEN 0.0 WHEN 3 THEN 0.5 "
      "ELSE predicted_6m_growth_rate END AS predicted_6m_growth_rate FROM growth", [GROWTH_CTE]))
def q_injected(spark, sf_dir):
    """P10 and P11 on a table with NaN, infinite and null cells."""
    k = F.col("sme_id")
    rate, cell = F.col("predicted_6m_growth_rate"), lambda v: F.lit(float(v.replace("Infinity", "inf")))
    bad = growth_table(spark, sf_dir).withColumns({
        **{c: F.when(k % (5 + i) == 0, cell(v)).otherwise(F.col(c)) for i, (c, v) in enumerate(BAD.items())},
        "predicted_6m_growth_rate": F.when(k % 8 == 0, cell("NaN")).when(k % 8 == 1, cell("Infinity"))
        .when(k % 8 == 2, cell("-Infinity")).when(k % 8 != 3, rate)})
    out = QL.repair_columns(QL.clean_columns(bad, list(BAD)), ["predicted_6m_growth_rate"])
    return out.select("sme_id", *BAD, "predicted_6m_growth_rate")


@register("hf19_given_ratios", with_sme("SELECT CAST(sme_id AS VARCHAR) AS sme_id, " + ", ".join(
    {"conversion_rate": "CASE WHEN sme_id % 3 = 0 THEN 0.5 ELSE conversion_rate END AS conversion_rate",
     "missing_docs": "CASE WHEN sme_id % 4 = 0 THEN 1 ELSE missing_docs END AS missing_docs"}.get(c, c)
    for c in HF19_COLS) + " FROM health", [HEALTH_CTE]))
def q_given_ratios(spark, sf_dir):
    """Requests that bring some ratios and flags of their own: these are kept, the others computed."""
    k = F.col("sme_id")
    given = sme_table(spark, sf_dir).withColumns({"conversion_rate": F.when(k % 3 == 0, F.lit(0.5)),
                                                  "missing_docs": F.when(k % 4 == 0, F.lit(1))})
    valid, _ = RQ.split_requests(RQ.parse_requests(RQ.request_json(given)))
    return RQ.fill_flags(RQ.fill_ratios(valid)).select("sme_id", *HF19_COLS)


# ------------------------------------------------------------------ summaries and stored results


def _summary(spark, decisions: DataFrame, metrics, name: str) -> DataFrame:
    """Write the decisions; their summary comes out of the same pass."""
    seen, watch = JB.observed(decisions, metrics, f"{name}-{uuid.uuid4().hex}")
    seen.write.parquet(scratch_path(spark, f"{name}_{uuid.uuid4().hex}"))
    return JB.summary_table(spark, watch).withColumn("value", F.bround("value", 6))


def _summary_sql(src: str, metrics: dict[str, str]) -> str:
    return " UNION ALL ".join(f"SELECT '{k}' AS metric, round_even(CAST({v} AS DOUBLE), 6) AS value FROM ({src})"
                              for k, v in metrics.items())


@register("m20_growth_summary", with_sme(_summary_sql(O.growth_decisions_sql("growth"), {
    "rows": "count(*)",
    **{f"stage: {s}": f"count(*) FILTER (WHERE growth_stage = '{s}')" for s in S.GROWTH_STAGES},
    **{f"action: {a}": f"count(*) FILTER (WHERE growth_action = '{a}')"
       for a in [n for _, n in D.GROWTH_ACTIONS] + [D.GROWTH_ACTION_ELSE]},
    "jumps": "sum(will_jump_category)", "jump share": "avg(will_jump_category)",
    "mean rate": "avg(predicted_6m_growth_rate)", "median rate": "median(predicted_6m_growth_rate)"}), [GROWTH_CTE]))
def q_growth_summary(spark, sf_dir):
    return _summary(spark, D.growth_decisions(growth_table(spark, sf_dir)), JB.growth_summary(), "growth_summary")


@register("m20_health_summary", with_sme(_summary_sql(O.health_decisions_sql("health"), {
    "rows": "count(*)",
    **{f"category: {c}": f"count(*) FILTER (WHERE health_category = '{c}')" for c in S.HEALTH_CATEGORIES},
    "flags: 0": "count(*) FILTER (WHERE total_risk_flags = 0)",
    "flags: 1-2": "count(*) FILTER (WHERE total_risk_flags BETWEEN 1 AND 2)",
    "flags: 3+": "count(*) FILTER (WHERE total_risk_flags >= 3)"}), [HEALTH_CTE]))
def q_health_batch_summary(spark, sf_dir):
    return _summary(spark, D.health_decisions(health_table(spark, sf_dir)), JB.health_summary(), "health_summary")


DECISION_INPUT = ["sme_id", "revenue", "health_category", *S.RISK_FLAG_COLS, "predicted_6m_growth_rate", "growth_stage",
                  "will_jump_category", "current_revenue_category", "composite_growth_score", "eligible_for_funding",
                  "business_health_score", "default_risk_score"]


@register("j3_stored_results", with_sme(
    f"SELECT h.sme_id, health_category, total_risk_flags, growth_stage, growth_action, compliance_risk, reasons "
    f"FROM ({O.health_decisions_sql('health')}) h JOIN ({O.growth_decisions_sql('growth')}) g USING (sme_id) "
    f"JOIN ({O.compliance_decisions_sql('sme')}) c USING (sme_id)", [HEALTH_CTE, GROWTH_CTE], keep_scores=True))
def q_stored_results(spark, sf_dir):
    """Three result tables of one stored input, each stored bucketed by business, joined without a shuffle."""
    rows = stored(JB.all_features(sme_table(spark, sf_dir, keep_scores=True)).select(DECISION_INPUT), "decision_input")
    made = {"health": D.health_decisions(rows), "growth": D.growth_decisions(rows),
            "compliance": D.compliance_decisions(rows, "default_risk_score")}
    run = uuid.uuid4().hex
    tables = {n: JB.store_result(df, f"result_{n}_{run}", scratch_path(spark, f"result_{n}_{run}")) for n, df in made.items()}
    return JB.combine_stored(tables).select(
        "sme_id", "health.health_category", "health.total_risk_flags", "growth.growth_stage", "growth.growth_action",
        "compliance.compliance_risk", "compliance.reasons")


# ------------------------------------------------------------------ checks of the models that SQL can state


def _as_many_rows(*zero: str) -> str:
    """What a check must give: a row for each business, and none with a fault."""
    return "SELECT COUNT(*) AS rows, " + ", ".join(f"CAST(0 AS BIGINT) AS {z}" for z in zero) + " FROM customer"


@register("m12_probability_check", _as_many_rows("bad_sums", "other_labels"))
def q_probability_check(spark, sf_dir):
    """Four-class boosting: probabilities sum to 1 and the label is the likeliest class's."""
    bundle = bundles_for(spark, sf_dir)["health"]
    p = bundle.predict(health_table(spark, sf_dir))
    prob = F.col("pred_health_category_probability")
    labels = F.array(*[F.lit(v) for v in bundle.labels["health_category"]])
    best = F.element_at(labels, F.array_position(prob, F.array_max(prob)).cast("int"))
    total = F.aggregate(prob, F.lit(0.0), lambda a, x: a + x)
    return p.agg(F.count("*").alias("rows"), F.count_if(F.abs(total - 1) > 1e-9).alias("bad_sums"),
                 F.count_if(~F.col("pred_health_category").eqNullSafe(best)).alias("other_labels"))


@register("s3_reload_check", _as_many_rows("other_scores"))
def q_reload_check(spark, sf_dir):
    """Every model's scores are the same after the bundles are saved and loaded once more."""
    bundles = bundles_for(spark, sf_dir)
    again = {}
    for name, b in bundles.items():
        path = scratch_path(spark, f"reload_{name}_{uuid.uuid4().hex}")
        b.save(spark, path)
        again[name] = MD.Bundle.load(spark, path)
    sme = sme_table(spark, sf_dir)
    a, b = (JB.score_all(x, sme).select("sme_id", F.to_json(F.struct("growth", "health", "funding", "compliance")).alias(n))
            for x, n in ((bundles, "kept"), (again, "loaded")))
    return a.join(b, "sme_id", "left").agg(F.count("*").alias("rows"),
                                           F.count_if(~F.col("kept").eqNullSafe(F.col("loaded"))).alias("other_scores"))


@register("m20_decision_check", _as_many_rows("other_levels", "other_actions"))
def q_decision_check(spark, sf_dir):
    """Levels, reasons and actions of the batch jobs follow from the models' scores of the same rows."""
    bundles, sme = bundles_for(spark, sf_dir), sme_table(spark, sf_dir)
    fund = bundles["funding"].add_predictions(sme)
    level, reasons = D.compliance(bundles["funding"].probability_of("default_risk", JB.RISK_CLASS),
                                  F.col("pred_eligibility") == 1, "pred_business_health")
    own = fund.select("sme_id", F.concat_ws("|", level, reasons).alias("own_level"))
    rate = bundles["growth"].predict(growth_table(spark, sf_dir)).select("sme_id", D.growth_action("pred_growth_rate").alias("own_action"))
    done = JB.score_compliance(bundles["funding"], sme).select("sme_id", F.concat_ws("|", "compliance_risk", "reasons").alias("level"))
    acts = JB.score_growth(bundles["growth"], sme).select("sme_id", "growth_action")
    both = done.join(own, "sme_id", "left").join(acts, "sme_id", "left").join(rate, "sme_id", "left")
    return both.agg(F.count("*").alias("rows"), F.count_if(~F.col("level").eqNullSafe(F.col("own_level"))).alias("other_levels"),
                    F.count_if(~F.col("growth_action").eqNullSafe(F.col("own_action"))).alias("other_actions"))


@register("st1_stream_check", _as_many_rows("other_results"))
def q_stream_check(spark, sf_dir):
    """Streamed results are those of the batch over the same requests."""
    bundles = bundles_for(spark, sf_dir)
    streamed = q_stream_scores(spark, sf_dir).withColumnRenamed("result", "streamed")
    valid, _ = RQ.split_requests(parsed_requests(spark, sf_dir))
    batch = ST.result_json(ST.score_requests(bundles, valid))
    return batch.join(streamed, "sme_id", "left").agg(
        F.count("*").alias("rows"), F.count_if(~F.col("result").eqNullSafe(F.col("streamed"))).alias("other_results"))
