"""Plan properties that must hold at any scale."""

import __spark_entry__ as E
import pytest

from bizlens.plans import catalog as C
from tests.conftest import SF001

# these score the four-class boosted model, an Arrow-batched expression
SCORES_BOOSTED = {"m12_probability_check", "s3_reload_check", "st1_stream_check", "m20_decision_check"}
FORBIDDEN = ["BatchEvalPython", "ArrowEvalPython", "CartesianProduct", "BroadcastNestedLoopJoin"]


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_python_udfs_or_pairwise_joins(spark):
    for name in E.oracle_sql():
        plan = _plan(E.queries()[name](spark, SF001))
        bad = [op for op in FORBIDDEN if op in plan and not (op == "ArrowEvalPython" and name in SCORES_BOOSTED)]
        assert not bad, (name, bad)


def test_profile_scans_are_pruned_and_filtered(spark):
    df = E.queries()["s6_profile"](spark, SF001)
    plan = df._jdf.queryExecution().executedPlan().toString()
    schemas = [line.split("ReadSchema: ")[1] for line in plan.splitlines() if "ReadSchema: " in line]
    lineitem = [s for s in schemas if s.startswith("struct<l_orderkey")]
    assert lineitem and all(c not in lineitem[0] for c in ("l_linenumber", "l_shipdate", "l_suppkey"))
    assert "struct<user_id:bigint,event_type:string,props:string>" in schemas
    assert "struct<o_orderkey:bigint,o_custkey:bigint,o_orderdate:timestamp_ntz>" in schemas
    # the columns that the profile reports on are read from their tables
    scans = [line.split("FileScan parquet [")[1].split("]")[0] for line in plan.splitlines() if "FileScan parquet [" in line]
    assert not any(c in scan for scan in scans for c in ("l_linenumber", "l_shipdate", "l_suppkey"))
    for column in ("l_quantity", "l_tax", "o_orderpriority", "o_totalprice", "props", "c_nationkey", "n_regionkey"):
        assert any(f"{column}#" in scan for scan in scans), column
    assert "In(event_type, [click,purchase,view]" in plan


def test_stored_results_join_without_a_shuffle(spark, tmp_path):
    from pyspark.sql import functions as F
    from bizlens.plans import jobs as J
    made = {"a": spark.range(500).select(F.col("id").alias("sme_id"), (F.col("id") * 2).alias("x")),
            "b": spark.range(0, 500, 2).select(F.col("id").alias("sme_id"), F.lit("y").alias("y"))}
    stored = {n: J.store_result(df, f"plan_test_{n}", str(tmp_path / n), buckets=4) for n, df in made.items()}
    both = J.combine_stored(stored)
    rows = {r.sme_id: r for r in both.collect()}
    assert "Exchange" not in both._jdf.queryExecution().executedPlan().toString()
    assert len(rows) == 500 and rows[4].a.x == 8 and rows[4].b.y == "y" and rows[3].b is None
    for n in made:
        spark.sql(f"DROP TABLE plan_test_{n}")


def test_rejected_rows_leave_the_others_scored(spark):
    from pyspark.sql import functions as F
    from bizlens import schema as S
    from bizlens.operators import encode as EN
    spec = {"ordinal": ["education_level"], "onehot": [], "numeric": [], "binary": []}
    state = EN.EncoderState(spec, {"education_level": S.EDUCATION_LEVELS}, unknown_ordinal="error")
    df = spark.createDataFrame([(1, "phd"), (2, None), (3, "diploma")], "sme_id long, education_level string")
    reason = {r[0]: r[1] for r in df.select("sme_id", EN.unknown_reason(state, df.columns)).collect()}
    assert reason == {1: None, 2: None, 3: "education_level not in none/highschool/bachelor/master/phd"}
    got = {r[0]: r[1] for r in EN.encode(df, state, defaults=S.SERVING_DEFAULTS["funding"]).collect()}
    assert got == {1: 4.0, 2: 0.0, 3: -1.0}
    absent = df.select("sme_id").withColumn("one", F.lit(1))
    assert {r[1] for r in EN.encode(absent, state, defaults=S.SERVING_DEFAULTS["funding"]).collect()} == {0.0}


@pytest.mark.parametrize("name", ["m1_m5_encoded_growth", "m1_m5_encoded_health", "m1_m5_encoded_funding", "p4_p5_serving_features",
                                  "p4_p5_serving_health", "p4_p5_serving_funding", "m6_pad_trim"])
def test_a_fitted_encoder_reads_the_stored_profile_again_not_the_facts(spark, name):
    read = C.QUERIES[name](spark, SF001).inputFiles()
    assert read and not any("lineitem" in f or "orders" in f for f in read)


def test_stored_results_come_from_one_profile(spark, monkeypatch):
    read, store = [], C.JB.store_result
    monkeypatch.setattr(C.JB, "store_result", lambda df, *a, **k: read.append(df.inputFiles()) or store(df, *a, **k))
    assert C.QUERIES["j3_stored_results"](spark, SF001).count() == 150
    assert len(read) == 3 and all(r and sorted(r) == sorted(read[0]) for r in read)
    assert not any("lineitem" in f for f in read[0])
