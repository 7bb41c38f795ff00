"""The profile under skew: a hot customer and a hot order key, forced sort-merge joins with AQE skew splits."""

import math
import os
import tempfile

import duckdb
from pyspark.sql import functions as F

from bizlens.functions.exprs import hash01
from bizlens.plans import oracle as O
from bizlens.sources.profile import monthly_series, profile_from_frames
from bizlens.sources.tables import read_table
from tests.conftest import SF001


def test_profile_with_hot_keys_matches_sql(spark):
    base = tempfile.mkdtemp(prefix="bizlens-skew-")
    orders = read_table(spark, SF001, "orders")
    lineitem = read_table(spark, SF001, "lineitem")
    hot_order = orders.agg(F.min("o_orderkey")).first()[0]
    # a third of all orders belong to customer 1; a third of all line items to one order
    orders = orders.withColumn("o_custkey", F.when(hash01("o_orderkey", "skew") < 1 / 3, F.lit(1))
                               .otherwise(F.col("o_custkey")))
    lineitem = lineitem.withColumn("l_orderkey", F.when(hash01("l_orderkey", "skew2") < 1 / 3,
                                                        F.lit(hot_order)).otherwise(F.col("l_orderkey")))
    for name, df in [("orders", orders), ("lineitem", lineitem),
                     ("customer", read_table(spark, SF001, "customer")),
                     ("events", read_table(spark, SF001, "events")),
                     ("nation", read_table(spark, SF001, "nation"))]:
        df.repartition(6).write.parquet(os.path.join(base, f"{name}.parquet"))

    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1",
            "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k",
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k"}
    old = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        got = profile_from_frames(*[spark.read.parquet(os.path.join(base, f"{t}.parquet"))
                                    for t in ("customer", "orders", "lineitem", "events", "nation")])
        srows = sorted(tuple(r) for r in got.collect())
        plan = got._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)

    con = duckdb.connect()
    for t in ("customer", "orders", "lineitem", "events", "nation"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{base}/{t}.parquet/*.parquet')")
    rel = con.sql(O.profile_sql())
    order = [rel.columns.index(c) for c in got.columns]
    drows = sorted(tuple(r[i] for i in order) for r in rel.fetchall())
    assert "BroadcastHashJoin" not in plan
    assert "skew=true" in plan           # AQE split the hot partitions
    assert len(srows) == len(drows)
    hot = [r for r in srows if r[0] == 1][0]
    assert hot[got.columns.index("total_customers")] > 0
    for a, b in zip(srows, drows):
        for x, y in zip(a, b):
            assert x == y or (isinstance(x, float) and math.isclose(x, y, rel_tol=0, abs_tol=0)), (a, b)


def test_monthly_series_with_a_hot_customer_matches_sql(spark):
    """A third of all orders are one customer's; each business still has a row for every month."""
    base = tempfile.mkdtemp(prefix="bizlens-months-")
    orders = read_table(spark, SF001, "orders").withColumn(
        "o_custkey", F.when(hash01("o_orderkey", "skew") < 1 / 3, F.lit(1)).otherwise(F.col("o_custkey")))
    frames = {"customer": read_table(spark, SF001, "customer"), "orders": orders,
              "lineitem": read_table(spark, SF001, "lineitem")}
    con = duckdb.connect()
    for name, df in frames.items():
        df.repartition(5).write.parquet(os.path.join(base, f"{name}.parquet"))
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{base}/{name}.parquet/*.parquet')")
    for first, last, trailing in (("1996-01", "1997-12", 6), ("1995-01", "1995-03", 3)):
        got = monthly_series(*[spark.read.parquet(os.path.join(base, f"{t}.parquet")) for t in frames], first, last, trailing)
        rel = con.sql(O.monthly_series_sql(first, last, trailing))
        order = [rel.columns.index(c) for c in got.columns]
        rows = sorted(tuple(r) for r in got.select("sme_id", "month", "revenue", "trailing_revenue", "previous_revenue").collect())
        assert rows == sorted(tuple(r[i] for i in order[:5]) for r in rel.fetchall())
        months = (int(last[:4]) - int(first[:4])) * 12 + int(last[5:]) - int(first[5:]) + 1
        assert len(rows) == frames["customer"].count() * months
