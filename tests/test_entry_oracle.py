"""Driver contract and the DuckDB oracle on the smallest tables."""

import math

import duckdb
import pytest

import __spark_entry__ as E
from bizlens.sources.tables import DRIVER_TABLES
from tests.conftest import SF001

MODEL_FREE = [n for n in E.oracle_sql()]


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns == ["rank", "health_category", "businesses", "flags_0", "flags_1_2", "flags_3_plus"]
    rows = df.collect()
    assert [r.health_category for r in rows] == ["Critical", "At Risk", "Stable", "Thriving"]
    assert sum(r.businesses for r in rows) == sum(r.flags_0 + r.flags_1_2 + r.flags_3_plus for r in rows)


def test_every_oracle_has_a_query():
    assert set(E.oracle_sql()) <= set(E.queries())


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in DRIVER_TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF001}/{t}.parquet')")
    return con


def _norm(rows):
    def key(r):
        return tuple((v is None, str(v)) for v in r)
    return sorted(rows, key=key)


@pytest.mark.parametrize("name", MODEL_FREE)
def test_oracle(spark, duck, name):
    df = E.queries()[name](spark, SF001)
    rel = duck.sql(E.oracle_sql()[name])
    assert sorted(df.columns) == sorted(rel.columns)
    order = sorted(df.columns)
    s = _norm([tuple(r[c] for c in order) for r in df.collect()])
    d = [dict(zip(rel.columns, r)) for r in rel.fetchall()]
    d = _norm([tuple(r[c] for c in order) for r in d])
    assert len(s) == len(d)
    for a, b in zip(s, d):
        for x, y in zip(a, b):
            if isinstance(x, float) and isinstance(y, float) and math.isnan(x):
                assert math.isnan(y)
            else:
                assert x == y, (name, a, b)
