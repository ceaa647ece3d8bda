"""Every query with a SQL twin gives the twin's rows on the smallest tables."""

import os

import duckdb
import pytest

from voltledger.plans import registry

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")


@pytest.fixture(scope="module")
def other():
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for f in os.listdir(DATA):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    return c


def plain(x):
    return f"{x:.9g}" if isinstance(x, float) else str(x)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_same_rows(spark, other, name):
    df = registry.QUERIES[name](spark, DATA)
    got = sorted(tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect())
    assert name in registry.ORACLE_SQL
    res = other.execute(registry.ORACLE_SQL[name])
    names = [d[0] for d in res.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    want = sorted(tuple(plain(r[i]) for i in order) for r in res.fetchall())
    assert sorted(names) == sorted(df.columns)
    assert got == want


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_plans_stay_native(spark, name):
    plan = registry.QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "CartesianProduct" not in plan and "Arrow" not in plan
