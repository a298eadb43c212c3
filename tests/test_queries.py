"""Every query of the surveillance operators against its SQL, on the smallest tables."""

import importlib
import os

import duckdb
import pytest

from signalwatch.plans import PLANS

SF = "/root/testdata/sf0.001"
PLAN = [importlib.import_module(f"signalwatch.plans.{p}") for p in PLANS]
QUERIES = {k: v for p in PLAN for k, v in p.QUERIES.items()}
ORACLES = {k: v for p in PLAN for k, v in p.ORACLES.items()}


def text(x):
    if isinstance(x, bool) or x is None:
        return str(x)
    return format(float(x), ".6f") if isinstance(x, (int, float)) or type(x).__name__ == "Decimal" else str(x)


def rows(values, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(text(r[i]) for i in order) for r in values)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    got = [tuple(r) for r in df.collect()]
    if name in ORACLES:
        cur = duck.execute(ORACLES[name])
        names = [c[0] for c in cur.description]
        assert sorted(df.columns) == sorted(names)
        assert rows(got, df.columns) == rows(cur.fetchall(), names)
    spark.catalog.clearCache()
