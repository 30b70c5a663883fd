"""Every core query against its SQL on the smallest test tables."""

import datetime
import decimal
import glob
import os

import pytest

from lexigraph.plans import registry

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
duckdb = pytest.importorskip("duckdb")


def norm(v):
    if isinstance(v, (float, decimal.Decimal)):
        return round(float(v), 6)
    return v.replace(tzinfo=None) if isinstance(v, datetime.datetime) else v


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in glob.glob(DATA + "/*.parquet"):
        c.sql(f"create view {os.path.basename(p)[:-8]} as select * from read_parquet('{p}')")
    return c


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_against_sql(spark, con, name):
    df, rel = registry.QUERIES[name](spark, DATA), con.sql(registry.SQL[name])
    assert sorted(df.columns) == sorted(rel.columns)
    at = [df.columns.index(c) for c in rel.columns]
    got = sorted((tuple(norm(r[i]) for i in at) for r in df.collect()), key=repr)
    assert got == sorted((tuple(map(norm, r)) for r in rel.fetchall()), key=repr)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_runs(spark, name):
    registry.QUERIES[name](spark, DATA).collect()
