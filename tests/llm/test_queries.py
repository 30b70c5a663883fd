"""All queries over empty tables, over rows of nulls, and over the smallest test tables."""

import glob
import os

import pytest

from lexigraph.llm import queries
from lexigraph.plans import general

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
TABLES = ("digimon", "digimon_alias", "manual_aliases", "evolution_edge", "source_digimon", "digimon_snapshot", "canonical_term", "documents", "catalog_snapshot")


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    """Empty tables, and tables of two rows of nulls (the reference list stays as it is)."""
    empty, nulls = tmp_path_factory.mktemp("empty"), tmp_path_factory.mktemp("nulls")
    for t in TABLES:
        df = spark.read.parquet(f"{DATA}/{t}.parquet")
        df.limit(0).coalesce(1).write.parquet(f"{empty}/{t}.parquet")
        rows = df if t == "canonical_term" else spark.createDataFrame([tuple([None] * len(df.columns))] * 2, df.schema)
        rows.coalesce(1).write.parquet(f"{nulls}/{t}.parquet")
    return str(empty), str(nulls)


ALL = {**queries.QUERIES, **{k: v for k, v in general.QUERIES.items() if k.startswith("p")}}


@pytest.mark.parametrize("name", sorted(ALL))
def test_empty_and_nulls(spark, folders, name):
    empty, nulls = folders
    assert ALL[name](spark, empty).count() == 0
    got = ALL[name](spark, nulls).collect()
    if name.endswith("_found"):
        assert got == []


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_against_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for p in glob.glob(DATA + "/*.parquet"):
        con.sql(f"create view {os.path.basename(p)[:-8]} as select * from read_parquet('{p}')")
    df, rel = queries.QUERIES[name](spark, DATA), con.sql(queries.SQL[name])
    at = [df.columns.index(c) for c in rel.columns]
    assert sorted(tuple(r[i] for i in at) for r in df.collect()) == sorted(rel.fetchall())


def test_columns(spark):
    want = {
        "p1_found": ["field", "row_id", "position", "term_id"], "p2_found": ["ordinal_a", "ordinal_b"], "p3_found": ["group_id", "field", "digimon_id"],
        "p5_found": ["alias_table", "alias_id", "digimon_id"], "p8_ids": ["doc_id", "ids"], "p10_found": ["doc_id"],
    }
    for name, columns in want.items():
        df = queries.QUERIES[name](spark, DATA)
        assert df.columns == columns
        if name.endswith("_found"):
            assert df.count() == df.distinct().count() > 0
