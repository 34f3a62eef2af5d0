"""Every query of the catalog against its SQL, on the smallest tables."""

import os

import duckdb
import pytest

from voxelframe.plans import catalog

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{DATA}/{f}')")
    return con


def plain(v):
    return None if v is None or v != v else float(v) + 0.0 if isinstance(v, (int, float)) else v


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query(spark, con, name):
    df = catalog.QUERIES[name](spark, DATA)
    cur = con.execute(catalog.ORACLES[name])
    names = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(names)
    want = sorted((tuple(plain(r[names.index(c)]) for c in sorted(names)) for r in cur.fetchall()), key=str)
    got = sorted((tuple(plain(r[c]) for c in sorted(names)) for r in df.collect()), key=str)
    assert got == want


def test_contract(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    queries = entry.queries()
    assert set(entry.oracle_sql()) <= set(queries) and set(catalog.QUERIES) <= set(queries)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_runs(spark, name):
    assert catalog.QUERIES[name](spark, DATA).count() > 0
