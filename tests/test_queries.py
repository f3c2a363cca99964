"""Every query of the catalogue against its SQL on the smallest tables."""

import glob
import os

import pytest

from lexisift import catalog

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


@pytest.mark.parametrize("name", sorted(catalog.core_queries()))
def test_query(spark, name):
    import duckdb

    df = catalog.core_queries()[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    sql = catalog.core_oracle().get(name)
    if sql is None:
        assert catalog.core_without_sql()[name] and df.columns
        return
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    res = con.sql(sql)
    assert sorted(res.columns) == columns
    at = [res.columns.index(c) for c in columns]
    assert got == sorted((tuple(plain(r[i]) for i in at) for r in res.fetchall()), key=repr)
