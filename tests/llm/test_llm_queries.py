import glob
import os

import pytest

from lexisift.llm import queries

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
COLUMNS = {"p1_found": ["file_id"], "p2_found": ["field_name", "rec_id", "kind"], "p3_found": ["request_id_a", "request_id_b"], "p4_found": ["file_id"], "p5_found": ["tab", "rec_id", "line_no"], "p6_found": ["file_id"], "p10_found": ["doc_id"]}


def plain(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, name):
    import duckdb

    df = queries.QUERIES[name](spark, DATA)
    rows = df.collect()
    assert rows
    if name in COLUMNS:
        assert df.columns == COLUMNS[name] and len(set(rows)) == len(rows)
    sql = queries.ORACLE.get(name)
    if sql is None:
        assert queries.NO_SQL[name]
        return
    con = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    res = con.sql(sql)
    assert sorted(res.columns) == sorted(df.columns)
    at = [res.columns.index(c) for c in df.columns]
    assert sorted((tuple(map(plain, r)) for r in rows), key=repr) == sorted((tuple(plain(r[i]) for i in at) for r in res.fetchall()), key=repr)


def test_pairs_are_the_links_of_the_classes(spark):
    rows = queries.p3_classes(spark, DATA).collect()
    ids = {}
    for r in rows:
        ids.setdefault(r["class"], set()).add(r["request_id"])
    linked = {frozenset((r[0], r[1])) for r in queries.p3_found(spark, DATA).collect()}
    assert linked and all(any(pair <= group for group in ids.values()) for pair in linked)
    assert {x for pair in linked for x in pair} == set().union(*ids.values())
