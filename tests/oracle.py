"""Compares a query with its SQL over the same tables."""

import glob
import math
import os

import duckdb

DATA = os.environ.get("STANZAFLOW_TESTDATA", "/root/testdata/sf0.001")


def connect(d: str):
    c = duckdb.connect()
    for p in glob.glob(f"{d}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}{'/*' if os.path.isdir(p) else ''}')")
    return c


def rows(cols, data):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    norm = lambda x: None if isinstance(x, float) and math.isnan(x) else round(x, 5) + 0.0 if isinstance(x, float) else x
    return sorted(cols), sorted((tuple(norm(r[i]) for i in order) for r in data), key=repr)


def same(spark, query, sql: str, d: str = DATA) -> None:
    df = query(spark, d)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    rel = connect(d).sql(sql)
    want = rows(rel.columns, rel.fetchall())
    assert got[0] == want[0]
    assert len(got[1]) == len(want[1])
    for a, b in zip(got[1], want[1]):
        for x, y in zip(a, b):
            assert x == y or (isinstance(x, float) and isinstance(y, float) and abs(x - y) < 2e-5), (a, b)
