"""Every query with a SQL counterpart gives the same rows on both engines, and some rows."""

import math
import os
from decimal import Decimal

import duckdb
import pytest

from presswork.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    sf = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.01")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con, sf


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    return f"{float(v):.9g}" if isinstance(v, Decimal) else str(v)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query(spark, duck, name):
    con, sf = duck
    df = catalog.QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    assert got
    res = con.execute(catalog.SQL[name])
    names = [x[0] for x in res.description]
    assert sorted(names) == columns
    want = sorted(tuple(plain(dict(zip(names, r))[c]) for c in columns) for r in res.fetchall())
    assert got == want
