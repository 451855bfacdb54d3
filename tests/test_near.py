"""All near pairs, against brute force."""

import random

import duckdb
import numpy as np
import pytest

from presswork.operators import near
from presswork.plans import catalog
from presswork.plans.fixtures import duck_view


def brute(codes, bits=3):
    c = np.unique(np.array(codes, np.int64))
    d = np.bitwise_count((c[:, None] ^ c[None, :]).view(np.uint64))
    a, b = np.nonzero(np.triu(d <= bits, 1))
    return sorted(zip(c[a].tolist(), c[b].tolist(), d[a, b].tolist()))


@pytest.mark.parametrize("bits, hot", [(1, 1024), (2, 1024), (3, 1024), (3, 20), (3, 1)])
def test_every_pair_once_whatever_the_bucket_size(spark, bits, hot):
    r = random.Random(5)
    codes = [r.getrandbits(6) | r.getrandbits(5) << 30 for _ in range(300)]
    for _ in range(60):
        x = r.getrandbits(64)
        codes += [x, x ^ 1 << r.randrange(64), x ^ (1 << r.randrange(64) | 1 << r.randrange(64) | 1 << r.randrange(64)), r.getrandbits(64)]
    codes = [x - (1 << 64) if x >> 63 else x for x in codes]
    df = spark.createDataFrame([(x,) for x in codes] * 2 + [(None,)], "simhash long")
    got = sorted(tuple(x) for x in near.near_pairs(df, bits, hot).collect())
    assert len(got) > 50 and got == brute(codes, bits)


def test_the_whole_view_gives_its_pairs(spark):
    folder = "/root/testdata/sf0.01"
    got = sorted((x.a, x.b, x.distance) for x in catalog.QUERIES["dedup_near_all"](spark, folder).collect())
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{folder}/documents.parquet')")
    codes = [x for (x,) in con.execute(f"SELECT simhash FROM ({duck_view('canonical_record')})").fetchall()]
    assert got == brute(codes) and got
