"""Leaders and followers against plain loops."""

import math
import random

import pytest

from presswork.operators import clusters
from presswork.plans import catalog


def cosine(a, b):
    if a is None or b is None or len(a) != len(b):
        return None
    x, y = math.sqrt(sum(v * v for v in a)), math.sqrt(sum(v * v for v in b))
    return round(sum(p * q for p, q in zip(a, b)) / x / y, 9) if x and y else None


def slow_follow(rows, least):
    out, leaders = {}, {}
    for block, i, v in sorted(rows, key=lambda r: (r[0], r[1])):
        near = [(c, -j) for j, w in leaders.get(block, []) if (c := cosine(v, w)) is not None and c >= least]
        if near:
            out[i] = -max(near)[1]
        else:
            out[i] = i
            if v and any(v):
                leaders.setdefault(block, []).append((i, v))
    return out


def vectors(n, seed, width=4):
    rnd = random.Random(seed)
    base = [[rnd.gauss(0, 1) for _ in range(width)] for _ in range(6)]
    rows = [(rnd.randrange(3), i, [x + rnd.gauss(0, 0.3) for x in rnd.choice(base)]) for i in range(n)]
    return rows + [(0, n, None), (1, n + 1, [0.0] * width), (2, n + 2, None)]


def test_followers_and_reconcile(spark):
    rows = vectors(300, 1)
    df = spark.createDataFrame(rows, "block long, article_id long, vector array<double>").repartition(3)
    found = clusters.follow(df)
    want = slow_follow(rows, clusters.FOLLOW)
    assert {r.article_id: r.leader_id for r in found.collect()} == want
    met = slow_follow([(0, i, v) for _, i, v in rows if want[i] == i], clusters.FOLLOW)
    got = {r.article_id: r.leader_id for r in clusters.reconcile(found, df).collect()}
    assert got == {i: met[want[i]] for i in want}
    assert clusters.follow(df.limit(0)).count() == 0


@pytest.mark.parametrize("block", [4096, 3])
def test_nearest_leader(spark, monkeypatch, block):
    monkeypatch.setattr(clusters, "BLOCK", block)
    rows = vectors(60, 2)
    df = spark.createDataFrame([(i, v) for _, i, v in rows], "article_id long, vector array<double>")
    leaders = [(i, v) for _, i, v in rows[:8]] + [(900, rows[0][2]), (901, None)]
    got = {r.article_id: (r.leader_id, r.cosine) for r in clusters.nearest_leader(df, spark.createDataFrame(leaders, "leader_id long, vector array<double>"), 0.5).collect()}
    for _, i, v in rows:
        near = [(c, -j) for j, w in leaders if (c := cosine(v, w)) is not None and c >= 0.5]
        assert got[i][0] == (-max(near)[1] if near else None)
        assert not near or abs(got[i][1] - max(near)[0]) < 1e-8
    none = clusters.nearest_leader(df, spark.createDataFrame([], "leader_id long, vector array<double>"))
    assert none.where("leader_id IS NULL").count() == len(rows)


def test_leader_query_covers_every_article(spark):
    folder = "/root/testdata/sf0.001"
    data = spark.read.parquet(f"{folder}/embeddings.parquet").collect()
    rows = [(r.label, r.vec_id, list(r.embedding)) for r in data]
    want = slow_follow(rows, clusters.FOLLOW)
    met = slow_follow([(0, i, v) for _, i, v in rows if want[i] == i], clusters.FOLLOW)
    got = {r.article_id: r.leader_id for r in catalog.QUERIES["leader_follower"](spark, folder).collect()}
    assert got == {i: met[want[i]] for i in want}


def test_detected_language_mostly_agrees(spark):
    rows = catalog.QUERIES["languages_detected"](spark, "/root/testdata/sf0.01").where("detected IS NOT NULL").collect()
    assert len(rows) > 800 and sum(r.lang == r.detected for r in rows) > 0.95 * len(rows)
