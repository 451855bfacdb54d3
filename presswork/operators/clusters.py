"""Articles and cluster leaders: the nearest leader, online leader-follower clustering, and its batch reconcile.

Vectors are arrays of floats; nearness is the cosine. A null or zero vector is near to
nothing. Leaders meet all articles in blocks of ``BLOCK``, so a task holds one block of
leaders and one batch of articles, whatever their numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = 4096
#: Ours: the cosine from which an article follows a leader.
FOLLOW = 0.8


def _unit(column: pa.Array, width: int) -> np.ndarray:
    """Unit vectors as rows; null, zero and wrongly sized ones are zero."""
    sizes = np.fromiter((len(x) if x.is_valid else -1 for x in column), np.int64, len(column))
    out = np.zeros((len(column), width))
    good = np.flatnonzero(sizes == width)
    if width and len(good):
        flat = column.take(pa.array(good)).flatten()
        x = flat.to_numpy(zero_copy_only=False).astype(float).reshape(-1, width)
        size = np.sqrt((x * x).sum(1, keepdims=True))
        out[good] = np.where(np.isfinite(size) & (size > 0), x / np.where(size > 0, size, 1), 0)
    return out


def _width(column: pa.Array) -> int:
    return max((len(x) for x in column if x.is_valid), default=0)


def nearest_leader(articles: DataFrame, leaders: DataFrame, least: float = -1.0) -> DataFrame:
    """(article_id, leader_id, cosine) for articles and open leaders (leader_id, vector); ties go to the least leader_id.

    Without a leader of that cosine the leader is NULL.
    """
    spark = articles.sparkSession
    ordered = leaders.where("vector IS NOT NULL").select(F.col("leader_id").cast("long").alias("leader_id"), F.col("vector").cast("array<double>").alias("vector")).orderBy("leader_id")
    n = ordered.count()
    base = articles.select(F.col("article_id").cast("long").alias("article_id"), F.col("vector").cast("array<double>").alias("vector"))
    none = base.select("article_id", F.lit(None).cast("long").alias("leader_id"), F.lit(None).cast("double").alias("cosine"))
    parts = [none]
    for k in range(-(-n // BLOCK)):
        held = ordered.offset(k * BLOCK).limit(BLOCK).toArrow()
        width = _width(held.column("vector").combine_chunks())
        shared = spark.sparkContext.broadcast((held.column("leader_id").to_numpy(), _unit(held.column("vector").combine_chunks(), width)))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, vectors = shared.value
            for batch in batches:
                own = _unit(batch.column(1), vectors.shape[1])
                cos = np.round(own @ vectors.T, 9)
                best = cos.argmax(1) if len(ids) else np.zeros(len(own), int)
                ok = own.any(1) & (cos[np.arange(len(own)), best] >= least)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids[best], pa.int64(), mask=~ok), pa.array(cos[np.arange(len(own)), best], mask=~ok)], ["article_id", "leader_id", "cosine"])

        parts.append(base.mapInArrow(run, "article_id long, leader_id long, cosine double"))
    out = parts[-1]
    if len(parts) > 2:
        for p in parts[1:-1]:
            out = out.unionByName(p)
        best = F.max(F.when(F.col("leader_id").isNotNull(), F.struct("cosine", (-F.col("leader_id")).alias("back")))).alias("b")
        out = out.groupBy("article_id").agg(best).select("article_id", (-F.col("b.back")).alias("leader_id"), F.col("b.cosine").alias("cosine"))
    return out


def follow(articles: DataFrame, least: float = FOLLOW) -> DataFrame:
    """(block, article_id, leader_id): articles (block, article_id, vector) taken in order of id within each block.

    An article joins the nearest leader of its block if the cosine is ``least`` or
    more, else it leads a cluster of its own. Order matters, so a block is one
    sequence; rows stream through its task, which keeps the leaders only.
    """
    width = max(articles.agg(F.max(F.size("vector"))).first()[0] or 0, 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, vectors, used = None, [], np.zeros((0, 0)), 0
        for batch in batches:
            blocks, articles_, raw = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)
            unit, leader = _unit(raw, width), []
            for k, (block, i) in enumerate(zip(blocks, articles_)):
                if block != now:
                    now, ids, vectors, used = block, [], np.zeros((16, width)), 0
                cos = np.round(vectors[:used] @ unit[k], 9)
                best = int(cos.argmax()) if used else -1
                if used and unit[k].any() and cos[best] >= least:
                    leader.append(ids[best])
                    continue
                leader.append(i)
                if not unit[k].any():
                    continue
                if used == len(vectors):
                    vectors = np.concatenate((vectors, np.zeros_like(vectors)))
                vectors[used] = unit[k]
                used += 1
                ids.append(i)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(leader, pa.int64())], ["block", "article_id", "leader_id"])

    rows = articles.select(F.col("block").cast("long").alias("block"), F.col("article_id").cast("long").alias("article_id"), F.col("vector").cast("array<double>").alias("vector"))
    return rows.repartition("block").sortWithinPartitions("block", "article_id").mapInArrow(run, "block long, article_id long, leader_id long")


def reconcile(followed: DataFrame, articles: DataFrame, least: float = FOLLOW) -> DataFrame:
    """(article_id, leader_id) after the leaders of all blocks met in one sequence by id; a leader that follows takes its followers along."""
    leaders = followed.where("article_id = leader_id").select("leader_id")
    met = articles.join(leaders, F.col("article_id") == F.col("leader_id"), "left_semi").select(F.lit(0).alias("block"), "article_id", "vector")
    into = follow(met, least).select(F.col("article_id").alias("leader_id"), F.col("leader_id").alias("into"))
    return followed.join(into, "leader_id").select("article_id", F.col("into").alias("leader_id"))
