"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Every node hands its neighbours (the larger ones, or the smaller ones and itself) to the least of them."""
    if large:
        edges = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = edges.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    back = edges.join(least, "u")
    if large:
        out = back.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = back.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u > v").distinct()


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def component_roots(edges: DataFrame, a: str = "u", b: str = "v") -> DataFrame:
    """(node, root) for every node with an edge to another: root is the least node it can reach.

    Edges are kept as (larger, smaller). Each round is checkpointed, so lineage
    does not grow; rounds grow with the logarithm of the longest chain. Only two
    numbers a round reach the driver. Null ends and loops are ignored; an empty
    table gives an empty one.
    """
    now = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(f"{a} <> {b}").distinct()
    now = durable(now)
    mark = _mark(now)
    while mark[0]:
        now = durable(_star(_star(now, True), False))
        new = _mark(now)
        if new == mark:
            break
        mark = new
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
