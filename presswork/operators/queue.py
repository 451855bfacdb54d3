"""Work owed, queued, missing, due and claimed.

A claim is a ranked assignment: the oldest due rows of a stage, ties by id. Row
locks have no counterpart; several workers at once are one ranked list cut into
runs, so their claims are disjoint.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stages


def expected(records: DataFrame) -> DataFrame:
    """(article_id, stage) that articles owe."""
    owed = records.where(F.col("terminal_reason").isNull() & F.col("pipeline_state").isin(*stages.OWED))
    return owed.select("article_id", stages.owed_stage(F.col("pipeline_state"), F.col("terminal_reason")).alias("stage")).distinct()


def open_work(work: DataFrame) -> DataFrame:
    return work.where("article_id IS NOT NULL AND dead_lettered_at IS NULL").select("article_id", "stage").distinct()


def missing(records: DataFrame, work: DataFrame) -> DataFrame:
    return expected(records).join(open_work(work), ["article_id", "stage"], "left_anti")


def due(work: DataFrame, stage: str | None, now: Column, lease_seconds: int) -> DataFrame:
    lapsed = F.col("claimed_at").isNull() | (F.col("claimed_at") < now - F.make_dt_interval(secs=F.lit(lease_seconds)))
    found = work.where(F.col("dead_lettered_at").isNull() & (F.col("next_attempt_at") <= now) & lapsed)
    return found if stage is None else found.where(F.col("stage") == stage)


def _stamp(work: DataFrame, won: DataFrame, now: Column) -> DataFrame:
    """work with the rows of won (work_id, worker) claimed."""
    joined = work.join(won, "work_id", "left")
    hit = F.col("worker").isNotNull()
    new = {"claimed_at": now, "claimed_by": F.col("worker"), "attempts": F.col("attempts") + 1}
    return joined.select(*[F.when(hit, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in work.columns])


def claim(work: DataFrame, stage: str, worker: str, now: Column, lease_seconds: int, limit: int = 1) -> tuple[DataFrame, DataFrame]:
    """(new work, claimed rows)."""
    won = due(work, stage, now, lease_seconds).orderBy("next_attempt_at", "work_id").limit(limit).select("work_id", F.lit(worker).alias("worker"))
    after = _stamp(work, won, now)
    return after, after.join(won, "work_id", "left_semi")


def claim_many(work: DataFrame, workers: int, now: Column, lease_seconds: int, limit: int) -> DataFrame:
    """(stage, work_id, worker ordinal): what workers of each stage get when all claim at once.

    Only rows that can win are ranked: each partition first keeps its own oldest ``workers * limit`` of a stage.
    """
    order = ["next_attempt_at", "work_id"]
    rows = due(work, None, now, lease_seconds).select("stage", *order)
    near = Window.partitionBy("stage", "part").orderBy(*order)
    rows = rows.withColumn("part", F.pmod(F.xxhash64("work_id"), F.lit(64))).withColumn("r", F.row_number().over(near)).where(F.col("r") <= workers * limit)
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("stage").orderBy(*order))).where(F.col("rank") <= workers * limit)
    return rows.select("stage", "work_id", F.ceil(F.col("rank") / limit).cast("int").alias("worker"))


def rebuild(records: DataFrame, work: DataFrame, now: Column) -> DataFrame:
    """work with a fresh row for all that is missing; new ids lie above the largest, by article."""
    lost = missing(records, work)
    top = work.agg(F.coalesce(F.max("work_id"), F.lit(0))).scalar()
    # Ids need no single-task ranking: an article owes one stage at most, so its id is unique.
    rows = lost.select((top + 1 + F.col("article_id")).alias("work_id"), "article_id", "stage")
    cols = [F.col(c) if c in rows.columns else now.alias(c) if c == "next_attempt_at" else F.lit(0).alias(c) if c == "attempts" else F.lit(None).cast(work.schema[c].dataType).alias(c) for c in work.columns]
    return work.unionByName(rows.select(*cols))


def complete(records: DataFrame, work: DataFrame, done: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """(records, work) after the work_ids of done: the state advances, the row goes, the successor is queued."""
    rows = work.join(done.select("work_id"), "work_id", "left_semi").where("article_id IS NOT NULL")
    moved = rows.select("article_id", stages.state_after(F.col("stage")).alias("state"))
    new = records.join(moved, "article_id", "left")
    new = new.select(*[F.coalesce("state", "pipeline_state").alias(c) if c == "pipeline_state" else F.col(c) for c in records.columns])
    after = rows.withColumn("stage", stages.successor(F.col("stage"))).where("stage IS NOT NULL")
    reset = {"claimed_at": None, "claimed_by": None, "last_error": None, "attempts": 0}
    after = after.select(*[F.lit(reset[c]).cast(work.schema[c].dataType).alias(c) if c in reset else now.alias(c) if c == "next_attempt_at" else F.col(c) for c in work.columns])
    return new, work.join(done.select("work_id"), "work_id", "left_anti").unionByName(after)
