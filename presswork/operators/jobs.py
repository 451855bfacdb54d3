"""Summarise jobs: claiming, running, reading, replaying and sweeping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import inference
from ..schemas import TERMINAL_STATUSES

LEASE_SECONDS = 300
RETENTION_HOURS = 24
SWEEP_BATCH = 1000


def _seconds(n: int) -> Column:
    return F.make_dt_interval(secs=F.lit(n))


def expiry(now: Column, hours: int = RETENTION_HOURS) -> Column:
    return now + F.make_dt_interval(hours=F.lit(hours))


def claimable(jobs: DataFrame, now: Column, lease_seconds: int = LEASE_SECONDS) -> DataFrame:
    lapsed = (F.col("status") == "running") & (F.col("claimed_at") < now - _seconds(lease_seconds))
    return jobs.where(((F.col("status") == "queued") | lapsed) & (F.col("next_attempt_at") <= now))


def claim_next(jobs: DataFrame, worker: str, now: Column, lease_seconds: int = LEASE_SECONDS, limit: int = 1) -> DataFrame:
    """The oldest claimable jobs, stamped as running."""
    won = claimable(jobs, now, lease_seconds).orderBy("next_attempt_at", "id").limit(limit)
    return won.withColumns({"status": F.lit("running"), "claimed_at": now, "claimed_by": F.lit(worker), "attempts": F.col("attempts") + 1})


def outcome(failures: Column, total: Column) -> Column:
    """No failure is success, even of nothing; all failed is failure; else partial."""
    return F.when(failures == 0, "succeeded").when(failures == total, "failed").otherwise("partial")


def batch_outcome(items: DataFrame, key: str = "job_id") -> DataFrame:
    """(key, n_items, n_failures, status)."""
    found = items.groupBy(key).agg(F.count(F.lit(1)).alias("n_items"), F.count("error_code").alias("n_failures"))
    return found.withColumn("status", outcome(F.col("n_failures"), F.col("n_items")))


def run(jobs: DataFrame, items: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """(jobs, items) after running the given jobs: items filled and their documents dropped, expiry anchored anew."""
    filled = items.join(jobs.select(F.col("id").alias("job_id"), "max_sentences"), "job_id")
    filled = filled.withColumn("r", inference.summarize_documents(F.col("documents"), F.col("max_sentences")))
    names = ("provenance", "summary", "faithfulness_score", "withheld", "withhold_reason", "error_code", "error_message")
    filled = filled.select("id", "job_id", "item_id", F.lit(None).cast(items.schema["documents"].dataType).alias("documents"), *[F.col(f"r.{c}").alias(c) for c in names])
    ends = batch_outcome(filled).select(F.col("job_id").alias("id"), F.col("status").alias("end"))
    joined = jobs.join(ends, "id", "left")
    new = {"status": F.coalesce("end", F.lit("succeeded")), "claimed_at": F.lit(None).cast("timestamp_ntz"), "claimed_by": F.lit(None).cast("string"), "updated_at": now, "expires_at": expiry(now)}
    return joined.select(*[new[c].alias(c) if c in new else F.col(c) for c in jobs.columns]), filled


def read_state(jobs: DataFrame, now: Column) -> DataFrame:
    """jobs with the status as read: past its expiry a job is expired and has no results."""
    gone = now >= F.col("expires_at")
    return jobs.withColumn("status", F.when(gone, "expired").otherwise(F.col("status"))).withColumn("has_results", ~gone & F.col("status").isin(*TERMINAL_STATUSES))


def owned(jobs: DataFrame, handle: str, consumer: str) -> DataFrame:
    """The consumer's job of that handle; others' jobs, unknown and malformed handles are all missing."""
    return jobs.where((F.col("public_id") == inference.public_id(F.lit(handle))) & (F.col("consumer") == consumer))


def results(items: DataFrame) -> DataFrame:
    """Items without error whose withheld flag is set, NULLs filled for output."""
    done = items.where("error_code IS NULL AND withheld IS NOT NULL")
    return done.select("job_id", "item_id", F.coalesce("summary", F.lit("")).alias("summary"), F.coalesce("faithfulness_score", F.lit(0.0)).alias("faithfulness_score"), "withheld", "withhold_reason", F.coalesce("provenance", F.array().cast("array<string>")).alias("provenance"))


def errors(items: DataFrame) -> DataFrame:
    return items.where("error_code IS NOT NULL").select("job_id", "item_id", "error_code", "error_message")


def with_items(jobs: DataFrame, items: DataFrame) -> DataFrame:
    """Each job with its items as an array (a job's batch is small by contract)."""
    fields = [c for c in items.columns if c != "job_id"]
    packed = items.groupBy(F.col("job_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("item_id", *[c for c in fields if c != "item_id"]))).alias("items"))
    return jobs.join(packed, "id", "left")


def enqueue(jobs: DataFrame, requests: DataFrame, now: Column) -> DataFrame:
    """requests (request_id, consumer, idempotency_key) with the job each is answered by.

    verdict: ``replayed`` with the live job of the same consumer and key, or of an
    earlier request in the batch; else ``created``. NULL keys never match, nor do
    expired holders.
    """
    live = jobs.where((F.col("expires_at") > now) & F.col("idempotency_key").isNotNull())
    live = live.groupBy("consumer", "idempotency_key").agg(F.min("id").alias("job_id"))
    first = requests.where("idempotency_key IS NOT NULL").groupBy("consumer", "idempotency_key").agg(F.min("request_id").alias("first_id"))
    keyed = requests.join(live, ["consumer", "idempotency_key"], "left").join(first, ["consumer", "idempotency_key"], "left")
    again = F.col("job_id").isNotNull() | (F.col("first_id") < F.col("request_id"))
    return keyed.select("request_id", "consumer", "idempotency_key", F.when(again, "replayed").otherwise("created").alias("verdict"), "job_id", F.when(F.col("job_id").isNull(), F.coalesce("first_id", "request_id")).alias("created_by"))


def enqueue_state(jobs: DataFrame, items: DataFrame, requests: DataFrame, now: Column, hours: int = RETENTION_HOURS) -> tuple[DataFrame, DataFrame]:
    """(jobs, items) after requests (request_id, consumer, idempotency_key, max_sentences; request_id is the id of a new job).

    Expired holders of a key that a request names are deleted first, with their items. Requests that replay a live job add nothing.
    """
    verdicts = enqueue(jobs, requests, now)
    keys = requests.where("idempotency_key IS NOT NULL").select("consumer", "idempotency_key").distinct()
    gone = expired(jobs, now).join(keys, ["consumer", "idempotency_key"], "left_semi").select("id")
    left = jobs.join(gone, "id", "left_anti")
    made = requests.join(verdicts.where("verdict = 'created'").select("request_id"), "request_id", "left_semi")
    new = {"id": F.col("request_id"), "status": F.lit("queued"), "attempts": F.lit(0), "next_attempt_at": now, "created_at": now, "updated_at": now, "expires_at": expiry(now, hours)}
    cols = [new[f.name] if f.name in new else F.col(f.name) if f.name in made.columns else F.lit(None) for f in jobs.schema]
    left = left.unionByName(made.select(*[c.cast(f.dataType).alias(f.name) for c, f in zip(cols, jobs.schema)]))
    return left, items.join(gone.withColumnRenamed("id", "job_id"), "job_id", "left_anti")


def discard_inputs(jobs: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(items with the documents of terminal jobs dropped, the items this changes)."""
    done = jobs.where(F.col("status").isin(*TERMINAL_STATUSES)).select(F.col("id").alias("job_id"))
    changed = items.where("documents IS NOT NULL").join(done, "job_id", "left_semi")
    flagged = items.join(done.withColumn("done", F.lit(True)), "job_id", "left")
    return flagged.select(*[F.when(F.col("done").isNull(), F.col(c)).alias(c) if c == "documents" else F.col(c) for c in items.columns]), changed


def expired(jobs: DataFrame, now: Column) -> DataFrame:
    return jobs.where(F.col("expires_at") <= now)


def sweep(jobs: DataFrame, items: DataFrame, now: Column, batch: int = SWEEP_BATCH) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(jobs left, items left, one row with deleted and overdue); by expiry alone, at most ``batch`` at a time."""
    gone = expired(jobs, now).orderBy("id").limit(batch).select("id")
    left = jobs.join(gone, "id", "left_anti")
    report = jobs.agg(F.count(F.when(F.col("expires_at") <= now, 1)).alias("due"))
    report = report.select(F.least("due", F.lit(batch)).alias("deleted"), (F.col("due") - F.least("due", F.lit(batch))).alias("overdue"))
    return left, items.join(gone.withColumnRenamed("id", "job_id"), "job_id", "left_anti"), report


def latest(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Upsert by key: the last row of each key wins."""
    last = Window.partitionBy(*key).orderBy(*[F.col(c).desc() for c in order])
    return rows.withColumn("r", F.row_number().over(last)).where("r = 1").drop("r")
