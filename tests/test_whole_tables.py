"""The queries named ..._all read every row of their tables and meet every branch."""

from collections import Counter

from presswork.plans import catalog

FOLDER = "/root/testdata/sf0.01"


def test_seeding_gives_every_entry_a_verdict(spark):
    n = spark.read.parquet(f"{FOLDER}/documents.parquet").count()
    rows = catalog.QUERIES["seed_insert_only_all"](spark, FOLDER).collect()
    assert len({r.position for r in rows}) == len(rows) == n
    stored = {r.home_url for r in catalog.view(spark, FOLDER, "source").select("home_url").collect()}
    urls = {r.home_url for r in rows}
    assert sum(r.inserted for r in rows) == len(urls - stored) and urls & stored


def test_every_document_is_in_a_checked_batch(spark):
    n = spark.read.parquet(f"{FOLDER}/documents.parquet").count()
    rows = {r.batch: r.fault for r in catalog.QUERIES["classify_batch_errors_all"](spark, FOLDER).collect()}
    assert set(rows) == {i // 192 * 3 + (i % 192 >= 80) + (i % 192 >= 136) for i in range(n)}
    assert set(rows.values()) == {"too_many", "duplicate_id", None}


def test_every_job_runs(spark):
    n = spark.read.parquet(f"{FOLDER}/orders.parquet").count()
    got = Counter(r.status for r in catalog.QUERIES["job_run_all"](spark, FOLDER).collect())
    assert sum(got.values()) == n and set(got) == {"succeeded", "partial", "failed"}
