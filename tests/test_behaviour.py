"""Scenarios of the pipeline's rules on hand-built frames."""

import datetime as dt

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from presswork import schemas
from presswork.functions import bits, inference, stages
from presswork.operators import extensions, jobs, limits, queue, registry, rights, validation
from presswork.plans.fixtures import ts
from presswork.sources import readers

NOW = dt.datetime(2024, 2, 1)
MIN = dt.timedelta(minutes=1)
WORK = "work_id long, article_id long, cluster_id long, stage string, claimed_at timestamp_ntz, claimed_by string, attempts int, next_attempt_at timestamp_ntz, last_error string, dead_lettered_at timestamp_ntz"
JOB = "id long, public_id string, consumer string, idempotency_key string, status string, claimed_at timestamp_ntz, claimed_by string, attempts int, next_attempt_at timestamp_ntz, created_at timestamp_ntz, updated_at timestamp_ntz, expires_at timestamp_ntz, max_sentences int"


def now():
    return ts("2024-02-01 00:00:00")


def work(spark, *rows):
    base = {"article_id": None, "cluster_id": None, "stage": "acquire", "claimed_at": None, "claimed_by": None, "attempts": 0, "next_attempt_at": NOW, "last_error": None, "dead_lettered_at": None}
    return spark.createDataFrame([tuple({**base, "work_id": i, **r}[c.split()[0]] for c in WORK.split(", ")) for i, r in enumerate(rows)], WORK)


def job(spark, *rows):
    base = {"public_id": None, "consumer": "a", "idempotency_key": None, "status": "queued", "claimed_at": None, "claimed_by": None, "attempts": 0, "next_attempt_at": NOW, "created_at": NOW, "updated_at": NOW, "expires_at": NOW + 24 * 60 * MIN, "max_sentences": None}
    return spark.createDataFrame([tuple({**base, "id": i, **r}[c.split()[0]] for c in JOB.split(", ")) for i, r in enumerate(rows)], JOB)


def items(spark, rows):
    doc = "array<struct<source:string,title:string,text:string,url:string>>"
    return spark.createDataFrame(rows, f"id long, job_id long, item_id string, documents {doc}")


def test_queue_population_and_rebuild(spark):
    records = spark.createDataFrame([(1, "discovered", None), (2, "acquired", None), (3, "classified", None), (4, "clustered", None), (5, "discovered", "failed")], "article_id long, pipeline_state string, terminal_reason string")
    assert {tuple(r) for r in queue.expected(records).collect()} == {(1, "acquire"), (2, "classify"), (3, "cluster")}
    full = work(spark, {"article_id": 1}, {"article_id": 2, "stage": "classify"}, {"article_id": 3, "stage": "cluster"})
    assert queue.missing(records, full).count() == 0 and queue.missing(records, full.limit(0)).count() == 3
    assert queue.missing(records, queue.rebuild(records, full.limit(0), now())).count() == 0


def test_leases_and_disjoint_claims(spark):
    df = work(spark, {"claimed_at": NOW - 30 * MIN, "attempts": 1}, {"claimed_at": NOW}, {"dead_lettered_at": NOW}, {"next_attempt_at": NOW + MIN})
    after, won = queue.claim(df, "acquire", "w", now(), 300, 9)
    assert [(r.work_id, r.attempts, r.claimed_by) for r in won.collect()] == [(0, 2, "w")] and after.count() == 4
    many = queue.claim_many(work(spark, *[{"article_id": i} for i in range(10)]), 2, now(), 300, 5).collect()
    assert sorted(r.work_id for r in many) == list(range(10)) and [sum(r.worker == k for r in many) for k in (1, 2)] == [5, 5]


def test_completion_advances_state_and_queues_the_successor(spark):
    records = spark.createDataFrame([(1, "discovered", None), (2, "classified", None)], "article_id long, pipeline_state string, terminal_reason string")
    df = work(spark, {"article_id": 1}, {"article_id": 2, "stage": "cluster"})
    new, left = queue.complete(records, df, df.select("work_id"), now())
    assert {tuple(r)[:2] for r in new.collect()} == {(1, "acquired"), (2, "clustered")}
    assert [(r.article_id, r.stage) for r in left.collect()] == [(1, "classify")]
    assert set(stages.OWED) == {"discovered", "acquired", "classified"}


def test_rights_follow_the_source_at_read_time(spark):
    records = spark.createDataFrame([(1, 1), (2, 2)], "article_id long, source_id long")
    sources = spark.createDataFrame([(1, "body_text"), (2, "headline_only")], "source_id long, rights_level string")
    assert [r.article_id for r in rights.with_body_rights(records, sources).collect()] == [1]
    assert [r.article_id for r in rights.without_body_rights(records, sources).collect()] == [2]
    flipped = sources.withColumn("rights_level", F.lit("body_text"))
    assert rights.with_body_rights(records, flipped).count() == 2 and rights.not_in_body_rights(records, flipped).count() == 0


def source(spark):
    df = spark.createDataFrame([(1, "b", "u1"), (2, "a", "u2")], "source_id long, name string, home_url string")
    fill = {"discovery_method": "rss", "acquisition_tier": "1_full_feed", "rights_level": "body_text", "jurisdiction": "GB"}
    df = df.withColumns({k: F.lit(v) for k, v in fill.items()}).withColumns({"rate_limit_per_min": F.lit(5), "enabled": F.lit(True)})
    return df.withColumns({"created_at": ts("2024-01-01 00:00:00"), "updated_at": ts("2024-01-01 00:00:00")}).select(*[f.name for f in schemas.TABLES["source"]])


def test_registry_writes(spark):
    df = source(spark)
    assert [r.name for r in registry.list_all(df).collect()] == ["a", "b"]
    writes = spark.createDataFrame([(1, dt.datetime(2024, 1, 1), "headline_only"), (2, dt.datetime(2023, 1, 1), "headline_only"), (9, NOW, "x")], "source_id long, token timestamp_ntz, value string")
    after, verdicts = registry.compare_and_set(df, writes, "rights_level", now())
    assert {r.source_id: r.verdict for r in verdicts.collect()} == {1: "set", 2: "stale", 9: "missing"}
    assert {r.source_id: (r.rights_level, r.updated_at == NOW) for r in after.collect()} == {1: ("headline_only", True), 2: ("body_text", False)}
    with pytest.raises(ValueError):
        registry.compare_and_set(df, writes, "name", now())
    entries = spark.createDataFrame([(0, "n0", "u1"), (1, "n1", "u3"), (2, "n2", "u3")], "position int, name string, home_url string")
    assert [r.name for r in registry.seed_verdicts(df, entries).where("inserted").collect()] == ["n1"]
    seeded = registry.seed(df, entries, now())
    assert seeded.count() == 3 and seeded.where("name = 'n1'").first().enabled
    patched = registry.describe(df, spark.createDataFrame([(1, "new", "headline_only")], "source_id long, name string, rights_level string"), now()).where("source_id = 1").first()
    assert (patched.name, patched.rights_level) == ("new", "body_text")


def test_roster(spark, tmp_path):
    good = '{"name":"n","home_url":"u","discovery_method":"rss","acquisition_tier":"1_full_feed","rights_level":"body_text","jurisdiction":"GB","rate_limit_per_min":5%s}'
    path = tmp_path / "r.json"
    path.write_text("[" + good % "" + "," + good % ',"enabled":false' + "]")
    assert [r.enabled for r in readers.read_roster(spark, str(path)).orderBy("position").collect()] == [True, False]
    for bad, what in ((good.replace('"rss"', '"fax"') % "", "entry 1: discovery_method is unknown"), ('{"name":"n"}', "entry 1: home_url is missing"), ("3", "entry 1: not an object"), (good.replace(":5", ':"x"') % "", "entry 1: rate_limit_per_min is no number")):
        path.write_text("[" + good % "" + "," + bad + "]")
        with pytest.raises(readers.RosterError, match=what):
            readers.read_roster(spark, str(path))
    for whole in ("{}x", good % "", "", "3"):
        path.write_text(whole)
        with pytest.raises(readers.RosterError, match="a roster is an array"):
            readers.read_roster(spark, str(path))
    path.write_text(" [ ]")
    assert readers.read_roster(spark, str(path)).count() == 0
    path.write_text("[" + good.replace(":5", ':" 7 "') % ',"enabled":"no"' + "," + good.replace(":5", ":3.9") % ',"enabled":null' + "]")
    assert [(r.rate_limit_per_min, r.enabled) for r in readers.read_roster(spark, str(path)).orderBy("position").collect()] == [(7, True), (3, False)]


def test_keys_with_the_separator_do_not_collide(spark):
    from presswork.operators import validation

    rows = spark.createDataFrame([(1, 1, "a|b", "c"), (2, 2, "a", "b|c"), (3, 3, "a", "b|c"), (4, 4, None, "c"), (5, 5, None, "c")], "id long, public_id long, consumer string, idempotency_key string")
    assert [(r.key, r.n) for r in validation.unique_violations("summarize_job", rows).collect()] == [("a|b|c", 2)]


def test_the_last_write_of_an_id_counts(spark):
    from presswork.operators import registry

    sources = spark.createDataFrame([(1, "a", True, NOW), (2, "b", True, NOW)], "source_id long, name string, enabled boolean, updated_at timestamp_ntz")
    patches = spark.createDataFrame([(1, "x", 2), (1, "y", 1), (9, "z", 1)], "source_id long, name string, position int")
    assert sorted(r.name for r in registry.describe(sources, patches, now()).collect()) == ["b", "x"]
    writes = spark.createDataFrame([(1, NOW, False, 1), (1, NOW, True, 2), (2, NOW, False, 1)], "source_id long, token timestamp_ntz, value boolean, position int")
    after, verdicts = registry.compare_and_set(sources, writes, "enabled", now())
    assert sorted((r.source_id, r.enabled) for r in after.collect()) == [(1, True), (2, False)]
    assert sorted((r.source_id, r.verdict) for r in verdicts.collect()) == [(1, "set"), (2, "set")]


def test_settings():
    from presswork import settings

    app = settings.load(settings.AppSettings, "APP_", {"app_database_url": "postgresql://x", "APP_OTHER": "1"})
    assert app == settings.AppSettings("postgresql://x", 300)
    with pytest.raises(AttributeError):
        app.work_lease_seconds = 1
    assert settings.load(settings.PlatformSettings, "P_", {"P_DATABASE_URL": "x", "P_RETENTION_HOURS": "2"}).retention_hours == 2
    for given, what in (({}, "database_url is missing"), ({"P_DATABASE_URL": "x", "P_RETENTION_HOURS": "0"}, "positive"), ({"P_DATABASE_URL": "x", "P_POLL_RATE_LIMIT_PER_MINUTE": "many"}, "positive")):
        with pytest.raises(settings.SettingsError, match=what):
            settings.load(settings.PlatformSettings, "P_", given)
    with pytest.raises(settings.SettingsError, match="32"):
        settings.load(settings.AdminSettings, "A_", {"A_TOKEN": "short"})
    assert "t" * 32 not in repr(settings.load(settings.AdminSettings, "A_", {"A_TOKEN": "t" * 32}))


def test_marks_inside_marks_and_heads(spark):
    from presswork.functions import markup

    one = lambda text: [tuple(m) for m in spark.createDataFrame([(text,)], "t string").select(markup.marks(F.col("t")).alias("m")).first().m]
    assert one("**a `c` b** and *x*") == [("strong", "a `c` b", None), ("em", "x", None)] and one("a `c` b") == [("code", "c", None)]
    assert one("2 * 3 * 4 @2024-13-01") == [("em", " 3 ", None), ("date", "2024-13-01", None)] and one("plain") == []
    head = lambda text: spark.createDataFrame([(text,)], "t string").select(markup.frontmatter(F.col("t")).alias("m"), markup.body(F.col("t")).alias("b")).first()
    got = head("---\na: 1\nb : \"q: r\"\na: '2\n---\nrest\n---\nmore")
    assert [tuple(m) for m in got.m] == [("b", "q: r"), ("a", "'2")] and got.b == "rest\n---\nmore"
    assert head("---\n---\nx").b == "x" and list(head("no head").m) == []


def test_enqueue_state_replaces_expired_holders(spark):
    df = job(spark, {"idempotency_key": "k", "expires_at": NOW - MIN}, {"idempotency_key": "live", "expires_at": NOW + MIN}, {"idempotency_key": None, "expires_at": NOW - MIN})
    its = items(spark, [(1, 0, "a", None), (2, 1, "b", None)])
    consumer = df.first().consumer
    asked = spark.createDataFrame([(100, consumer, "k"), (101, consumer, "live"), (102, consumer, None), (103, consumer, "k"), (104, "someone else", "live")], "request_id long, consumer string, idempotency_key string")
    after, left = jobs.enqueue_state(df, its, asked, now())
    assert sorted(r.id for r in after.collect()) == [1, 2, 100, 102, 104]
    assert {r.status for r in after.where("id >= 100").collect()} == {"queued"} and [r.job_id for r in left.collect()] == [1]


def test_mixed_batch_and_anchored_expiry(spark):
    doc = lambda n, url: {"source": "s", "title": "", "text": "x" * n, "url": url}
    rows = [(1, 0, "ok", [doc(300, "u"), doc(0, "")]), (2, 0, "big", [doc(20001, None)]), (3, 1, "thin", [doc(199, "v")]), (4, 2, "none", None), (5, 2, "empty", [])]
    df = job(spark, {"created_at": NOW - 20 * 60 * MIN, "max_sentences": 2}, {}, {}, {})
    done, filled = jobs.run(df, items(spark, rows), now())
    assert {r.id: r.status for r in done.collect()} == {0: "partial", 1: "succeeded", 2: "failed", 3: "succeeded"}
    assert all(r.expires_at == NOW + 24 * 60 * MIN for r in done.collect())
    by = {r.item_id: r for r in filled.collect()}
    assert by["ok"].summary == " ".join(inference.SENTENCES[:2]) and by["ok"].provenance == ["u"] and by["ok"].documents is None
    assert (by["big"].error_code, by["none"].error_code, by["empty"].error_code) == ("item_too_large", "invalid_request", "invalid_request")
    assert by["thin"].withheld and by["thin"].faithfulness_score == 0.42 and by["thin"].withhold_reason == "below_faithfulness_bar"
    assert {r.item_id for r in jobs.results(filled).collect()} == {"ok", "thin"} and jobs.errors(filled).count() == 3


def test_sweep_backlog_and_ownership(spark):
    handle = "0a0a0a0a-0000-4000-8000-00000000000b"
    df = job(spark, *[{"expires_at": NOW - MIN}] * 3, {"public_id": handle})
    left, _, report = jobs.sweep(df, items(spark, []), now(), batch=1)
    assert tuple(report.first()) == (1, 2) and left.count() == 3
    assert jobs.owned(df, handle.upper(), "a").count() == 1
    assert jobs.owned(df, handle, "b").count() == 0 and jobs.owned(df, "nonsense", "a").count() == 0
    assert {r.status for r in jobs.read_state(df, now()).collect()} == {"expired", "queued"}


def test_idempotency(spark):
    df = job(spark, {"idempotency_key": "k"}, {"idempotency_key": "old", "expires_at": NOW})
    req = spark.createDataFrame([(1, "a", "k"), (2, "a", "old"), (3, "b", "k"), (4, "a", None), (5, "a", None), (6, "a", "old")], "request_id long, consumer string, idempotency_key string")
    assert {r.request_id: r.verdict for r in jobs.enqueue(df, req, now()).collect()} == {1: "replayed", 2: "created", 3: "created", 4: "created", 5: "created", 6: "replayed"}


def test_limiter_windows(spark):
    w = limits.Window(1, 60)
    assert [w.check(int(t * 1e6)) for t in (0, 0, 50, 59.9, 60)] == [(True, 0), (False, 60), (False, 10), (False, 1), (True, 0)]
    some = limits.Limiter(1, 60, max_keys=2)
    assert [some.check(k, t)[0] for k, t in (("a", 0), ("b", 1), ("c", 2), ("a", 3), ("b", 4))] == [True] * 5
    rows = [(f"k{i % 3}", NOW + dt.timedelta(seconds=7 * i), i) for i in range(60)]
    got = limits.decisions(spark.createDataFrame(rows, "consumer string, ts timestamp_ntz, request_id long"), 2, 60).collect()
    plain, want = {}, {}
    for k, t, i in rows:
        want[i] = plain.setdefault(k, limits.Window(2, 60)).check(round((t - NOW).total_seconds() * 1e6))
    assert {r.request_id: (r.allowed, r.retry_after) for r in got} == want


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 400), max_size=60), st.integers(1, 4))
def test_limiter_never_passes_more_than_its_limit_in_a_window(times, limit):
    w, starts = limits.Window(limit, 60), {}
    for t in sorted(times):
        ok, wait = w.check(t * 10**6)
        assert ok or 1 <= wait <= 60
        if ok:
            starts[w.start] = starts.get(w.start, 0) + 1
    assert all(n <= limit for n in starts.values())


def test_simhash_codec(spark):
    values = [0, 1, 2**63 - 1, 2**63, 2**63 + 1, 2**64 - 1]
    df = spark.createDataFrame([(str(v),) for v in values], "v string").select(F.col("v").cast("decimal(20,0)").alias("v"))
    got = df.select("v", bits.simhash_to_db(F.col("v")).alias("s")).select("v", "s", bits.simhash_from_db(F.col("s")).alias("u")).collect()
    assert all(r.v == r.u and r.s == (int(r.v) - 2**64 if r.v >= 2**63 else int(r.v)) for r in got)
    for bad in ("-1", str(2**64)):
        with pytest.raises(Exception, match="unsigned"):
            spark.createDataFrame([(bad,)], "v string").select(bits.simhash_to_db(F.col("v").cast("decimal(38,0)").cast("decimal(20,0)")).alias("s")).collect()


def test_open_row_uniqueness_and_rules(spark):
    two = work(spark, {"article_id": 1}, {"article_id": 1, "stage": "classify"})
    assert [tuple(r) for r in validation.unique_violations("pipeline_work", two).collect()] == [("open_article", "1", 2)]
    one = work(spark, {"article_id": 1, "dead_lettered_at": NOW}, {"article_id": 1}, {"article_id": None, "cluster_id": 3}, {"article_id": None, "cluster_id": None, "stage": "nap"})
    assert validation.unique_violations("pipeline_work", one).count() == 0
    assert {tuple(r) for r in validation.check_violations("pipeline_work", one, "work_id").collect()} == {(3, "one_subject"), (3, "stage_domain")}
    s = spark.createDataFrame([(1, None, False, "none"), (2, "t", True, "rights_excluded"), (3, None, True, "none")], "cluster_id long, text string, withheld boolean, withhold_reason string")
    assert {r.row_key for r in validation.check_violations("summary", s, "cluster_id").collect()} == {2, 3}
    assert sum(len(c) for c in schemas.DOMAINS.values()) == 12 and set(schemas.TABLES) >= set(schemas.DOMAINS)
    assert validation.schema_drift("source", source(spark)) == [] and validation.schema_drift("cluster_member", two)


def test_extensions(spark):
    codes = spark.createDataFrame([(0,), (1,), (7,), (-1,), (-1 << 63,), (0b1111,), (None,)], "simhash long")
    pairs = {(r.a, r.b, r.distance) for r in extensions.near_pairs(codes).collect()}
    values = [0, 1, 7, -1, -1 << 63, 15]
    assert pairs == {(a, b, ((a ^ b) & (1 << 64) - 1).bit_count()) for a in values for b in values if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 3}
    a = spark.createDataFrame([("p", 2), ("q", 1)], "type string, n long")
    b = spark.createDataFrame([("p", 2), ("r", 4)], "type string, n long")
    assert {tuple(r) for r in extensions.census_drift(a, b).collect()} == {("q", 1, None), ("r", None, 4)}


def test_streams(spark, tmp_path):
    from presswork.streaming import limiter, loops

    rows = [(f"k{i % 2}", dt.datetime(2024, 1, 1) + dt.timedelta(seconds=9 * i), i) for i in range(20)]
    schema = "consumer string, ts timestamp, request_id long"
    for k in (0, 10):
        spark.createDataFrame(rows[k : k + 10], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = limiter.limited(stream, 2, 60).writeStream.format("memory").queryName("limited").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(90)
    plain, want = {}, {}
    for k, t, i in rows:
        want[i] = plain.setdefault(k, limits.Window(2, 60)).check(round(t.timestamp() * 1e6))
    assert {r.request_id: (r.allowed, r.retry_after) for r in spark.sql("SELECT * FROM limited").collect()} == want
    left = [3]

    def claim():
        left[0] -= 1
        return left[0] >= 0

    assert loops.drain(claim)() == 3
    loops.guarded(lambda: 1 / 0)(None, 1)
