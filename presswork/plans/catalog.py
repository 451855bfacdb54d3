"""Every registered query of the pipeline, and its SQL counterpart."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import settings
from ..functions import articles, bits, inference, markup, stages
from ..operators import clusters, extensions, jobs, limits, queue, registry, rights, validation
from ..sources import readers
from .fixtures import JOBS_NOW, LEASE, NOW, duck, ts, view

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, *views: str) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql:
            SQL[name] = duck(sql, *views)
        return fn

    return add


_DUE = "dead_lettered_at IS NULL AND next_attempt_at <= {now} AND (claimed_at IS NULL OR claimed_at < {now} - {min:5})"
_EXPECTED = "SELECT DISTINCT article_id, CASE pipeline_state WHEN 'discovered' THEN 'acquire' WHEN 'acquired' THEN 'classify' ELSE 'cluster' END AS stage FROM canonical_record WHERE terminal_reason IS NULL AND pipeline_state <> 'clustered'"
_OPEN = "SELECT DISTINCT article_id, stage FROM pipeline_work WHERE article_id IS NOT NULL AND dead_lettered_at IS NULL"


# --- registry and rights -----------------------------------------------------------------------


@query("sources_list", "SELECT source_id, name, rights_level, enabled FROM source", "source")
def sources_list(s, d):
    return registry.list_all(view(s, d, "source")).select("source_id", "name", "rights_level", "enabled")


@query("sources_enabled", "SELECT source_id, name FROM source WHERE enabled", "source")
def sources_enabled(s, d):
    return registry.enabled(view(s, d, "source")).select("source_id", "name")


@query("source_lookup", "SELECT source_id, name, home_url, rate_limit_per_min FROM source WHERE source_id = 7", "source")
def source_lookup(s, d):
    return registry.get(view(s, d, "source"), 7).select("source_id", "name", "home_url", "rate_limit_per_min")


@query("articles_with_body_rights", "SELECT s.name, count(*) AS n_articles, min(r.article_id) AS first_article FROM canonical_record r JOIN source s ON r.source_id = s.source_id WHERE r.article_id IN (SELECT article_id FROM canonical_record x JOIN source y ON x.source_id = y.source_id WHERE y.rights_level = 'body_text') GROUP BY s.name", "source", "canonical_record")
def articles_with_body_rights(s, d):
    records, sources = view(s, d, "canonical_record"), view(s, d, "source")
    mine = records.join(rights.with_body_rights(records, sources), "article_id", "left_semi").join(sources.select("source_id", "name"), "source_id")
    return mine.groupBy("name").agg(F.count(F.lit(1)).alias("n_articles"), F.min("article_id").alias("first_article"))


@query("articles_without_body_rights", "SELECT article_id FROM canonical_record r JOIN source s ON r.source_id = s.source_id WHERE s.rights_level = 'headline_only'", "source", "canonical_record")
def articles_without_body_rights(s, d):
    return rights.without_body_rights(view(s, d, "canonical_record"), view(s, d, "source"))


@query("articles_not_in_body_rights", "SELECT article_id FROM canonical_record WHERE source_id NOT IN (SELECT source_id FROM source WHERE rights_level = 'body_text')", "source", "canonical_record")
def articles_not_in_body_rights(s, d):
    return rights.not_in_body_rights(view(s, d, "canonical_record"), view(s, d, "source"))


@query("registry_describe", "SELECT source_id, CASE WHEN source_id % 2 = 0 THEN 'new ' || name ELSE name END AS name, rights_level, CASE WHEN source_id % 2 = 0 THEN {now} ELSE updated_at END AS updated_at FROM source", "source")
def registry_describe(s, d):
    sources = view(s, d, "source")
    patches = sources.where("source_id % 2 = 0").select("source_id", F.concat(F.lit("new "), "name").alias("name"))
    return registry.describe(sources, patches, ts(NOW)).select("source_id", "name", "rights_level", "updated_at")


@query("registry_cas", "SELECT w.source_id, CASE WHEN s.source_id IS NULL THEN 'missing' WHEN s.updated_at = w.token THEN 'set' ELSE 'stale' END AS verdict FROM (SELECT source_id + 3 AS source_id, CASE WHEN source_id % 2 = 0 THEN updated_at + {min:3} ELSE updated_at END AS token FROM source) w LEFT JOIN source s ON s.source_id = w.source_id", "source")
def registry_cas(s, d):
    sources = view(s, d, "source")
    token = F.when(F.col("source_id") % 2 == 0, F.col("updated_at") + F.make_dt_interval(mins=F.lit(3))).otherwise(F.col("updated_at"))
    writes = sources.select((F.col("source_id") + 3).alias("source_id"), token.alias("token"), F.lit("headline_only").alias("value"))
    return registry.compare_and_set(sources, writes, "rights_level", ts(NOW))[1]


@query("registry_cas_state", "SELECT s.source_id, CASE WHEN w.source_id IS NOT NULL THEN NOT s.enabled ELSE s.enabled END AS enabled, CASE WHEN w.source_id IS NOT NULL THEN {now} ELSE s.updated_at END AS updated_at FROM source s LEFT JOIN (SELECT source_id FROM source WHERE source_id % 3 = 1) w ON w.source_id = s.source_id", "source")
def registry_cas_state(s, d):
    sources = view(s, d, "source")
    token = F.when(F.col("source_id") % 3 == 1, F.col("updated_at")).otherwise(ts("2000-01-01 00:00:00"))
    writes = sources.select("source_id", token.alias("token"), (~F.col("enabled")).alias("value"))
    return registry.compare_and_set(sources, writes, "enabled", ts(NOW))[0].select("source_id", "enabled", "updated_at")


@query("seed_insert_only_all", "SELECT position, name, home_url, NOT EXISTS (SELECT 1 FROM source s WHERE s.home_url = e.home_url) AND row_number() OVER (PARTITION BY home_url ORDER BY position) = 1 AS inserted FROM (SELECT doc_id AS position, 'n' || CAST(doc_id AS VARCHAR) AS name, 'https://src' || CAST(doc_id // 3 AS VARCHAR) || '.example.org' AS home_url FROM documents) e", "source")
def seed_insert_only_all(s, d):
    entries = readers.table(s, d, "documents").selectExpr("doc_id AS position", "concat('n', doc_id) AS name", "concat('https://src', doc_id DIV 3, '.example.org') AS home_url")
    return registry.seed_verdicts(view(s, d, "source"), entries)


# --- the work queue ----------------------------------------------------------------------------


@query("stage_maps", "SELECT * FROM (VALUES ('acquire', 'acquired', 'classify'), ('classify', 'classified', 'cluster'), ('cluster', 'clustered', NULL), ('summarize', NULL, NULL)) t(stage, state_after, successor)")
def stage_maps(s, d):
    df = s.createDataFrame([("acquire",), ("classify",), ("cluster",), ("summarize",)], "stage string")
    return df.select("stage", stages.state_after(F.col("stage")).alias("state_after"), stages.successor(F.col("stage")).alias("successor"))


@query("work_expected", _EXPECTED, "canonical_record")
def work_expected(s, d):
    return queue.expected(view(s, d, "canonical_record"))


@query("work_open", _OPEN, "pipeline_work")
def work_open(s, d):
    return queue.open_work(view(s, d, "pipeline_work"))


@query("work_missing", f"SELECT * FROM ({_EXPECTED}) a EXCEPT SELECT * FROM ({_OPEN}) b", "canonical_record", "pipeline_work")
def work_missing(s, d):
    return queue.missing(view(s, d, "canonical_record"), view(s, d, "pipeline_work"))


@query("work_due", f"SELECT work_id, stage FROM pipeline_work WHERE stage = 'classify' AND {_DUE}", "pipeline_work")
def work_due(s, d):
    return queue.due(view(s, d, "pipeline_work"), "classify", ts(NOW), LEASE).select("work_id", "stage")


@query("work_claim", f"SELECT work_id, claimed_by, attempts, claimed_at FROM (SELECT work_id, 'w9' AS claimed_by, attempts + 1 AS attempts, {{now}} AS claimed_at FROM pipeline_work WHERE stage = 'acquire' AND {_DUE} ORDER BY next_attempt_at, work_id LIMIT 7) t", "pipeline_work")
def work_claim(s, d):
    return queue.claim(view(s, d, "pipeline_work"), "acquire", "w9", ts(NOW), LEASE, 7)[1].select("work_id", "claimed_by", "attempts", "claimed_at")


@query("work_claim_multi", f"SELECT stage, work_id, CAST(ceil(r / 3.0) AS INT) AS worker FROM (SELECT stage, work_id, row_number() OVER (PARTITION BY stage ORDER BY next_attempt_at, work_id) AS r FROM pipeline_work WHERE {_DUE}) t WHERE r <= 12", "pipeline_work")
def work_claim_multi(s, d):
    return queue.claim_many(view(s, d, "pipeline_work"), 4, ts(NOW), LEASE, 3)


@query("work_rebuild", f"SELECT article_id, stage, CAST(count(*) AS BIGINT) AS n FROM (SELECT article_id, stage FROM pipeline_work UNION ALL SELECT article_id, stage FROM (SELECT * FROM ({_EXPECTED}) a EXCEPT SELECT * FROM ({_OPEN}) b) c) t GROUP BY article_id, stage", "canonical_record", "pipeline_work")
def work_rebuild(s, d):
    after = queue.rebuild(view(s, d, "canonical_record"), view(s, d, "pipeline_work"), ts(NOW))
    return after.groupBy("article_id", "stage").agg(F.count(F.lit(1)).alias("n"))


@query("work_complete", "SELECT stage, CAST(count(*) AS BIGINT) AS n FROM (SELECT stage FROM pipeline_work WHERE work_id % 3 <> 0 UNION ALL SELECT CASE stage WHEN 'acquire' THEN 'classify' ELSE 'cluster' END FROM pipeline_work WHERE work_id % 3 = 0 AND article_id IS NOT NULL AND stage <> 'cluster') t GROUP BY stage", "pipeline_work")
def work_complete(s, d):
    work = view(s, d, "pipeline_work")
    after = queue.complete(view(s, d, "canonical_record"), work, work.where("work_id % 3 = 0"), ts(NOW))[1]
    return after.groupBy("stage").agg(F.count(F.lit(1)).alias("n"))


# --- classify and summarise --------------------------------------------------------------------

_CONV = "SELECT 'c' || CAST(conv_id AS VARCHAR) AS item_id, list(struct_pack(text := text, url := CASE WHEN turn % 3 > 0 THEN 'u' || CAST(turn AS VARCHAR) ELSE '' END) ORDER BY turn) AS ignored, sum(length(text)) AS n, string_agg(CASE WHEN turn % 3 > 0 THEN 'u' || CAST(turn AS VARCHAR) END, ',' ORDER BY turn) AS urls, CAST(conv_id % 5 AS INT) AS sentences FROM conversations GROUP BY conv_id"
_ITEMS = f"SELECT item_id, n, coalesce(urls, '') AS urls, sentences FROM ({_CONV}) c UNION ALL SELECT 'd' || CAST(doc_id AS VARCHAR), length(text), CASE WHEN doc_id % 4 > 0 THEN 'v' || CAST(doc_id AS VARCHAR) ELSE '' END, NULL FROM documents WHERE doc_id % 50 <> 7 UNION ALL SELECT 'd' || CAST(doc_id AS VARCHAR), NULL, NULL, NULL FROM documents WHERE doc_id % 50 = 7"


def summarize_input(s: SparkSession, d: str) -> DataFrame:
    """(item_id, documents, max_sentences): conversations, single documents, and some items without documents."""
    doc = lambda *c: F.struct(*[F.col(x) if isinstance(x, str) else x for x in c])
    conv = readers.table(s, d, "conversations").withColumn("url", F.when(F.col("turn") % 3 > 0, F.concat(F.lit("u"), "turn")).otherwise(""))
    conv = conv.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", doc(F.col("role").alias("source"), F.lit("").alias("title"), "text", "url").alias("doc")))).alias("t"))
    conv = conv.select(F.concat(F.lit("c"), "conv_id").alias("item_id"), F.transform("t", lambda x: x["doc"]).alias("documents"), (F.col("conv_id") % 5).cast("int").alias("max_sentences"))
    single = readers.table(s, d, "documents").withColumn("url", F.when(F.col("doc_id") % 4 > 0, F.concat(F.lit("v"), "doc_id")))
    docs = F.when(F.col("doc_id") % 50 != 7, F.array(doc("source", F.lit("").alias("title"), "text", "url")))
    return conv.unionByName(single.select(F.concat(F.lit("d"), "doc_id").alias("item_id"), docs.alias("documents"), F.lit(None).cast("int").alias("max_sentences")))


@query("classify_items", "SELECT doc_id, CASE WHEN length(text) > 20000 THEN NULL WHEN length(text) < 200 THEN 'Other' ELSE 'Technology' END AS topic, CASE WHEN length(text) > 20000 THEN NULL WHEN length(text) < 200 THEN CAST(0.31 AS DOUBLE) ELSE CAST(0.94 AS DOUBLE) END AS confidence, CASE WHEN length(text) <= 20000 THEN length(text) < 200 END AS fallback, CASE WHEN length(text) > 20000 THEN 'item_too_large' END AS error_code, CASE WHEN length(text) > 20000 THEN CAST(length(text) AS VARCHAR) || ' characters exceeds the 20000 limit' END AS error_message FROM documents")
def classify_items(s, d):
    return readers.table(s, d, "documents").select("doc_id", inference.classify_text(F.col("text")).alias("r")).select("doc_id", "r.*")


# Of each 192 documents 80 are one batch, 56 one with repeated ids and 56 one without.
_BATCH = "CASE WHEN doc_id % 192 < 80 THEN 0 WHEN doc_id % 192 < 136 THEN 1 ELSE 2 END"
_BATCH_ID = f"CASE WHEN ({_BATCH}) = 1 THEN doc_id % 50 ELSE doc_id END"


@query("classify_batch_errors_all", f"SELECT batch, CASE WHEN n > 64 THEN 'too_many' WHEN m < n THEN 'duplicate_id' END AS fault FROM (SELECT doc_id // 192 * 3 + {_BATCH} AS batch, count(*) AS n, count(DISTINCT {_BATCH_ID}) AS m FROM documents GROUP BY 1) t")
def classify_batch_errors_all(s, d):
    docs = readers.table(s, d, "documents").select(F.expr(f"doc_id DIV 192 * 3 + {_BATCH}").alias("batch"), F.expr(_BATCH_ID).alias("id"))
    ids = docs.groupBy("batch").agg(F.collect_list("id").alias("ids"))
    return ids.select("batch", inference.batch_fault(F.col("ids"), inference.CLASSIFY_BATCH).alias("fault"))


@query("taxonomy_versions", "SELECT v AS requested, CASE WHEN v IS NULL OR v = '' THEN 'v1' ELSE v END AS version, coalesce(nullif(v, ''), 'v1') = 'v1' AS supported FROM (VALUES ('v1'), ('v2'), (''), (NULL)) t(v)")
def taxonomy_versions(s, d):
    df = s.createDataFrame([("v1",), ("v2",), ("",), (None,)], "requested string")
    return df.select("requested", inference.taxonomy_version(F.col("requested")).alias("version"), inference.taxonomy_supported(F.col("requested")).alias("supported"))


_TEXT = [" ".join(inference.SENTENCES[:k]) for k in (1, 2, 3)]
_SUMMARY = "SELECT item_id, CASE WHEN n BETWEEN 200 AND 20000 THEN CASE least(greatest(coalesce(sentences, 3), 1), 3) WHEN 1 THEN '" + _TEXT[0] + "' WHEN 2 THEN '" + _TEXT[1] + "' ELSE '" + _TEXT[2] + "' END END AS summary, CASE WHEN n < 200 THEN CAST(0.42 AS DOUBLE) WHEN n <= 20000 THEN CAST(0.97 AS DOUBLE) END AS faithfulness_score, CASE WHEN n <= 20000 THEN n < 200 END AS withheld, CASE WHEN n < 200 THEN 'below_faithfulness_bar' END AS withhold_reason, CASE WHEN n <= 20000 THEN urls END AS provenance, CASE WHEN n IS NULL THEN 'invalid_request' WHEN n > 20000 THEN 'item_too_large' END AS error_code"


@query("summarize_items", f"{_SUMMARY} FROM ({_ITEMS}) t")
def summarize_items(s, d):
    df = summarize_input(s, d).select("item_id", inference.summarize_documents(F.col("documents"), F.col("max_sentences")).alias("r"))
    return df.select("item_id", "r.summary", "r.faithfulness_score", "r.withheld", "r.withhold_reason", F.array_join("r.provenance", ",").alias("provenance"), "r.error_code")


@query("batch_outcome", "SELECT job_id, count(*) AS n_items, count(error_code) AS n_failures, CASE WHEN count(error_code) = 0 THEN 'succeeded' WHEN count(error_code) = count(*) THEN 'failed' ELSE 'partial' END AS status FROM summarize_job_item GROUP BY job_id", "summarize_job_item")
def batch_outcome(s, d):
    return jobs.batch_outcome(view(s, d, "summarize_job_item"))


# --- jobs --------------------------------------------------------------------------------------


@query("jobs_claimable", "SELECT id, status FROM summarize_job WHERE (status = 'queued' OR (status = 'running' AND claimed_at < {jobs_now} - {min:5})) AND next_attempt_at <= {jobs_now}", "summarize_job")
def jobs_claimable(s, d):
    return jobs.claimable(view(s, d, "summarize_job"), ts(JOBS_NOW)).select("id", "status")


@query("job_claim_next", "SELECT id, 'running' AS status, attempts + 1 AS attempts FROM summarize_job WHERE (status = 'queued' OR (status = 'running' AND claimed_at < {jobs_now} - {min:5})) AND next_attempt_at <= {jobs_now} ORDER BY next_attempt_at, id LIMIT 1", "summarize_job")
def job_claim_next(s, d):
    return jobs.claim_next(view(s, d, "summarize_job"), "w", ts(JOBS_NOW)).select("id", "status", "attempts")


# Five documents a job, but one in 100 alone in a job of its own that fails; the jobs after the last document have no items.
_JOB = "2 * (doc_id {div} 5) + CASE WHEN doc_id % 100 = 7 THEN 1 ELSE 0 END"


@query("job_run_all", f"SELECT id, CASE WHEN bad = 0 THEN 'succeeded' WHEN bad = n THEN 'failed' ELSE 'partial' END AS status, {{jobs_now}} + {{min:1440}} AS expires_at FROM (SELECT j.id, count(i.doc_id) AS n, count(CASE WHEN length(i.text) > 20000 OR i.doc_id % 50 = 7 THEN 1 END) AS bad FROM summarize_job j LEFT JOIN (SELECT *, {_JOB.format(div='//')} AS job_id FROM documents) i ON i.job_id = j.id GROUP BY j.id) t", "summarize_job")
def job_run_all(s, d):
    docs = readers.table(s, d, "documents")
    doc = F.array(F.struct(F.col("source"), F.lit("").alias("title"), F.col("text"), F.lit(None).cast("string").alias("url")))
    items = docs.select(F.col("doc_id").alias("id"), F.expr(_JOB.format(div="DIV")).alias("job_id"), F.concat(F.lit("i"), "doc_id").alias("item_id"), F.when(F.col("doc_id") % 50 != 7, doc).alias("documents"))
    return jobs.run(view(s, d, "summarize_job"), items, ts(JOBS_NOW))[0].select("id", "status", "expires_at")


@query("job_read_state", "SELECT id, CASE WHEN {jobs_now} >= expires_at THEN 'expired' ELSE status END AS status, {jobs_now} < expires_at AND status IN ('succeeded', 'partial', 'failed', 'expired') AS has_results FROM summarize_job", "summarize_job")
def job_read_state(s, d):
    return jobs.read_state(view(s, d, "summarize_job"), ts(JOBS_NOW)).select("id", "status", "has_results")


@query("job_owned", "SELECT id, consumer FROM summarize_job WHERE id = 5 AND consumer = (SELECT consumer FROM summarize_job WHERE id = 5)", "summarize_job")
def job_owned(s, d):
    all_jobs = view(s, d, "summarize_job")
    row = all_jobs.where("id = 5").select("public_id", "consumer").first()
    return jobs.owned(all_jobs, row.public_id.upper(), row.consumer).select("id", "consumer")


@query("job_results", "SELECT job_id, item_id, coalesce(summary, '') AS summary, round(coalesce(faithfulness_score, 0.0), 6) AS faithfulness_score, withheld FROM summarize_job_item WHERE error_code IS NULL AND withheld IS NOT NULL", "summarize_job_item")
def job_results(s, d):
    items = view(s, d, "summarize_job_item").withColumn("provenance", F.lit(None).cast("array<string>"))
    return jobs.results(items).select("job_id", "item_id", "summary", F.round("faithfulness_score", 6).alias("faithfulness_score"), "withheld")


@query("job_errors", "SELECT job_id, item_id, error_code, error_message FROM summarize_job_item WHERE error_code IS NOT NULL", "summarize_job_item")
def job_errors(s, d):
    return jobs.errors(view(s, d, "summarize_job_item"))


@query("job_items", "SELECT j.id, j.status, string_agg(i.item_id, ',' ORDER BY i.item_id, i.id) AS items FROM summarize_job j LEFT JOIN summarize_job_item i ON i.job_id = j.id GROUP BY j.id, j.status", "summarize_job", "summarize_job_item")
def job_items(s, d):
    packed = jobs.with_items(view(s, d, "summarize_job"), view(s, d, "summarize_job_item").select("id", "job_id", "item_id"))
    return packed.select("id", "status", F.array_join(F.transform("items", lambda x: x["item_id"]), ",").alias("items"))


@query("job_idempotency", "SELECT r.request_id, CASE WHEN l.job_id IS NOT NULL OR f.first_id < r.request_id THEN 'replayed' ELSE 'created' END AS verdict, l.job_id, CASE WHEN l.job_id IS NULL THEN coalesce(f.first_id, r.request_id) END AS created_by FROM request r LEFT JOIN (SELECT consumer, idempotency_key, min(id) AS job_id FROM summarize_job WHERE expires_at > {jobs_now} AND idempotency_key IS NOT NULL GROUP BY consumer, idempotency_key) l ON l.consumer = r.consumer AND l.idempotency_key = r.idempotency_key LEFT JOIN (SELECT consumer, idempotency_key, min(request_id) AS first_id FROM request WHERE idempotency_key IS NOT NULL GROUP BY consumer, idempotency_key) f ON f.consumer = r.consumer AND f.idempotency_key = r.idempotency_key", "summarize_job", "request")
def job_idempotency(s, d):
    return jobs.enqueue(view(s, d, "summarize_job"), view(s, d, "request"), ts(JOBS_NOW)).select("request_id", "verdict", "job_id", "created_by")


@query("sweep_inputs", "SELECT j.status, count(*) AS n_changed FROM summarize_job_item i JOIN summarize_job j ON i.job_id = j.id WHERE i.has_documents AND j.status IN ('succeeded', 'partial', 'failed', 'expired') GROUP BY j.status", "summarize_job", "summarize_job_item")
def sweep_inputs(s, d):
    docs = F.when(F.col("has_documents"), F.array(F.lit("x")))
    all_jobs = view(s, d, "summarize_job")
    changed = jobs.discard_inputs(all_jobs, view(s, d, "summarize_job_item").withColumn("documents", docs))[1]
    return changed.join(all_jobs.select(F.col("id").alias("job_id"), "status"), "job_id").groupBy("status").agg(F.count(F.lit(1)).alias("n_changed"))


_GONE = "SELECT id FROM summarize_job WHERE expires_at <= {jobs_now} ORDER BY id LIMIT 1000"


@query("sweep_survivors", f"SELECT status, count(*) AS n_jobs FROM summarize_job WHERE id NOT IN ({_GONE}) GROUP BY status", "summarize_job")
def sweep_survivors(s, d):
    return jobs.sweep(view(s, d, "summarize_job"), view(s, d, "summarize_job_item"), ts(JOBS_NOW))[0].groupBy("status").agg(F.count(F.lit(1)).alias("n_jobs"))


@query("sweep_items_left", f"SELECT item_id, count(*) AS n FROM summarize_job_item WHERE job_id NOT IN ({_GONE}) GROUP BY item_id", "summarize_job", "summarize_job_item")
def sweep_items_left(s, d):
    return jobs.sweep(view(s, d, "summarize_job"), view(s, d, "summarize_job_item"), ts(JOBS_NOW))[1].groupBy("item_id").agg(F.count(F.lit(1)).alias("n"))


@query("sweep_overdue", "SELECT least(count(*), 1000) AS deleted, count(*) - least(count(*), 1000) AS overdue FROM summarize_job WHERE expires_at <= {jobs_now}", "summarize_job")
def sweep_overdue(s, d):
    return jobs.sweep(view(s, d, "summarize_job"), view(s, d, "summarize_job_item"), ts(JOBS_NOW))[2]


# --- integrity ---------------------------------------------------------------------------------


@query("violations_check", "SELECT id AS row_key, 'score_range' AS rule FROM summarize_job_item WHERE faithfulness_score > 1 UNION ALL SELECT id, 'wire_withhold_reason' FROM summarize_job_item WHERE withhold_reason = 'other' UNION ALL SELECT article_id, 'body_provenance_domain' FROM canonical_record WHERE body_provenance = 'scraped' UNION ALL SELECT work_id, 'one_subject' FROM pipeline_work WHERE (article_id IS NULL) = (cluster_id IS NULL)", "summarize_job_item", "canonical_record", "pipeline_work")
def violations_check(s, d):
    parts = (("summarize_job_item", "id"), ("canonical_record", "article_id"), ("pipeline_work", "work_id"))
    return reduce(DataFrame.unionByName, [validation.check_violations(t, view(s, d, t), k) for t, k in parts])


@query("violations_unique", "SELECT 'source_guid' AS rule, CAST(source_id AS VARCHAR) || '|' || guid AS key, count(*) AS n FROM alternate_copy WHERE guid IS NOT NULL GROUP BY source_id, guid HAVING count(*) > 1 UNION ALL SELECT 'url', url, count(*) FROM alternate_copy GROUP BY url HAVING count(*) > 1", "alternate_copy")
def violations_unique(s, d):
    return validation.unique_violations("alternate_copy", view(s, d, "alternate_copy"))


@query("violations_open_work", "SELECT 'open_article' AS rule, CAST(article_id AS VARCHAR) AS key, count(*) AS n FROM (SELECT article_id - article_id % 2 AS article_id FROM pipeline_work WHERE dead_lettered_at IS NULL AND article_id IS NOT NULL) t GROUP BY article_id HAVING count(*) > 1", "pipeline_work")
def violations_open_work(s, d):
    work = view(s, d, "pipeline_work").withColumn("article_id", F.col("article_id") - F.col("article_id") % 2)
    return validation.unique_violations("pipeline_work", work.withColumn("cluster_id", F.lit(None).cast("bigint")))


@query("violations_fk", "SELECT alternate_copy_id, article_id FROM alternate_copy a WHERE NOT EXISTS (SELECT 1 FROM canonical_record r WHERE r.article_id = a.article_id AND r.terminal_reason IS NULL)", "alternate_copy", "canonical_record")
def violations_fk(s, d):
    records = view(s, d, "canonical_record").where("terminal_reason IS NULL")
    return validation.foreign_key_violations(view(s, d, "alternate_copy"), "article_id", records, "article_id").select("alternate_copy_id", "article_id")


@query("delete_restricted", "SELECT source_id FROM source WHERE source_id IN (SELECT source_id FROM takedown)", "source", "takedown")
def delete_restricted(s, d):
    return validation.restricted(view(s, d, "source"), "source_id", view(s, d, "takedown"), "source_id").select("source_id")


@query("delete_cascade", "SELECT 'alternate_copy' AS tbl, count(*) AS n FROM alternate_copy WHERE article_id % 10 <> 0 UNION ALL SELECT 'pipeline_work', count(*) FROM pipeline_work WHERE article_id IS NULL OR article_id % 10 <> 0 UNION ALL SELECT 'canonical_record', count(*) FROM canonical_record WHERE article_id % 10 <> 0", "alternate_copy", "pipeline_work", "canonical_record")
def delete_cascade(s, d):
    tables = {t: view(s, d, t) for t in ("canonical_record", "alternate_copy", "pipeline_work")}
    left = validation.cascade(tables, "canonical_record", tables["canonical_record"].where("article_id % 10 = 0"))
    return reduce(DataFrame.unionByName, [left[t].agg(F.count(F.lit(1)).alias("n")).select(F.lit(t).alias("tbl"), "n") for t in tables])


# --- fingerprints and limits -------------------------------------------------------------------


@query("simhash_encode", "SELECT article_id, simhash FROM canonical_record", "canonical_record")
def simhash_encode(s, d):
    df = view(s, d, "canonical_record").select("article_id", bits.simhash_from_db(F.col("simhash")).alias("u"))
    return df.select("article_id", bits.simhash_to_db(F.col("u")).alias("simhash"))


@query("simhash_decode", "SELECT article_id, CAST(CASE WHEN simhash < 0 THEN CAST(simhash AS HUGEINT) + 18446744073709551616 ELSE simhash END AS VARCHAR) AS simhash FROM canonical_record", "canonical_record")
def simhash_decode(s, d):
    return view(s, d, "canonical_record").select("article_id", bits.simhash_from_db(F.col("simhash")).cast("string").alias("simhash"))


@query("simhash_hamming", "SELECT a.article_id, CAST(bit_count(xor(a.simhash, b.simhash)) AS INT) AS distance FROM canonical_record a JOIN canonical_record b ON b.article_id = a.article_id + 1", "canonical_record")
def simhash_hamming(s, d):
    df = view(s, d, "canonical_record").select("article_id", "simhash")
    other = df.select((F.col("article_id") - 1).alias("article_id"), F.col("simhash").alias("other"))
    return df.join(other, "article_id").select("article_id", bits.hamming(F.col("simhash"), F.col("other")).cast("int").alias("distance"))


def _limit_sql(bucket: str, limit: int) -> str:
    rows = f"SELECT CAST(user_id AS VARCHAR) AS consumer, {bucket} AS bucket, event_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id, {bucket} ORDER BY ts, event_id) AS k FROM events"
    size = 86400000000
    return f"WITH RECURSIVE r AS ({rows}), f AS (SELECT consumer, bucket, event_id, us, k, us AS s0, CAST(1 AS BIGINT) AS n, true AS allowed FROM r WHERE k = 1 UNION ALL SELECT r.consumer, r.bucket, r.event_id, r.us, r.k, CASE WHEN r.us - f.s0 >= {size} THEN r.us ELSE f.s0 END, CASE WHEN r.us - f.s0 >= {size} THEN 1 WHEN f.n < {limit} THEN f.n + 1 ELSE f.n END, r.us - f.s0 >= {size} OR f.n < {limit} FROM f JOIN r ON r.consumer = f.consumer AND r.bucket = f.bucket AND r.k = f.k + 1) SELECT consumer, bucket, event_id AS request_id, allowed, CASE WHEN allowed THEN 0 ELSE greatest(1, CAST(ceil((s0 + {size} - us) / 1000000.0) AS BIGINT)) END AS retry_after FROM f"


@query("rate_limit_decisions", _limit_sql("'all'", 1))
def rate_limit_decisions(s, d):
    rows = readers.table(s, d, "events").selectExpr("CAST(user_id AS STRING) AS consumer", "'all' AS bucket", "ts", "event_id AS request_id")
    return limits.decisions(rows, 1, 86400, ("consumer", "bucket"))


@query("rate_limit_buckets", _limit_sql("CASE WHEN event_type = 'view' THEN 'poll' ELSE 'inference' END", 2))
def rate_limit_buckets(s, d):
    rows = readers.table(s, d, "events").selectExpr("CAST(user_id AS STRING) AS consumer", "CASE WHEN event_type = 'view' THEN 'poll' ELSE 'inference' END AS bucket", "ts", "event_id AS request_id")
    return limits.decisions(rows, 2, 86400, ("consumer", "bucket"))


# --- extensions --------------------------------------------------------------------------------


@query("dedup_exact", "SELECT article_id, min(article_id) OVER (PARTITION BY content_hash) AS representative_id FROM canonical_record", "canonical_record")
def dedup_exact(s, d):
    return extensions.collapse_exact(view(s, d, "canonical_record"))


@query("dedup_near_all", "SELECT a.code AS a, b.code AS b, CAST(bit_count(xor(a.code, b.code)) AS INT) AS distance FROM (SELECT DISTINCT simhash AS code FROM canonical_record) a JOIN (SELECT DISTINCT simhash AS code FROM canonical_record) b ON a.code < b.code WHERE bit_count(xor(a.code, b.code)) <= 3", "canonical_record")
def dedup_near_all(s, d):
    return extensions.near_pairs(view(s, d, "canonical_record"))


@query("distinct_sources", "SELECT m.cluster_id, count(DISTINCT m.article_id) AS article_count, count(DISTINCT x.source_id) AS distinct_source_count FROM member m JOIN (SELECT article_id, source_id FROM canonical_record UNION ALL SELECT article_id, source_id FROM alternate_copy) x ON x.article_id = m.article_id GROUP BY m.cluster_id", "member", "canonical_record", "alternate_copy")
def distinct_sources(s, d):
    return extensions.distinct_sources(view(s, d, "member"), view(s, d, "canonical_record"), view(s, d, "alternate_copy"))


@query("topic_vote", "SELECT cluster_id, max(CASE WHEN r = 1 THEN topic END) AS representative_topic, round(max(CASE WHEN r = 1 THEN v END) - coalesce(max(CASE WHEN r = 2 THEN v END), 0), 6) AS topic_margin FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY v DESC, topic) AS r FROM (SELECT cluster_id, topic, CAST(round(sum(confidence), 6) AS DOUBLE) AS v FROM classification GROUP BY cluster_id, topic) a) b GROUP BY cluster_id", "classification")
def topic_vote(s, d):
    c = view(s, d, "classification").withColumn("confidence", F.col("confidence").cast("decimal(10,2)"))
    found = extensions.topic_vote(c.select("article_id", "cluster_id"), c.select("article_id", "topic", "confidence"))
    return found.withColumn("topic_margin", F.round(F.col("topic_margin").cast("double"), 6))


@query("withhold_reason", "SELECT cluster_id, CASE WHEN n < 2 THEN 'insufficient_sources' WHEN NOT has_rights THEN 'rights_excluded' WHEN (cluster_id % 10) / 10.0 < 0.6 THEN 'below_faithfulness_bar' ELSE 'none' END AS reason FROM (SELECT m.cluster_id, count(DISTINCT r.source_id) AS n, max(CASE WHEN s.rights_level = 'body_text' THEN 1 ELSE 0 END) = 1 AS has_rights FROM member m JOIN canonical_record r ON r.article_id = m.article_id JOIN source s ON s.source_id = r.source_id GROUP BY m.cluster_id) t", "member", "canonical_record", "source")
def withhold_reason(s, d):
    rows = view(s, d, "member").join(view(s, d, "canonical_record").select("article_id", "source_id"), "article_id").join(view(s, d, "source").select("source_id", "rights_level"), "source_id")
    g = rows.groupBy("cluster_id").agg(F.countDistinct("source_id").alias("n"), F.max(F.when(F.col("rights_level") == "body_text", True).otherwise(False)).alias("ok"))
    return g.select("cluster_id", extensions.withhold_reason(F.col("n"), F.col("ok"), (F.col("cluster_id") % 10) / 10).alias("reason"))


@query("takedown_filter", "SELECT article_id FROM canonical_record r WHERE NOT EXISTS (SELECT 1 FROM takedown t WHERE t.source_id = r.source_id AND t.guid = r.guid) AND NOT EXISTS (SELECT 1 FROM takedown t WHERE t.url_canonical = r.url_canonical) AND NOT EXISTS (SELECT 1 FROM takedown t WHERE t.content_hash = r.content_hash)", "canonical_record", "takedown")
def takedown_filter(s, d):
    return extensions.not_taken_down(view(s, d, "canonical_record"), view(s, d, "takedown")).select("article_id")


@query("drop_language", "SELECT coalesce(terminal_reason, 'live') AS reason, count(*) AS n FROM (SELECT CASE WHEN language <> 'en' THEN 'dropped_language' END AS terminal_reason FROM canonical_record) t GROUP BY 1", "canonical_record")
def drop_language(s, d):
    fresh = view(s, d, "canonical_record").withColumn("terminal_reason", F.lit(None).cast("string"))
    return extensions.drop_language(fresh).groupBy(F.coalesce("terminal_reason", F.lit("live")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query("browse_projection", "SELECT topic, count(DISTINCT cluster_id) AS n_clusters, count(*) AS n_articles, min(article_id) AS first_article FROM (SELECT m.cluster_id, m.article_id, 'topic' || CAST(m.cluster_id % 6 AS VARCHAR) AS topic FROM member m JOIN canonical_record r ON r.article_id = m.article_id) t GROUP BY topic", "member", "canonical_record")
def browse_projection(s, d):
    members = view(s, d, "member")
    topics = members.select("cluster_id", F.concat(F.lit("topic"), F.col("cluster_id") % 6).alias("representative_topic")).distinct()
    return extensions.browse(topics, members, view(s, d, "canonical_record"))


@query("input_fingerprints", "SELECT cluster_id, sha256(string_agg(CAST(m.article_id AS VARCHAR) || ':' || content_hash, '|' ORDER BY m.article_id)) AS input_fingerprint FROM member m JOIN canonical_record r ON r.article_id = m.article_id GROUP BY cluster_id", "member", "canonical_record")
def input_fingerprints(s, d):
    return extensions.input_fingerprint(view(s, d, "member"), view(s, d, "canonical_record"))


@query("latest_upsert", "SELECT article_id, topic FROM (SELECT vec_id % 50 AS article_id, 'topic' || CAST(label AS VARCHAR) AS topic, row_number() OVER (PARTITION BY vec_id % 50 ORDER BY vec_id DESC) AS r FROM embeddings) t WHERE r = 1")
def latest_upsert(s, d):
    rows = readers.table(s, d, "embeddings").selectExpr("vec_id % 50 AS article_id", "concat('topic', label) AS topic", "vec_id AS version")
    return jobs.latest(rows, ["article_id"], ["version"]).select("article_id", "topic")


@query("census_drift", "SELECT coalesce(a.type, b.type) AS type, a.n AS n_a, b.n AS n_b FROM (SELECT event_type AS type, count(*) AS n FROM events WHERE event_id % 2 = 0 GROUP BY 1) a FULL JOIN (SELECT event_type AS type, count(*) AS n FROM events WHERE event_id % 2 = 1 AND event_type <> 'error' GROUP BY 1) b ON a.type = b.type WHERE a.n IS DISTINCT FROM b.n")
def census_drift(s, d):
    nodes = readers.table(s, d, "events").withColumnRenamed("event_type", "type")
    return extensions.census_drift(extensions.census(nodes.where("event_id % 2 = 0")), extensions.census(nodes.where("event_id % 2 = 1 AND type <> 'error'")))


@query("cluster_evict", "SELECT cluster_id, CASE WHEN latest_at < TIMESTAMP '2024-01-29 12:00:00' - INTERVAL 1 DAY THEN 'evicted' ELSE 'open' END AS window_status FROM (SELECT user_id AS cluster_id, max(ts) AS latest_at FROM events GROUP BY user_id) t")
def cluster_evict(s, d):
    clusters = readers.table(s, d, "events").groupBy(F.col("user_id").alias("cluster_id")).agg(F.max("ts").alias("latest_at")).withColumn("window_status", F.lit("open"))
    return extensions.evict(clusters, ts("2024-01-29 12:00:00"), 1).select("cluster_id", "window_status")


@query("fallback_reasons", "SELECT reason, count(*) AS n FROM (SELECT CASE WHEN vec_id % 7 = 0 THEN 'service_unavailable' WHEN (vec_id % 100) / 100.0 < 0.5 THEN 'low_confidence' ELSE 'none' END AS reason FROM embeddings) t GROUP BY reason")
def fallback_reasons(s, d):
    confidence = F.when(F.col("vec_id") % 7 != 0, (F.col("vec_id") % 100) / 100)
    rows = readers.table(s, d, "embeddings").select(extensions.fallback_reason(confidence).alias("reason"))
    return rows.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


# --- the wire ----------------------------------------------------------------------------------


@query("wire_classify_requests", "SELECT doc_id, CASE WHEN doc_id % 9 > 0 THEN 1 END AS n_items, CASE WHEN doc_id % 9 > 0 THEN length(text) END AS n_chars FROM documents")
def wire_classify_requests(s, d):
    item = F.struct(F.concat(F.lit("d"), "doc_id").alias("id"), F.lit("").alias("title"), "text")
    body = F.when(F.col("doc_id") % 9 > 0, F.to_json(F.struct(F.array(item).alias("items")))).otherwise("no json")
    parsed = readers.read_requests(readers.table(s, d, "documents").withColumn("body", body), readers.CLASSIFY_REQUEST)
    items = F.col("request.items")
    return parsed.select("doc_id", F.when(items.isNotNull(), F.size(items)).alias("n_items"), F.length(F.get(items, 0)["text"]).cast("bigint").alias("n_chars"))


@query("wire_job_bodies", "SELECT j.id, '{\"public_id\":\"' || j.public_id || '\",\"status\":\"' || j.status || '\",\"items\":[' || string_agg('{\"item_id\":\"' || i.item_id || '\",\"id\":' || CAST(i.id AS VARCHAR) || '}', ',' ORDER BY i.item_id, i.id) || ']}' AS body FROM summarize_job j JOIN summarize_job_item i ON i.job_id = j.id GROUP BY j.id, j.public_id, j.status", "summarize_job", "summarize_job_item")
def wire_job_bodies(s, d):
    packed = jobs.with_items(view(s, d, "summarize_job"), view(s, d, "summarize_job_item").select("id", "job_id", "item_id"))
    return readers.job_json(packed.where("items IS NOT NULL"))


_HANDLES = ("0A0a0a0a-0000-4000-8000-00000000000b", "nonsense", "", "0a0a0a0a-0000-4000-8000-00000000000g", "{0a0a0a0a-0000-4000-8000-00000000000b}", "urn:uuid:0a0a0a0a-0000-4000-8000-00000000000b", "0a0a0a0a00004000800000000000000B", "0a0a0a0a-0000-4000-8000-0000000000")


@query("public_ids", f"SELECT v, CASE WHEN regexp_full_match(h, '[0-9a-f]{{32}}') THEN substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21) END AS public_id FROM (SELECT v, replace(lower(trim(replace(replace(v, 'urn:', ''), 'uuid:', ''), '{{}}')), '-', '') AS h FROM (VALUES {', '.join(f"('{x}')" for x in _HANDLES)}) t(v)) u")
def public_ids(s, d):
    return s.createDataFrame([(x,) for x in _HANDLES], "v string").select("v", inference.public_id(F.col("v")).alias("public_id"))


@query("bearer_tokens", "SELECT * FROM (VALUES (1, 'abc'), (2, NULL), (3, NULL), (4, 'x y')) t(id, token)")
def bearer_tokens(s, d):
    df = s.createDataFrame([(1, "Bearer  abc "), (2, "Bearer   "), (3, "Basic abc"), (4, "bearer x y")], "id int, header string")
    return df.select("id", inference.bearer_token(F.col("header")).alias("token"))


_ROSTER_SQL = "SELECT doc_id, position, CASE WHEN kind IN (1, 2) THEN NULL ELSE 'n' || CAST(doc_id AS VARCHAR) END AS name, rate, enabled, fault FROM (SELECT doc_id, doc_id % 9 AS kind, CASE WHEN doc_id % 9 = 1 THEN NULL ELSE 0 END AS position, CASE doc_id % 9 WHEN 1 THEN NULL WHEN 2 THEN NULL WHEN 3 THEN 7 WHEN 4 THEN NULL WHEN 6 THEN 3 WHEN 8 THEN NULL ELSE 5 END AS rate, CASE doc_id % 9 WHEN 1 THEN NULL WHEN 2 THEN NULL WHEN 5 THEN false ELSE true END AS enabled, CASE doc_id % 9 WHEN 1 THEN 'not an array of objects' WHEN 2 THEN 'not an object' WHEN 4 THEN 'rate_limit_per_min is missing' WHEN 7 THEN 'rights_level is unknown' WHEN 8 THEN 'rate_limit_per_min is no number' END AS fault FROM documents WHERE doc_id % 9 <> 0) t"


# Of nine documents one has an empty roster, one an object, and seven an array of one entry, sound or faulty.
@query("roster_entries", _ROSTER_SQL)
def roster_entries(s, d):
    kind = F.col("doc_id") % 9
    rate = F.when(kind == 3, '"7"').when(kind == 6, "3.9").when(kind == 8, '"3.9"').otherwise("5")
    entry = F.concat(
        F.lit('{"name": "n'), F.col("doc_id"), F.lit('", "home_url": "https://x.example", "discovery_method": "rss", "acquisition_tier": "1_full_feed", "rights_level": "'), F.when(kind == 7, "all").otherwise("body_text"),
        F.lit('", "jurisdiction": "GB"'), F.when(kind == 4, "").otherwise(F.concat(F.lit(', "rate_limit_per_min": '), rate)), F.when(kind == 5, ', "enabled": 0').otherwise(""), F.lit("}"),
    )
    body = F.when(kind == 0, " []").when(kind == 1, entry).when(kind == 2, "[3]").otherwise(F.concat(F.lit("\n["), entry, F.lit("]")))
    rows = readers.parse_roster(readers.table(s, d, "documents").select("doc_id", body.alias("value")), keys=("doc_id",))
    return rows.select("doc_id", "position", "name", F.col("rate_limit_per_min").alias("rate"), "enabled", "fault")


@query("wire_summarize_requests", "SELECT doc_id, CASE doc_id % 8 WHEN 0 THEN 'items' WHEN 1 THEN 'items.1.documents' WHEN 2 THEN 'items' WHEN 3 THEN 'max_sentences' WHEN 4 THEN 'style' WHEN 7 THEN 'items' END AS fault, CASE doc_id % 8 WHEN 0 THEN false WHEN 5 THEN true WHEN 7 THEN NULL ELSE false END AS is_async, CASE WHEN doc_id % 8 BETWEEN 1 AND 6 THEN length(text) END AS n_chars FROM documents")
def wire_summarize_requests(s, d):
    kind = F.col("doc_id") % 8
    doc = F.struct("source", F.lit("").alias("title"), "text", F.lit("").alias("url"))
    item = lambda name, docs: F.struct(F.lit(name).alias("id"), docs.alias("documents"))
    items = F.when(kind == 0, F.array().cast("array<struct<id:string,documents:array<struct<source:string,title:string,text:string,url:string>>>>")).when(kind == 1, F.array(item("a", F.array(doc)), item("b", F.slice(F.array(doc), 1, 0)))).when(kind == 2, F.array(item("a", F.array(doc)), item("a", F.array(doc))))
    items = items.when(kind == 5, F.array(item("a", F.array(doc)), item("b", F.array(doc)), item("c", F.array(doc)))).otherwise(F.array(item("a", F.array(doc))))
    body = F.to_json(F.struct(items.alias("items"), F.when(kind == 3, 0).when(kind == 6, 2).alias("max_sentences"), F.when(kind == 4, "terse").when(kind == 6, "neutral").alias("style")))
    parsed = readers.read_requests(readers.table(s, d, "documents").withColumn("body", F.when(kind == 7, "[]x").otherwise(body)), readers.SUMMARIZE_REQUEST)
    chars = F.length(F.get(F.get(F.col("request.items"), 0)["documents"], 0)["text"]).cast("bigint")
    return parsed.select("doc_id", inference.summarize_fault(F.col("request")).alias("fault"), inference.is_async(F.col("request.items")).alias("is_async"), chars.alias("n_chars"))


@query("error_envelopes", "SELECT doc_id, CASE WHEN 400 + doc_id % 150 = 404 THEN 'not_found' WHEN 400 + doc_id % 150 >= 500 THEN 'internal' ELSE 'invalid_request' END AS code FROM documents")
def error_envelopes(s, d):
    return readers.table(s, d, "documents").select("doc_id", inference.error_code(400 + F.col("doc_id") % 150).alias("code"))


@query("secret_matches", "SELECT c_custkey, coalesce(c_name = CASE c_custkey % 3 WHEN 0 THEN c_name WHEN 1 THEN c_name || ' ' END, false) AS same FROM customer")
def secret_matches(s, d):
    other = F.when(F.col("c_custkey") % 3 == 0, F.col("c_name")).when(F.col("c_custkey") % 3 == 1, F.concat("c_name", F.lit(" ")))
    return readers.table(s, d, "customer").select("c_custkey", inference.same_secret(F.col("c_name"), other).alias("same"))


@query("safe_identifiers", "SELECT c_custkey, regexp_full_match(n, '[A-Za-z_][A-Za-z0-9_]*') AS safe FROM (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN replace(c_name, '#', '_') WHEN 1 THEN c_name WHEN 2 THEN '1' || replace(c_name, '#', '') ELSE replace(c_name, '#', '') || chr(10) END AS n FROM customer) t")
def safe_identifiers(s, d):
    k, bare = F.col("c_custkey") % 4, F.regexp_replace("c_name", "#", "")
    name = F.when(k == 0, F.regexp_replace("c_name", "#", "_")).when(k == 1, F.col("c_name")).when(k == 2, F.concat(F.lit("1"), bare)).otherwise(F.concat(bare, F.lit("\n")))
    return readers.table(s, d, "customer").select("c_custkey", inference.safe_identifier(name).alias("safe"))


# --- settings, vocabularies and further integrity ----------------------------------------------

_SETTING = "CASE c_custkey % 3 WHEN 0 THEN 'token' WHEN 1 THEN 'retention_hours' ELSE 'database_url' END"
_SETTING_VALUE = "CASE WHEN c_custkey % 7 = 0 THEN NULL WHEN c_custkey % 3 = 1 THEN CAST(c_custkey % 5 - 1 AS {str}) WHEN c_custkey % 2 = 0 THEN c_name || c_name ELSE c_name END"


@query("setting_faults", f"SELECT c_custkey, CASE WHEN v IS NULL THEN 'missing' WHEN k = 'retention_hours' AND CAST(v AS INT) < 1 THEN 'not_positive' WHEN k = 'token' AND length(v) < 32 THEN 'too_short' END AS fault FROM (SELECT c_custkey, {_SETTING} AS k, {_SETTING_VALUE.replace('{str}', 'VARCHAR')} AS v FROM customer) t")
def setting_faults(s, d):
    rows = readers.table(s, d, "customer").selectExpr("c_custkey", f"{_SETTING} AS k", f"{_SETTING_VALUE.replace('{str}', 'STRING')} AS v")
    return rows.select("c_custkey", settings.setting_fault(F.col("k"), F.col("v")).alias("fault"))


@query("vocabularies", "SELECT tbl, \"column\", value FROM (VALUES " + ", ".join(f"('{t}', '{c}', '{v}')" for t, c, v in (
    ("source", "discovery_method", "rss"), ("source", "discovery_method", "sitemap"), ("source", "discovery_method", "websub"), ("source", "discovery_method", "section_scrape"),
    ("source", "acquisition_tier", "1_full_feed"), ("source", "acquisition_tier", "2_publisher_api"), ("source", "acquisition_tier", "3_extraction"), ("source", "rights_level", "body_text"), ("source", "rights_level", "headline_only"),
    ("canonical_record", "body_provenance", "tier1_feed"), ("canonical_record", "body_provenance", "tier2_api"), ("canonical_record", "body_provenance", "tier3_extracted"),
    ("canonical_record", "pipeline_state", "discovered"), ("canonical_record", "pipeline_state", "acquired"), ("canonical_record", "pipeline_state", "classified"), ("canonical_record", "pipeline_state", "clustered"),
    ("canonical_record", "terminal_reason", "failed"), ("canonical_record", "terminal_reason", "dropped_language"), ("classification", "fallback_reason", "none"), ("classification", "fallback_reason", "low_confidence"), ("classification", "fallback_reason", "service_unavailable"),
    ("cluster", "window_status", "open"), ("cluster", "window_status", "evicted"), ("summary", "withhold_reason", "none"), ("summary", "withhold_reason", "below_faithfulness_bar"), ("summary", "withhold_reason", "rights_excluded"), ("summary", "withhold_reason", "insufficient_sources"),
    ("takedown", "scope", "representative"), ("takedown", "scope", "alternate_copy"), ("pipeline_work", "stage", "acquire"), ("pipeline_work", "stage", "classify"), ("pipeline_work", "stage", "cluster"), ("pipeline_work", "stage", "summarize"),
    ("summarize_job", "status", "queued"), ("summarize_job", "status", "running"), ("summarize_job", "status", "succeeded"), ("summarize_job", "status", "partial"), ("summarize_job", "status", "failed"), ("summarize_job", "status", "expired"),
)) + ") t(tbl, \"column\", value)")
def vocabularies(s, d):
    return validation.vocabularies(s)


@query("violations_source_summary", "SELECT source_id AS row_key, 'rate_limit_positive' AS rule FROM source WHERE rate_limit_per_min - 9 <= 0 UNION ALL SELECT cluster_id, 'withheld_agrees' FROM summary WHERE NOT coalesce((withheld AND withhold_reason <> 'none' AND text IS NULL) OR (NOT withheld AND withhold_reason = 'none'), true) UNION ALL SELECT cluster_id, 'withhold_reason_domain' FROM summary WHERE withhold_reason = 'too_short'", "source", "summary")
def violations_source_summary(s, d):
    sources = view(s, d, "source").withColumn("rate_limit_per_min", F.col("rate_limit_per_min") - 9)
    return validation.check_violations("source", sources, "source_id").unionByName(validation.check_violations("summary", view(s, d, "summary"), "cluster_id"))


@query("violations_wire", "SELECT vec_id AS row_key, 'confidence_range' AS rule FROM embeddings WHERE vec_id % 130 > 110 OR vec_id % 130 < 10 UNION ALL SELECT vec_id, 'score_range' FROM embeddings WHERE vec_id % 90 > 80")
def violations_wire(s, d):
    rows = readers.table(s, d, "embeddings").selectExpr("vec_id", "CASE WHEN vec_id % 130 > 110 THEN 1.01 WHEN vec_id % 130 < 10 THEN -0.5 WHEN vec_id % 130 > 100 THEN NULL ELSE (vec_id % 101) / 100.0 END AS confidence", "CASE WHEN vec_id % 90 > 80 THEN 1.5 WHEN vec_id % 90 > 60 THEN NULL ELSE 1.0 END AS faithfulness_score")
    return validation.check_violations("wire_result", rows, "vec_id")


@query("violations_unique_jobs", "SELECT 'idempotency' AS rule, consumer || '|' || idempotency_key AS key, count(*) AS n FROM summarize_job WHERE idempotency_key IS NOT NULL GROUP BY consumer, idempotency_key HAVING count(*) > 1", "summarize_job")
def violations_unique_jobs(s, d):
    return validation.unique_violations("summarize_job", view(s, d, "summarize_job")).where("rule = 'idempotency'")


@query("defaults_applied", "SELECT cluster_id, CAST(coalesce(CASE WHEN cluster_id % 2 = 0 THEN cluster_id END, 0) AS INT) AS article_count, 'open' AS window_status, 0 AS distinct_source_count FROM (SELECT doc_id AS cluster_id FROM documents) t")
def defaults_applied(s, d):
    rows = readers.table(s, d, "documents").selectExpr("doc_id AS cluster_id", "CAST(CASE WHEN doc_id % 2 = 0 THEN doc_id END AS INT) AS article_count", "CAST(NULL AS STRING) AS window_status")
    return validation.with_defaults("cluster", rows).select("cluster_id", "article_count", "window_status", "distinct_source_count")


@query("schema_drift", "SELECT * FROM (VALUES ('alternate_copy', 'missing seen_at'), ('cluster_member', 'cluster_id is string, not bigint'), ('cluster_member', 'unknown note')) t(tbl, drift)")
def schema_drift(s, d):
    member = view(s, d, "member").withColumn("cluster_id", F.col("cluster_id").cast("string")).withColumn("note", F.lit(1))
    return validation.drift_table(s, {"alternate_copy": view(s, d, "alternate_copy"), "cluster_member": member})


@query("catalog_lookups", "SELECT * FROM (VALUES ('database', 'default', true), ('database', 'nowhere_at_all', false), ('table', 'nowhere_at_all', false)) t(kind, name, present)")
def catalog_lookups(s, d):
    return readers.present(s, [("database", "default"), ("database", "nowhere_at_all"), ("table", "nowhere_at_all")])


# --- registry and jobs as new states -----------------------------------------------------------


@query("registry_create", "SELECT source_id, name, enabled, created_at, updated_at FROM source UNION ALL SELECT source_id + 1000, 'new ' || name, CASE WHEN source_id % 2 = 0 THEN false ELSE true END, {now}, {now} FROM source", "source")
def registry_create(s, d):
    sources = view(s, d, "source")
    new = sources.withColumns({"source_id": F.col("source_id") + 1000, "name": F.concat(F.lit("new "), "name"), "enabled": F.when(F.col("source_id") % 2 == 0, False)})
    return registry.create(sources, new, ts(NOW)).select("source_id", "name", "enabled", "created_at", "updated_at")


@query("registry_last_patch", "SELECT source_id, 'patch 2 of ' || name AS name, {now} AS updated_at FROM source", "source")
def registry_last_patch(s, d):
    sources = view(s, d, "source")
    patches = sources.select("source_id", "name", F.explode(F.array(F.lit(1), F.lit(2))).alias("position")).withColumn("name", F.concat(F.lit("patch "), "position", F.lit(" of "), "name"))
    return registry.describe(sources, patches, ts(NOW)).select("source_id", "name", "updated_at")


@query("seed_lists", "SELECT string_agg(CASE WHEN NOT known THEN name END, ',' ORDER BY source_id) AS inserted, string_agg(CASE WHEN known THEN name END, ',' ORDER BY source_id) AS skipped FROM (SELECT source_id, name, source_id % 3 = 0 AS known FROM source) t", "source")
def seed_lists(s, d):
    sources = view(s, d, "source")
    url = F.when(F.col("source_id") % 3 == 0, F.col("home_url")).otherwise(F.concat("home_url", F.lit("/new")))
    found = registry.seed_lists(sources, sources.select(F.col("source_id").alias("position"), "name", url.alias("home_url")))
    return found.select(F.array_join("inserted", ",").alias("inserted"), F.array_join("skipped", ",").alias("skipped"))


_LIVE = "SELECT DISTINCT consumer, idempotency_key FROM summarize_job WHERE expires_at > {jobs_now} AND idempotency_key IS NOT NULL"
_MADE = f"SELECT r.consumer, 'queued' AS status FROM (SELECT *, row_number() OVER (PARTITION BY consumer, idempotency_key ORDER BY request_id) AS k FROM request) r LEFT JOIN ({_LIVE}) l ON l.consumer = r.consumer AND l.idempotency_key = r.idempotency_key WHERE l.consumer IS NULL AND (r.idempotency_key IS NULL OR r.k = 1)"
_LEFT = "SELECT id, consumer, status FROM summarize_job j WHERE NOT (expires_at <= {jobs_now} AND idempotency_key IS NOT NULL AND EXISTS (SELECT 1 FROM request r WHERE r.consumer = j.consumer AND r.idempotency_key = j.idempotency_key))"


@query("enqueue_state", f"SELECT consumer, status, count(*) AS n FROM (SELECT consumer, status FROM ({_LEFT}) a UNION ALL SELECT consumer, status FROM ({_MADE}) b) t GROUP BY consumer, status", "summarize_job", "request")
def enqueue_state(s, d):
    requests = view(s, d, "request").withColumn("request_id", F.col("request_id") + 10**9)
    after = jobs.enqueue_state(view(s, d, "summarize_job"), view(s, d, "summarize_job_item"), requests, ts(JOBS_NOW))[0]
    return after.groupBy("consumer", "status").agg(F.count(F.lit(1)).alias("n"))


@query("enqueue_items_left", f"SELECT item_id, count(*) AS n FROM summarize_job_item WHERE job_id IN (SELECT id FROM ({_LEFT}) a) GROUP BY item_id", "summarize_job", "summarize_job_item", "request")
def enqueue_items_left(s, d):
    left = jobs.enqueue_state(view(s, d, "summarize_job"), view(s, d, "summarize_job_item"), view(s, d, "request"), ts(JOBS_NOW))[1]
    return left.groupBy("item_id").agg(F.count(F.lit(1)).alias("n"))


# --- articles, pages and clusters --------------------------------------------------------------


@query("cluster_span", "SELECT cluster_id, count(*) AS article_count, min(published_at) AS earliest_at, max(published_at) AS latest_at FROM published GROUP BY cluster_id", "published")
def cluster_span(s, d):
    return extensions.cluster_span(view(s, d, "published"))


@query("browse_tree", "SELECT topic, string_agg(CAST(cluster_id AS VARCHAR) || ':' || articles, ';' ORDER BY cluster_id) AS tree FROM (SELECT cluster_id, 'topic' || CAST(cluster_id % 6 AS VARCHAR) AS topic, string_agg(CAST(article_id AS VARCHAR), ',' ORDER BY article_id) AS articles FROM member GROUP BY cluster_id) t GROUP BY topic", "member")
def browse_tree(s, d):
    members = view(s, d, "member")
    topics = members.select("cluster_id", F.concat(F.lit("topic"), F.col("cluster_id") % 6).alias("representative_topic")).distinct()
    cluster = lambda c: F.concat(c["cluster_id"].cast("string"), F.lit(":"), F.array_join(F.transform(c["articles"], lambda a: a.cast("string")), ","))
    return extensions.browse_tree(topics, members).select("topic", F.array_join(F.transform("clusters", cluster), ";").alias("tree"))


@query("page_texts", "SELECT page_id, sha256(trim(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(html, '(?is)<!--.*?-->|<script\\b.*?</script>|<style\\b.*?</style>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&amp;', '&'), '[ \\t\\r\\n]+', ' ', 'g'))) AS text_sha256 FROM pages")
def page_texts(s, d):
    return readers.table(s, d, "pages").select("page_id", F.sha2(readers.page_text(F.col("html")), 256).alias("text_sha256"))


_TRACKED = "'([?&])(?:utm_[a-z]+|fbclid|gclid|ref)=[^&]*(?:&|$)', '\\1', 'g'"
_CLEAN = "regexp_replace(trim(u), '#.*$', '')"
for _ in range(4):
    _CLEAN = f"regexp_replace({_CLEAN}, {_TRACKED})"
_HOST = "regexp_extract(v, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*')"


@query("canonical_urls", f"SELECT page_id, rtrim(lower({_HOST}) || substr(v, length({_HOST}) + 1), '/') AS url FROM (SELECT page_id, regexp_replace({_CLEAN}, '[?&]+$', '') AS v FROM (SELECT page_id, ' HTTPS://WWW.' || substr(url, 9) || CASE WHEN page_id % 2 = 0 THEN '?utm_source=x&fbclid=1#top' ELSE '' END AS u FROM pages) p) t")
def canonical_urls(s, d):
    dirty = F.concat(F.lit(" HTTPS://WWW."), F.substr("url", F.lit(9)), F.when(F.col("page_id") % 2 == 0, "?utm_source=x&fbclid=1#top").otherwise(""))
    return readers.table(s, d, "pages").select("page_id", articles.canonical_url(dirty).alias("url"))


@query("ledes", "SELECT doc_id, left(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: regexp_matches(x, '[\\p{L}\\p{N}]'))[1], 200) AS lede FROM documents")
def ledes(s, d):
    return readers.table(s, d, "documents").select("doc_id", articles.lede(F.col("text")).alias("lede"))


@query("languages_detected", None)
def languages_detected(s, d):
    return readers.table(s, d, "documents").select("doc_id", "lang", articles.language(F.col("text")).alias("detected"))


@query("scaled_confidence", "SELECT vec_id, round(CASE WHEN c <= 0 OR c >= 1 THEN c ELSE 1 / (1 + exp(-ln(c / (1 - c)) / 1.5)) END, 9) AS confidence FROM (SELECT vec_id, CAST(vec_id % 101 AS DOUBLE) / 100 AS c FROM embeddings) t")
def scaled_confidence(s, d):
    rows = readers.table(s, d, "embeddings").select("vec_id", (F.col("vec_id") % 101 / 100).alias("c"))
    return rows.select("vec_id", F.round(articles.scaled(F.col("c"), 1.5), 9).alias("confidence"))


@query("faithfulness_scores", "SELECT vec_id, CASE WHEN vec_id % 4 = 0 THEN NULL ELSE round((vec_id % 4) / 4.0, 6) END AS score FROM embeddings")
def faithfulness_scores(s, d):
    words = [F.lit("alpha"), F.lit("beta"), F.lit("gamma")]
    k = F.col("vec_id") % 4
    sources = F.when(k == 1, words[0]).when(k == 2, F.lit("Beta, alpha.")).otherwise(F.lit("gamma beta ALPHA"))
    return readers.table(s, d, "embeddings").select("vec_id", F.round(articles.faithfulness(F.when(k == 0, "").otherwise("Alpha beta gamma delta"), sources), 6).cast("double").alias("score"))


@query("nearest_leaders", "SELECT article_id, leader_id FROM (SELECT a.vec_id AS article_id, l.vec_id AS leader_id, row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(l.embedding AS DOUBLE[])), 9) DESC, l.vec_id) AS r FROM embeddings a, (SELECT * FROM embeddings WHERE vec_id IN (SELECT min(vec_id) FROM embeddings GROUP BY label)) l) t WHERE r = 1")
def nearest_leaders(s, d):
    rows = readers.table(s, d, "embeddings").withColumnsRenamed({"vec_id": "article_id", "embedding": "vector"})
    first = rows.groupBy("label").agg(F.min_by(F.struct(F.col("article_id").alias("leader_id"), "vector"), "article_id").alias("l")).select("l.*")
    return clusters.nearest_leader(rows, first).select("article_id", "leader_id")


@query("leader_follower", None)
def leader_follower(s, d):
    rows = readers.table(s, d, "embeddings").select(F.col("label").alias("block"), F.col("vec_id").alias("article_id"), F.col("embedding").alias("vector"))
    return clusters.reconcile(clusters.follow(rows), rows)


# --- authored pages ----------------------------------------------------------------------------

_DAY = "(doc_id % 28 + 1)"


@query("inline_marks", f"SELECT doc_id, 'code:c' || CAST(doc_id AS VARCHAR) || ':|link:label:https://x.example/' || CAST(doc_id AS VARCHAR) || '|status:done:green|date:2024-02-' || lpad(CAST({_DAY} AS VARCHAR), 2, '0') || ':' || CAST(epoch_ms(CAST('2024-02-' || lpad(CAST({_DAY} AS VARCHAR), 2, '0') AS TIMESTAMP)) AS VARCHAR) || '|strong:bold:|em:soft:' AS marks FROM documents")
def inline_marks(s, d):
    day = F.lpad((F.col("doc_id") % 28 + 1).cast("string"), 2, "0")
    text = F.concat(F.lit("see `c"), "doc_id", F.lit("` and [label](https://x.example/"), "doc_id", F.lit(") {status:green|done} on @2024-02-"), day, F.lit(" **bold** and *soft* 2 * 3"))
    shown = F.transform(markup.marks(text), lambda m: F.concat_ws(":", m["kind"], m["label"], F.coalesce(m["value"], F.lit(""))))
    return readers.table(s, d, "documents").select("doc_id", F.array_join(shown, "|").alias("marks"))


@query("frontmatter", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '' ELSE 'url=https://x.example/' || CAST(doc_id AS VARCHAR) || '|title=a: b' END AS meta, CASE WHEN doc_id % 3 = 0 THEN '--- no head' ELSE 'body ' || CAST(doc_id AS VARCHAR) END AS body FROM documents")
def frontmatter(s, d):
    head = F.concat(F.lit("---\ntitle: old\n\n url : https://x.example/"), "doc_id", F.lit("\ntitle: 'a: b'\n---\nbody "), "doc_id")
    page = F.when(F.col("doc_id") % 3 == 0, "--- no head").otherwise(head)
    meta = F.array_join(F.transform(markup.frontmatter(page), lambda e: F.concat(e["key"], F.lit("="), e["value"])), "|")
    return readers.table(s, d, "documents").select("doc_id", meta.alias("meta"), markup.body(page).alias("body"))
