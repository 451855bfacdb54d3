"""The pipeline's tables, derived from the test tables by plain arithmetic.

Each view is a list of (column, expression) over one table. ``{ts:...}`` is a
timestamp without zone, ``{min:...}`` an interval of minutes and ``{sha:...}`` a
SHA-256, written for each engine by ``_spark`` and ``_duck``.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NOW, JOBS_NOW = "2024-02-01 00:00:00", "1998-06-01 00:00:00"
LEASE = 300

_N = "CAST(substr(source, 4) AS BIGINT)"
_OWED = "CASE WHEN lang <> 'en' THEN NULL WHEN doc_id % 4 = 0 THEN 'acquire' WHEN doc_id % 4 = 1 THEN 'classify' WHEN doc_id % 4 = 2 THEN 'cluster' END"

VIEWS: dict[str, tuple[str, list[tuple[str, str]], str | None]] = {
    "source": ("(SELECT DISTINCT source FROM documents WHERE source IS NOT NULL) AS d", [
        ("source_id", _N), ("name", "source"), ("home_url", "'https://' || source || '.example.org'"),
        ("discovery_method", f"CASE {_N} % 4 WHEN 0 THEN 'rss' WHEN 1 THEN 'sitemap' WHEN 2 THEN 'websub' ELSE 'section_scrape' END"),
        ("acquisition_tier", f"CASE {_N} % 3 WHEN 0 THEN '1_full_feed' WHEN 1 THEN '2_publisher_api' ELSE '3_extraction' END"),
        ("rights_level", f"CASE WHEN {_N} % 3 = 0 THEN 'headline_only' ELSE 'body_text' END"), ("jurisdiction", "'GB'"), ("enabled", f"{_N} % 4 <> 0"),
        ("rate_limit_per_min", f"CAST(5 + {_N} AS INT)"), ("created_at", "{ts:2024-01-01 00:00:00}"), ("updated_at", f"{{ts:2024-01-01 00:00:00}} + {{min:{_N}}}"),
    ], None),
    "canonical_record": ("documents", [
        ("article_id", "doc_id"), ("source_id", _N), ("url_canonical", "'https://example.org/' || CAST(doc_id AS {str})"), ("guid", "'g' || CAST(doc_id AS {str})"),
        ("language", "lang"), ("content_hash", "{sha:text}"), ("simhash", "((doc_id - doc_id % 8) * 2654435761 % 1099511627776) * 4194304 * (CASE WHEN doc_id % 16 < 8 THEN 1 ELSE -1 END) + doc_id % 8"),
        ("pipeline_state", "CASE doc_id % 4 WHEN 0 THEN 'discovered' WHEN 1 THEN 'acquired' WHEN 2 THEN 'classified' ELSE 'clustered' END"),
        ("terminal_reason", "CASE WHEN lang <> 'en' THEN 'dropped_language' END"), ("body_provenance", "CASE doc_id % 5 WHEN 0 THEN 'tier1_feed' WHEN 1 THEN 'scraped' END"),
    ], None),
    "pipeline_work": ("documents", [
        ("work_id", "doc_id"), ("article_id", "CASE WHEN doc_id % 97 = 0 THEN NULL ELSE doc_id END"), ("cluster_id", "CASE WHEN doc_id % 89 = 0 THEN doc_id END"), ("stage", _OWED),
        ("claimed_at", "CASE doc_id % 5 WHEN 0 THEN {now} - {min:10} WHEN 1 THEN {now} - {min:2} END"), ("claimed_by", "CASE WHEN doc_id % 5 < 2 THEN 'w0' END"),
        ("attempts", "CAST(doc_id % 3 AS INT)"), ("next_attempt_at", "{now} + {min:doc_id * 37 % 600 - 300}"), ("last_error", "CAST(NULL AS {str})"),
        ("dead_lettered_at", "CASE WHEN doc_id % 11 = 0 THEN {now} END"),
    ], f"({_OWED}) IS NOT NULL AND doc_id % 7 <> 0"),
    "summarize_job": ("orders", [
        ("id", "o_orderkey"), ("public_id", "lower(substr({sha:CAST(o_orderkey AS {str})}, 1, 8)) || '-0000-4000-8000-' || substr({sha:CAST(o_orderkey AS {str})}, 9, 12)"),
        ("consumer", "'c' || CAST(o_custkey % 7 AS {str})"), ("idempotency_key", "CASE WHEN o_orderkey % 3 <> 0 THEN 'k' || CAST(o_custkey % 400 AS {str}) END"),
        ("status", "CASE WHEN o_orderkey % 10 = 0 THEN 'running' WHEN o_orderstatus = 'O' THEN 'queued' WHEN o_orderstatus = 'F' THEN 'succeeded' ELSE 'partial' END"),
        ("claimed_at", "CASE WHEN o_orderkey % 10 = 0 THEN {jobs_now} - {min:o_orderkey % 20} END"), ("claimed_by", "CASE WHEN o_orderkey % 10 = 0 THEN 'w1' END"),
        ("attempts", "CAST(o_orderkey % 4 AS INT)"), ("next_attempt_at", "o_orderdate"), ("last_error", "CAST(NULL AS {str})"), ("created_at", "o_orderdate"), ("updated_at", "o_orderdate"),
        ("expires_at", "o_orderdate + {min:1440 * 700}"), ("max_sentences", "CASE WHEN o_orderkey % 5 > 0 THEN CAST(o_orderkey % 5 AS INT) END"),
    ], None),
    "summarize_job_item": ("lineitem", [
        ("id", "l_orderkey * 10 + l_linenumber"), ("job_id", "l_orderkey"), ("item_id", "'i' || CAST(l_linenumber AS {str})"),
        ("summary", "CASE WHEN l_returnflag = 'A' AND l_quantity > 10 THEN 'text' END"), ("faithfulness_score", "CASE WHEN l_returnflag = 'A' THEN l_discount * 11 END"),
        ("withheld", "CASE WHEN l_returnflag = 'A' THEN l_quantity <= 10 END"), ("withhold_reason", "CASE WHEN l_returnflag = 'A' AND l_quantity <= 10 THEN CASE WHEN l_quantity <= 2 THEN 'other' ELSE 'below_faithfulness_bar' END END"),
        ("error_code", "CASE WHEN l_returnflag = 'R' THEN CASE WHEN l_linenumber % 2 = 0 THEN 'item_too_large' ELSE 'invalid_request' END END"),
        ("error_message", "CASE WHEN l_returnflag = 'R' THEN 'refused' END"), ("has_documents", "l_linestatus = 'O'"),
    ], None),
    "classification": ("embeddings", [
        ("article_id", "vec_id"), ("cluster_id", "vec_id % 40"), ("topic", "'topic' || CAST(label AS {str})"), ("confidence", "(vec_id % 100) / 100.0"),
    ], None),
    "alternate_copy": ("documents", [("alternate_copy_id", "doc_id"), ("article_id", "doc_id - doc_id % 5"), ("source_id", _N), ("url", "'https://copy.example.org/' || CAST(doc_id % 900 AS {str})"), ("guid", "CASE WHEN doc_id % 3 > 0 THEN 'g' || CAST(doc_id % 800 AS {str}) END")], "doc_id % 5 > 2"),
    "takedown": ("documents", [("takedown_id", "doc_id"), ("source_id", _N), ("guid", "CASE WHEN doc_id % 2 = 0 THEN 'g' || CAST(doc_id AS {str}) END"), ("url_canonical", "'https://example.org/' || CAST(doc_id + 7 AS {str})"), ("content_hash", "CASE WHEN doc_id % 3 = 0 THEN {sha:text} END")], "doc_id % 25 = 3"),
    "member": ("documents", [("article_id", "doc_id"), ("cluster_id", "doc_id % 60")], None),
    "summary": ("documents", [
        ("cluster_id", "doc_id"), ("text", "CASE WHEN doc_id % 4 > 0 THEN 'summary ' || CAST(doc_id AS {str}) END"), ("withheld", "doc_id % 4 = 0 OR doc_id % 11 = 3"),
        ("withhold_reason", "CASE WHEN doc_id % 4 = 0 THEN 'rights_excluded' WHEN doc_id % 13 = 5 THEN 'too_short' ELSE 'none' END"),
    ], None),
    "published": ("documents", [("article_id", "doc_id"), ("cluster_id", "doc_id % 60"), ("published_at", "{now} - {min:doc_id * 17 % 50000}")], None),
    "request": ("orders", [("request_id", "o_orderkey"), ("consumer", "'c' || CAST(o_custkey % 7 AS {str})"), ("idempotency_key", "CASE WHEN o_orderkey % 4 > 0 THEN 'k' || CAST(o_custkey % 500 AS {str}) END")], None),
}


def _render(text: str, ts, minutes, sha, string: str) -> str:
    text = text.replace("{now}", f"{{ts:{NOW}}}").replace("{jobs_now}", f"{{ts:{JOBS_NOW}}}").replace("{str}", string)
    for name, fn in (("ts", ts), ("sha", sha), ("min", minutes)):
        text = re.sub(r"\{" + name + r":([^{}]*)\}", lambda m, fn=fn: fn(m[1]), text)
    return text


def _spark(text: str) -> str:
    return _render(text, lambda t: f"TIMESTAMP_NTZ '{t}'", lambda n: f"make_dt_interval(0, 0, CAST({n} AS INT))", lambda x: f"sha2({x}, 256)", "STRING")


def _duck(text: str) -> str:
    return _render(text, lambda t: f"TIMESTAMP '{t}'", lambda n: f"to_minutes(CAST({n} AS BIGINT))", lambda x: f"sha256({x})", "VARCHAR")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    table, columns, where = VIEWS[name]
    if table.startswith("("):
        df = spark.read.parquet(f"{sf_dir}/documents.parquet").select("source").where("source IS NOT NULL").distinct()
    else:
        df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    if where:
        df = df.where(_spark(where))
    return df.select(*[F.expr(_spark(sql)).alias(c) for c, sql in columns])


def duck_view(name: str) -> str:
    table, columns, where = VIEWS[name]
    return f"SELECT {', '.join(f'{_duck(sql)} AS {c}' for c, sql in columns)} FROM {table}" + (f" WHERE {_duck(where)}" if where else "")


def duck(query: str, *views: str) -> str:
    """A DuckDB query over fixture views; ``{{...}}`` marks as in the views."""
    ctes = ", ".join(f"{v} AS ({duck_view(v)})" for v in views)
    return f"WITH {ctes} {_duck(query)}" if views else _duck(query)


def ts(text: str):
    return F.expr(f"TIMESTAMP_NTZ '{text}'")
