"""Tables, vocabularies and integrity rules of the content pipeline.

``TABLES`` holds a StructType for each table. ``DOMAINS`` is the single list of
closed vocabularies; checks are derived from it. ``CHECKS``, ``UNIQUE`` and
``FOREIGN_KEYS`` describe the remaining rules.
"""

from __future__ import annotations

from pyspark.sql import types as T

# The vocabularies of each enumerated column.
DISCOVERY_METHODS = ("rss", "sitemap", "websub", "section_scrape")
ACQUISITION_TIERS = ("1_full_feed", "2_publisher_api", "3_extraction")
RIGHTS_LEVELS = ("body_text", "headline_only")
BODY_PROVENANCES = ("tier1_feed", "tier2_api", "tier3_extracted")
PIPELINE_STATES = ("discovered", "acquired", "classified", "clustered")
TERMINAL_REASONS = ("failed", "dropped_language")
FALLBACK_REASONS = ("none", "low_confidence", "service_unavailable")
WITHHOLD_REASONS = ("none", "below_faithfulness_bar", "rights_excluded", "insufficient_sources")
WINDOW_STATUSES = ("open", "evicted")
TAKEDOWN_SCOPES = ("representative", "alternate_copy")
STAGES = ("acquire", "classify", "cluster", "summarize")
JOB_STATUSES = ("queued", "running", "succeeded", "partial", "failed", "expired")
TERMINAL_STATUSES = ("succeeded", "partial", "failed", "expired")
ERROR_CODES = ("invalid_request", "unsupported_taxonomy_version", "item_too_large", "rate_limited", "not_found", "internal")
WIRE_WITHHOLD_REASONS = ("below_faithfulness_bar",)

#: table -> column -> allowed values.
DOMAINS: dict[str, dict[str, tuple[str, ...]]] = {
    "source": {"discovery_method": DISCOVERY_METHODS, "acquisition_tier": ACQUISITION_TIERS, "rights_level": RIGHTS_LEVELS},
    "canonical_record": {"body_provenance": BODY_PROVENANCES, "pipeline_state": PIPELINE_STATES, "terminal_reason": TERMINAL_REASONS},
    "classification": {"fallback_reason": FALLBACK_REASONS},
    "cluster": {"window_status": WINDOW_STATUSES},
    "summary": {"withhold_reason": WITHHOLD_REASONS},
    "takedown": {"scope": TAKEDOWN_SCOPES},
    "pipeline_work": {"stage": STAGES},
    "summarize_job": {"status": JOB_STATUSES},
}

#: table -> rule name -> SQL predicate. A rule holds unless it is false: NULL passes.
CHECKS: dict[str, dict[str, str]] = {
    "source": {"rate_limit_positive": "rate_limit_per_min > 0"},
    "summary": {"withheld_agrees": "(withheld AND withhold_reason <> 'none' AND text IS NULL) OR (NOT withheld AND withhold_reason = 'none')"},
    "pipeline_work": {"one_subject": "(article_id IS NULL) <> (cluster_id IS NULL)"},
    "summarize_job_item": {
        "wire_withhold_reason": "withhold_reason IS NULL OR withhold_reason = 'below_faithfulness_bar'",
        "score_range": "faithfulness_score IS NULL OR faithfulness_score BETWEEN 0 AND 1",
    },
    "wire_result": {"confidence_range": "confidence BETWEEN 0 AND 1", "score_range": "faithfulness_score BETWEEN 0 AND 1"},
}

#: table -> (name, key columns, predicate or None). Rows with a NULL in the key never collide.
UNIQUE: dict[str, list[tuple[str, tuple[str, ...], str | None]]] = {
    "canonical_record": [("source_guid", ("source_id", "guid"), None), ("url", ("url_canonical",), None)],
    "alternate_copy": [("source_guid", ("source_id", "guid"), None), ("url", ("url",), None)],
    "pipeline_work": [("open_article", ("article_id",), "dead_lettered_at IS NULL"), ("open_cluster", ("cluster_id",), "dead_lettered_at IS NULL")],
    "summarize_job": [("public_id", ("public_id",), None), ("idempotency", ("consumer", "idempotency_key"), None)],
    "summarize_job_item": [("job_item", ("job_id", "item_id"), None)],
}

#: (child, column, parent, key, rule on delete).
FOREIGN_KEYS: list[tuple[str, str, str, str, str]] = [
    ("canonical_record", "source_id", "source", "source_id", "restrict"),
    ("alternate_copy", "article_id", "canonical_record", "article_id", "cascade"),
    ("alternate_copy", "source_id", "source", "source_id", "restrict"),
    ("classification", "article_id", "canonical_record", "article_id", "cascade"),
    ("cluster_member", "article_id", "canonical_record", "article_id", "cascade"),
    ("cluster_member", "cluster_id", "cluster", "cluster_id", "cascade"),
    ("summary", "cluster_id", "cluster", "cluster_id", "cascade"),
    ("takedown", "source_id", "source", "source_id", "restrict"),
    ("pipeline_work", "article_id", "canonical_record", "article_id", "cascade"),
    ("pipeline_work", "cluster_id", "cluster", "cluster_id", "cascade"),
    ("summarize_job_item", "job_id", "summarize_job", "id", "cascade"),
]

DOCUMENT = "struct<source:string,title:string,text:string,url:string>"

#: Columns of each table; ``!`` marks a column that may not be NULL.
_COLUMNS = {
    "source": "source_id bigint!, name string!, home_url string!, discovery_method string!, acquisition_tier string!, rights_level string!, jurisdiction string!, enabled boolean!, rate_limit_per_min int!, created_at timestamp_ntz!, updated_at timestamp_ntz!",
    "canonical_record": "article_id bigint!, source_id bigint!, url_canonical string!, guid string!, title string!, body_text string, lede string, published_at timestamp_ntz, first_seen_at timestamp_ntz!, language string, body_provenance string, content_hash string, simhash bigint, retention_expires_at timestamp_ntz, content_updated_at timestamp_ntz, pipeline_state string!, terminal_reason string",
    "alternate_copy": "alternate_copy_id bigint!, article_id bigint!, source_id bigint!, url string!, guid string, seen_at timestamp_ntz!",
    "classification": "article_id bigint!, topic string!, confidence double!, fallback_reason string!, taxonomy_version string!, model_version string!",
    "cluster": "cluster_id bigint!, representative_topic string, topic_margin double, article_count int!, distinct_source_count int!, earliest_at timestamp_ntz, latest_at timestamp_ntz, window_status string!",
    "cluster_member": "article_id bigint!, cluster_id bigint!",
    "summary": "cluster_id bigint!, text string, faithfulness_score double, withheld boolean!, withhold_reason string!, provenance_urls array<string>!, model_version string, generated_at timestamp_ntz, input_fingerprint string",
    "takedown": "takedown_id bigint!, source_id bigint!, guid string, url_canonical string!, content_hash string, removed_article_id bigint!, scope string!, reason string!, requested_at timestamp_ntz!, actioned_at timestamp_ntz",
    "pipeline_work": "work_id bigint!, article_id bigint, cluster_id bigint, stage string!, claimed_at timestamp_ntz, claimed_by string, attempts int!, next_attempt_at timestamp_ntz!, last_error string, dead_lettered_at timestamp_ntz",
    "summarize_job": "id bigint!, public_id string!, consumer string!, idempotency_key string, status string!, claimed_at timestamp_ntz, claimed_by string, attempts int!, next_attempt_at timestamp_ntz!, last_error string, created_at timestamp_ntz!, updated_at timestamp_ntz!, expires_at timestamp_ntz!, max_sentences int",
    "summarize_job_item": f"id bigint!, job_id bigint!, item_id string!, documents array<{DOCUMENT}>, provenance array<string>, summary string, faithfulness_score double, withheld boolean, withhold_reason string, error_code string, error_message string",
}

#: Values given at insert where a column is absent or NULL.
DEFAULTS: dict[str, dict[str, str]] = {
    "source": {"enabled": "true"},
    "canonical_record": {"pipeline_state": "'discovered'"},
    "cluster": {"article_count": "0", "distinct_source_count": "0", "window_status": "'open'"},
    "summary": {"withheld": "false", "withhold_reason": "'none'", "provenance_urls": "CAST(array() AS array<string>)"},
    "pipeline_work": {"attempts": "0"},
    "summarize_job": {"attempts": "0", "status": "'queued'"},
    "classification": {"fallback_reason": "'none'"},
}


_DOCUMENT = T.StructType([T.StructField(c, T.StringType()) for c in ("source", "title", "text", "url")])
_TYPES = {
    "bigint": T.LongType(), "int": T.IntegerType(), "string": T.StringType(), "boolean": T.BooleanType(), "double": T.DoubleType(),
    "timestamp_ntz": T.TimestampNTZType(), "array<string>": T.ArrayType(T.StringType()), f"array<{DOCUMENT}>": T.ArrayType(_DOCUMENT),
}


def table(name: str) -> T.StructType:
    """The StructType of a table."""
    fields = [c.split(" ", 1) for c in _COLUMNS[name].split(", ")]
    return T.StructType([T.StructField(c, _TYPES[kind.rstrip("!")], not kind.endswith("!")) for c, kind in fields])


TABLES: dict[str, T.StructType] = {name: table(name) for name in _COLUMNS}
