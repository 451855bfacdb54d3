"""Which articles may be used under their publisher's current rights.

Rights are always joined from ``source`` at read time, never copied. Both sets
are positive semi-joins, so an outer query may negate neither by mistake. The
``source`` side is left to the optimiser: it is broadcast while it is small.
"""

from __future__ import annotations

from pyspark.sql import DataFrame


def article_ids(records: DataFrame, sources: DataFrame, level: str) -> DataFrame:
    """article_id of records whose source has the rights level."""
    return records.join(sources.where(sources["rights_level"] == level), "source_id", "left_semi").select("article_id")


def with_body_rights(records: DataFrame, sources: DataFrame) -> DataFrame:
    return article_ids(records, sources, "body_text")


def without_body_rights(records: DataFrame, sources: DataFrame) -> DataFrame:
    return article_ids(records, sources, "headline_only")


def not_in_body_rights(records: DataFrame, sources: DataFrame) -> DataFrame:
    """The negated form as an anti-join: the ids without a source that grants the body text."""
    return records.join(sources.where("rights_level = 'body_text'"), "source_id", "left_anti").select("article_id")
