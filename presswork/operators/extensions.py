"""Extensions: steps the pipeline describes without fixing their parameters. The parameters here are ours."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .near import near_pairs

#: Ours: confidence below which a topic is a fallback, least sources and least score of a summary.
LEAST_CONFIDENCE, LEAST_SOURCES, LEAST_SCORE = 0.5, 2, 0.6


def collapse_exact(records: DataFrame) -> DataFrame:
    """(article_id, representative_id): the least id of each content hash; NULL hashes stand alone."""
    first = records.where("content_hash IS NOT NULL").groupBy("content_hash").agg(F.min("article_id").alias("least"))
    return records.join(first, "content_hash", "left").select("article_id", F.coalesce("least", "article_id").alias("representative_id"))


def distinct_sources(members: DataFrame, records: DataFrame, copies: DataFrame) -> DataFrame:
    """(cluster_id, article_count, distinct_source_count): sources of members and of their copies, each once."""
    own = members.join(records.select("article_id", "source_id"), "article_id")
    more = members.join(copies.select("article_id", "source_id"), "article_id")
    n = own.unionByName(more).groupBy("cluster_id").agg(F.countDistinct("source_id").alias("distinct_source_count"))
    return members.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("article_count")).join(n, "cluster_id")


def cluster_span(articles: DataFrame) -> DataFrame:
    """(cluster_id, article_count, earliest_at, latest_at) of (article_id, cluster_id, published_at)."""
    return articles.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("article_count"), F.min("published_at").alias("earliest_at"), F.max("published_at").alias("latest_at"))


def browse_tree(classified: DataFrame, members: DataFrame) -> DataFrame:
    """(topic, clusters): for each topic its clusters in order, each with its article ids in order.

    A nested row holds ids only; where one topic has more than a row should hold, read ``browse`` by topic instead.
    """
    own = members.groupBy("cluster_id").agg(F.array_sort(F.collect_list("article_id")).alias("articles"))
    nested = F.array_sort(F.collect_list(F.struct("cluster_id", "articles")))
    return own.join(classified, "cluster_id").groupBy(F.col("representative_topic").alias("topic")).agg(nested.alias("clusters"))


def topic_vote(members: DataFrame, classification: DataFrame) -> DataFrame:
    """(cluster_id, representative_topic, topic_margin): the topic with the most confidence, ties by name, and its lead."""
    votes = members.join(classification, "article_id").groupBy("cluster_id", "topic").agg(F.sum("confidence").alias("votes"))
    ranked = votes.withColumn("r", F.row_number().over(Window.partitionBy("cluster_id").orderBy(F.col("votes").desc(), "topic"))).where("r <= 2")
    best, next_ = (F.max(F.when(F.col("r") == k, F.col("votes"))) for k in (1, 2))
    return ranked.groupBy("cluster_id").agg(F.max(F.when(F.col("r") == 1, F.col("topic"))).alias("representative_topic"), (best - F.coalesce(next_, F.lit(0.0))).alias("topic_margin"))


def fallback_reason(confidence: Column) -> Column:
    return F.when(confidence.isNull(), "service_unavailable").when(confidence < LEAST_CONFIDENCE, "low_confidence").otherwise("none")


def withhold_reason(sources: Column, has_rights: Column, score: Column) -> Column:
    """Too few sources first, then rights, then the score."""
    return F.when(sources < LEAST_SOURCES, "insufficient_sources").when(~has_rights, "rights_excluded").when(score < LEAST_SCORE, "below_faithfulness_bar").otherwise("none")


def drop_language(records: DataFrame, keep: str = "en") -> DataFrame:
    return records.withColumn("terminal_reason", F.when(F.col("terminal_reason").isNull() & (F.col("language") != keep), "dropped_language").otherwise(F.col("terminal_reason")))


def not_taken_down(records: DataFrame, takedowns: DataFrame) -> DataFrame:
    """records that no takedown matches by (source, guid), by url or by content hash: three equi anti-joins."""
    by = [(["source_id", "guid"], ["source_id", "guid"]), (["url_canonical"], ["url_canonical"]), (["content_hash"], ["content_hash"])]
    return reduce(lambda df, k: df.join(takedowns.select(*k[1]).dropna().distinct(), k[0], "left_anti"), by, records)


def browse(classified: DataFrame, members: DataFrame, records: DataFrame) -> DataFrame:
    """(topic, n_clusters, n_articles, earliest article) of the topic -> cluster -> article tree."""
    rows = members.join(classified, "cluster_id").join(records.select("article_id"), "article_id")
    return rows.groupBy(F.col("representative_topic").alias("topic")).agg(F.countDistinct("cluster_id").alias("n_clusters"), F.count(F.lit(1)).alias("n_articles"), F.min("article_id").alias("first_article"))


def input_fingerprint(members: DataFrame, records: DataFrame) -> DataFrame:
    """(cluster_id, input_fingerprint): SHA-256 of ``id:hash`` of all members in order, joined by ``|``."""
    rows = members.join(records.select("article_id", "content_hash"), "article_id")
    item = F.struct("article_id", F.concat_ws(":", F.col("article_id").cast("string"), "content_hash").alias("s"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["s"]), "|")
    return rows.groupBy("cluster_id").agg(F.sha2(joined, 256).alias("input_fingerprint"))


def evict(clusters: DataFrame, now: Column, days: int) -> DataFrame:
    """clusters whose latest article is older than the window become evicted."""
    old = F.col("latest_at") < now - F.make_dt_interval(days=F.lit(days))
    return clusters.withColumn("window_status", F.when(old, "evicted").otherwise(F.col("window_status")))


def census(nodes: DataFrame) -> DataFrame:
    """(type, n) in order of type."""
    return nodes.groupBy("type").agg(F.count(F.lit(1)).alias("n")).orderBy("type")


def census_drift(a: DataFrame, b: DataFrame) -> DataFrame:
    """(type, n_a, n_b) where two censuses differ; a missing type is NULL."""
    both = a.select("type", F.col("n").alias("n_a")).join(b.select("type", F.col("n").alias("n_b")), "type", "full_outer")
    return both.where(~F.col("n_a").eqNullSafe(F.col("n_b")))
