"""The source registry: reads, and writes as new states.

Where several patches or writes name one source the last one counts: the one with the
greatest ``position`` if there is such a column, else with the greatest values.

Every write stamps ``updated_at`` with the given time whatever the caller
supplies, as the table's trigger does. Governing fields change only under the
version token (the row's ``updated_at``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schemas

DESCRIPTIVE = ("name", "home_url", "discovery_method", "jurisdiction", "rate_limit_per_min")
GOVERNING = ("enabled", "rights_level", "acquisition_tier")


def list_all(sources: DataFrame) -> DataFrame:
    return sources.orderBy("name")


def get(sources: DataFrame, source_id: int) -> DataFrame:
    return sources.where(F.col("source_id") == source_id).limit(1)


def enabled(sources: DataFrame) -> DataFrame:
    return sources.where("enabled").orderBy("source_id")


def create(sources: DataFrame, rows: DataFrame, now: Column) -> DataFrame:
    """sources with new rows; absent or NULL columns get their defaults."""
    defaults = schemas.DEFAULTS["source"]
    cols = []
    for f in schemas.TABLES["source"]:
        value = F.col(f.name) if f.name in rows.columns else F.lit(None)
        value = now if f.name in ("created_at", "updated_at") else F.coalesce(value, F.expr(defaults[f.name])) if f.name in defaults else value
        cols.append(value.cast(f.dataType).alias(f.name))
    return sources.unionByName(rows.select(*cols))


def _last(rows: DataFrame, key: str) -> DataFrame:
    """One row a key, the last one."""
    order = ["position"] if "position" in rows.columns else [c for c in rows.columns if c != key]
    if not order:
        return rows.distinct()
    return rows.groupBy(key).agg(F.max_by(F.struct(*[c for c in rows.columns if c != key]), F.struct(*order)).alias("last")).select(key, "last.*")


def describe(sources: DataFrame, patches: DataFrame, now: Column) -> DataFrame:
    """sources after patches (source_id and descriptive columns; NULL leaves a field). Unknown ids change nothing."""
    patches = _last(patches, "source_id")
    p = patches.select(F.col("source_id"), *[F.col(c).alias(f"new_{c}") for c in patches.columns if c in DESCRIPTIVE], F.lit(True).alias("patched"))
    joined = sources.join(p, "source_id", "left")
    value = lambda c: F.coalesce(f"new_{c}", c).alias(c) if f"new_{c}" in p.columns else F.when(F.col("patched"), now).otherwise(F.col(c)).alias(c) if c == "updated_at" else F.col(c)
    return joined.select(*map(value, sources.columns))


def compare_and_set(sources: DataFrame, writes: DataFrame, field: str, now: Column) -> tuple[DataFrame, DataFrame]:
    """(new sources, verdicts). writes: source_id, token, value. A verdict is set, stale or missing; one write an id (the last)."""
    if field not in GOVERNING:
        raise ValueError(f"{field} is not a governing field")
    w = _last(writes.select(*[c for c in writes.columns if c in ("source_id", "token", "value", "position")]), "source_id").select("source_id", "token", "value")
    verdicts = w.join(sources.select("source_id", F.col("updated_at").alias("at")), "source_id", "left")
    verdicts = verdicts.select("source_id", F.when(F.col("at").isNull(), "missing").when(F.col("at") == F.col("token"), "set").otherwise("stale").alias("verdict"))
    hit = (F.col("token") == F.col("updated_at")) & F.col("token").isNotNull()
    joined = sources.join(w, "source_id", "left")
    value = lambda c: F.when(hit, F.col("value") if c == field else now).otherwise(F.col(c)).alias(c) if c in (field, "updated_at") else F.col(c)
    return joined.select(*map(value, sources.columns)), verdicts


def seed_verdicts(sources: DataFrame, entries: DataFrame) -> DataFrame:
    """entries (position, name, home_url, ...) with ``inserted``: its url is neither stored nor earlier in the list."""
    first = F.row_number().over(Window.partitionBy("home_url").orderBy("position")) == 1
    stored = sources.select("home_url").distinct().withColumn("stored", F.lit(True))
    return entries.withColumn("first", first).join(stored, "home_url", "left").withColumn("inserted", F.col("first") & F.col("stored").isNull()).drop("first", "stored")


def seed(sources: DataFrame, entries: DataFrame, now: Column) -> DataFrame:
    """Insert-only seeding: stored rows never change."""
    return create(sources, seed_verdicts(sources, entries).where("inserted"), now)


def seed_lists(sources: DataFrame, entries: DataFrame) -> DataFrame:
    """One row (inserted, skipped): the names of a roster in its order. A roster is one file, so its names fit a row."""
    named = seed_verdicts(sources, entries).select("inserted", F.struct("position", "name").alias("x"))
    lists = named.agg(*[F.transform(F.array_sort(F.collect_list(F.when(F.col("inserted") == flag, F.col("x")))), lambda x: x["name"]).alias(c) for c, flag in (("inserted", True), ("skipped", False))])
    return lists
