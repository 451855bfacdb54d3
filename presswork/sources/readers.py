"""Readers with explicit schemas; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas

REQUIRED = ("name", "home_url", "discovery_method", "acquisition_tier", "rights_level", "jurisdiction", "rate_limit_per_min")
CLASSIFY_REQUEST = "items array<struct<id:string,title:string,text:string>>, taxonomy_version string"
SUMMARIZE_REQUEST = f"items array<struct<id:string,documents:array<{schemas.DOCUMENT}>>>, max_sentences int, style string"


class RosterError(ValueError):
    pass


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _kind(value: Column) -> Column:
    """The JSON kind of a variant: STRING, BIGINT, DECIMAL(p,s), DOUBLE, BOOLEAN, VOID, OBJECT<...> or ARRAY<...>; NULL where absent."""
    return F.schema_of_variant(value)


def parse_roster(raw: DataFrame, column: str = "value", keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, position, fields, fault): entries of the JSON array in each row; fault names what is wrong first.

    An empty array has no entries. Anything else than an array is one row without a
    position. A number may be written as a string of digits; a fraction is cut. An
    absent ``enabled`` is true, else its truth is that of the value: false, null, zero
    and empty values are false.
    """
    text = F.regexp_replace(F.coalesce(F.col(column), F.lit("")), r"^[ \t\r\n]+", "")
    entries = F.when(text.startswith("["), F.from_json(text, "array<string>", {"mode": "PERMISSIVE"}))
    rows = raw.select(*keys, entries.alias("entries"))
    bad = rows.where("entries IS NULL").select(*keys, F.lit(None).cast("int").alias("position"), F.lit(None).cast("string").alias("e"))
    rows = rows.select(*keys, F.posexplode("entries").alias("position", "e")).unionByName(bad)
    rows = rows.withColumn("v", F.try_parse_json("e"))
    part = lambda c: F.try_variant_get("v", f"$.{c}", "variant")
    string = lambda c: F.try_variant_get("v", f"$.{c}", "string")
    rate, on = part("rate_limit_per_min"), part("enabled")
    written = F.when(string("rate_limit_per_min").rlike(r"^\s*[+-]?[0-9]+\s*$"), F.trim(string("rate_limit_per_min")).cast("int"))
    number = F.when(_kind(rate) == "STRING", written).when(_kind(rate) == "BOOLEAN", string("rate_limit_per_min").cast("boolean").cast("int")).otherwise(F.try_variant_get("v", "$.rate_limit_per_min", "double").cast("int"))
    true = F.when(on.isNull(), True).when(_kind(on).isin("VOID"), False).when(_kind(on) == "BOOLEAN", string("enabled").cast("boolean")).when(_kind(on) == "STRING", string("enabled") != "")
    true = true.when(_kind(on).startswith("OBJECT") | _kind(on).startswith("ARRAY"), ~string("enabled").isin("{}", "[]")).otherwise(F.try_variant_get("v", "$.enabled", "double") != 0)
    is_object = F.coalesce(_kind(F.col("v")).startswith("OBJECT"), F.lit(False))
    faults = [F.when(F.col("position").isNull(), "not an array of objects"), F.when(~is_object, "not an object")]
    for c in REQUIRED:
        faults.append(F.when(part(c).isNull(), f"{c} is missing"))
        if c in schemas.DOMAINS["source"]:
            faults.append(F.when(~F.coalesce(string(c).isin(*schemas.DOMAINS["source"][c]), F.lit(False)), f"{c} is unknown"))
        elif c == "rate_limit_per_min":
            faults.append(F.when(number.isNull(), f"{c} is no number"))
    fields = [number.alias(c) if c == "rate_limit_per_min" else string(c).alias(c) for c in REQUIRED]
    return rows.select(*keys, "position", *fields, F.when(is_object, true).alias("enabled"), F.coalesce(*faults).alias("fault"))


def read_roster(spark: SparkSession, path: str) -> DataFrame:
    """Entries of a roster file; one bad entry fails the whole file, naming its place."""
    raw = spark.read.text(path, wholetext=True)
    if raw.isEmpty():  # an empty file
        raise RosterError("a roster is an array of source objects")
    entries = parse_roster(raw)
    bad = entries.where("fault IS NOT NULL").orderBy("position").first()
    if bad and bad.position is None:
        raise RosterError("a roster is an array of source objects")
    if bad:
        raise RosterError(f"entry {bad.position}: {bad.fault}")
    return entries.drop("fault")


def read_requests(df: DataFrame, schema: str, column: str = "body") -> DataFrame:
    """df with the request parsed as a struct; NULL where the body is no such object."""
    return df.withColumn("request", F.from_json(column, schema))


def job_json(jobs_with_items: DataFrame) -> DataFrame:
    """(id, body): each job and its items as one JSON object."""
    return jobs_with_items.select("id", F.to_json(F.struct("public_id", "status", "items")).alias("body"))


def landed_pages(spark: SparkSession, path: str) -> DataFrame:
    """A stream of pages (page_id, url, html) as files land in a folder."""
    return spark.readStream.schema("page_id long, url string, html string").parquet(path)


def page_text(html: Column) -> Column:
    """The readable text of a page: no scripts, styles, comments or tags; five named entities; single spaces."""
    text = F.regexp_replace(html, r"(?is)<!--.*?-->|<script\b.*?</script>|<style\b.*?</style>", " ")
    text = F.regexp_replace(text, r"(?s)<[^>]*>", " ")
    for name, sign in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        text = F.replace(text, F.lit(name), F.lit(sign))
    return F.trim(F.regexp_replace(text, r"[ \t\r\n]+", " "))


def present(spark: SparkSession, names: list[tuple[str, str]]) -> DataFrame:
    """(kind, name, present) for databases and tables of the catalog."""
    look = {"database": spark.catalog.databaseExists, "table": spark.catalog.tableExists}
    return spark.createDataFrame([(kind, name, look[kind](name)) for kind, name in names], "kind string, name string, present boolean")
