"""The canned classifier and summariser, and checks of their requests."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the canned answers.
MAX_CHARS, THIN_CHARS = 20_000, 200
CLASSIFY_BATCH, SUMMARIZE_SYNC_BATCH = 64, 2
TOPIC, TOPIC_CONFIDENCE = "Technology", 0.94
FALLBACK_TOPIC, FALLBACK_CONFIDENCE = "Other", 0.31
WITHHELD_SCORE, SUMMARY_SCORE = 0.42, 0.97
WITHHELD_REASON = "below_faithfulness_bar"
SENTENCES = (
    "A canned summary standing in for model output.",
    "The shapes, limits and error model are real; this prose is not.",
    "Real summarization replaces this without changing the contract.",
)
NO_DOCUMENTS, TOO_LARGE = "no documents supplied", "%d characters exceeds the %d limit"
TAXONOMY_VERSIONS = ("v1",)
STYLES = ("neutral",)


def too_large(n: Column) -> Column:
    return F.format_string(TOO_LARGE, n.cast("int"), F.lit(MAX_CHARS))


def classify_text(text: Column) -> Column:
    """struct(topic, confidence, fallback, error_code, error_message)."""
    n = F.length(F.coalesce(text, F.lit("")))
    big, thin = n > MAX_CHARS, n < THIN_CHARS
    null = lambda kind: F.lit(None).cast(kind)
    return F.struct(
        F.when(big, null("string")).when(thin, FALLBACK_TOPIC).otherwise(TOPIC).alias("topic"),
        F.when(big, null("double")).when(thin, FALLBACK_CONFIDENCE).otherwise(TOPIC_CONFIDENCE).alias("confidence"),
        F.when(big, null("boolean")).otherwise(thin).alias("fallback"),
        F.when(big, "item_too_large").alias("error_code"),
        F.when(big, too_large(n)).alias("error_message"),
    )


def total_chars(documents: Column) -> Column:
    return F.aggregate(documents, F.lit(0).cast("bigint"), lambda a, d: a + F.coalesce(F.length(d["text"]), F.lit(0)))


def provenance(documents: Column) -> Column:
    """The non-empty urls of the documents, in order."""
    return F.filter(F.transform(documents, lambda d: d["url"]), lambda u: u.isNotNull() & (u != ""))


def summarize_documents(documents: Column, max_sentences: Column) -> Column:
    """struct(summary, faithfulness_score, withheld, withhold_reason, provenance, error_code, error_message)."""
    empty = documents.isNull() | (F.size(documents) == 0)
    n = total_chars(documents)
    big, thin = n > MAX_CHARS, n < THIN_CHARS
    bad = empty | big
    kept = F.least(F.greatest(F.coalesce(max_sentences, F.lit(len(SENTENCES))), F.lit(1)), F.lit(len(SENTENCES)))
    text = F.array_join(F.slice(F.array(*map(F.lit, SENTENCES)), F.lit(1), kept), " ")
    null = lambda kind: F.lit(None).cast(kind)
    return F.struct(
        F.when(bad | thin, null("string")).otherwise(text).alias("summary"),
        F.when(bad, null("double")).when(thin, WITHHELD_SCORE).otherwise(SUMMARY_SCORE).alias("faithfulness_score"),
        F.when(bad, null("boolean")).otherwise(thin).alias("withheld"),
        F.when(~bad & thin, WITHHELD_REASON).alias("withhold_reason"),
        F.when(~bad, provenance(documents)).alias("provenance"),
        F.when(empty, "invalid_request").when(big, "item_too_large").alias("error_code"),
        F.when(empty, NO_DOCUMENTS).when(big, too_large(n)).alias("error_message"),
    )


def taxonomy_version(value: Column) -> Column:
    """The requested version, 'v1' when absent or empty."""
    return F.coalesce(F.nullif(value, F.lit("")), F.lit("v1"))


def taxonomy_supported(value: Column) -> Column:
    return taxonomy_version(value).isin(*TAXONOMY_VERSIONS)


def public_id(value: Column) -> Column:
    """A handle in its usual form, else NULL: a malformed one reads as missing.

    Hyphens may stand anywhere, and braces or the prefixes ``urn:`` and ``uuid:`` around 32 hexadecimal digits are fine.
    """
    bare = F.replace(F.replace(value, F.lit("urn:"), F.lit("")), F.lit("uuid:"), F.lit(""))
    bare = F.lower(F.replace(F.btrim(bare, F.lit("{}")), F.lit("-"), F.lit("")))
    parts = [F.substring(bare, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.when(bare.rlike(r"\A[0-9a-f]{32}\z"), F.concat_ws("-", *parts))


def bearer_token(header: Column) -> Column:
    """The trimmed token of a bearer header; NULL when there is none or it is blank."""
    return F.nullif(F.trim(F.regexp_extract(header, "(?i)^bearer (.*)$", 1)), F.lit(""))


def batch_fault(ids: Column, limit: int | None = None) -> Column:
    """Why a batch of item ids is refused, or NULL: empty, too many, or an id twice."""
    over = F.size(ids) > limit if limit else F.lit(False)
    return F.when(F.coalesce(F.size(ids), F.lit(0)) < 1, "empty").when(over, "too_many").when(F.size(F.array_distinct(ids)) != F.size(ids), "duplicate_id")


def is_async(items: Column) -> Column:
    """Whether a summarise batch is over the ceiling of inline answers."""
    return F.size(items) > SUMMARIZE_SYNC_BATCH


def summarize_fault(request: Column) -> Column:
    """The dotted path of the first fault of a summarise request, or NULL.

    Items and each item's documents may not be empty, item ids differ, max_sentences is positive and the style known, when given.
    """
    items = request["items"]
    bare = F.array_position(F.transform(items, lambda x: F.coalesce(F.size(x["documents"]), F.lit(0)) < 1), True)
    path = F.concat(F.lit("items."), (bare - 1).cast("string"), F.lit(".documents"))
    ids = F.transform(items, lambda x: x["id"])
    return (
        F.when(request.isNull() | items.isNull() | (F.size(items) < 1), "items").when(bare > 0, path).when(F.size(F.array_distinct(ids)) != F.size(items), "items")
        .when(request["max_sentences"] <= 0, "max_sentences").when(~request["style"].isin(*STYLES), "style")
    )


def error_code(status: Column) -> Column:
    """The code of an error answer by its HTTP status."""
    return F.when(status == 404, "not_found").when(status >= 500, "internal").otherwise("invalid_request")


def same_secret(given: Column, wanted: Column) -> Column:
    """Whether two secrets are equal; digests are compared, so time does not tell where they differ. NULL is never equal."""
    return F.coalesce(F.sha2(given.cast("binary"), 256) == F.sha2(wanted.cast("binary"), 256), F.lit(False))


def safe_identifier(name: Column) -> Column:
    """Whether a name may stand in a statement as it is."""
    return F.coalesce(name.rlike(r"\A[A-Za-z_][A-Za-z0-9_]*\z"), F.lit(False))
