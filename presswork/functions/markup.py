"""Inline markup and frontmatter of authored pages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed patterns of the inline marks, in order of precedence.
MARKS = (
    ("code", r"`[^`]+`"),
    ("link", r"\[[^\]]+\]\([^)]+\)"),
    ("status", r"\{status:[a-z]+\|[^}]+\}"),
    ("date", r"@\d{4}-\d{2}-\d{2}"),
    ("strong", r"\*\*[^*]+\*\*"),
    ("em", r"(?<!\*)\*(?!\*)[^*]+\*(?!\*)"),
)


def epoch_millis(iso: Column) -> Column:
    """Milliseconds since 1970 of a date at midnight UTC; NULL where it is no date."""
    return F.unix_date(F.try_to_date(iso)).cast("bigint") * 86_400_000


def marks(text: Column) -> Column:
    """array<struct<kind, label, value>> of the marks of a text, in order.

    label is what is shown; value is a link's address, a status' colour or a date's milliseconds. Marks inside strong or
    em are found by a second call on the label.
    """
    found = F.regexp_extract_all(text, F.lit("|".join(f"(?:{p})" for _, p in MARKS)), F.lit(0))

    def one(raw: Column) -> Column:
        kind = F.coalesce(*[F.when(raw.rlike(f"\\A(?:{p})\\z"), k) for k, p in MARKS])
        inner = F.substr(raw, F.lit(2), F.length(raw) - 2)
        status = F.regexp_extract(raw, r"(?s)\A\{status:([a-z]+)\|(.*)\}\z", 2)
        link = F.regexp_extract(raw, r"(?s)\A\[([^\]]+)\]\(([^)]+)\)", 1)
        label = F.when(kind == "strong", F.substr(raw, F.lit(3), F.length(raw) - 4)).when(kind == "status", status).when(kind == "link", link).when(kind == "date", F.substr(raw, F.lit(2))).otherwise(inner)
        value = F.when(kind == "status", F.regexp_extract(raw, r"\A\{status:([a-z]+)", 1)).when(kind == "link", F.regexp_extract(raw, r"(?s)\]\(([^)]+)\)\z", 1)).when(kind == "date", epoch_millis(F.substr(raw, F.lit(2))).cast("string"))
        return F.struct(kind.alias("kind"), label.alias("label"), value.alias("value"))

    return F.transform(found, one)


_HEAD = r"(?s)\A---\n(?:(.*?)\n)??---\n"


def frontmatter(source: Column) -> Column:
    """array<struct<key, value>> of the head of a page, one entry a key (the last one counts), in order; empty without a head.

    A line is cut at its first colon; one pair of equal quotes around a value goes.
    """
    lines = F.filter(F.split(F.regexp_extract(source, _HEAD, 1), r"\R"), lambda x: F.trim(x) != "")

    def entry(line: Column) -> Column:
        at = F.instr(line, ":")
        key = F.trim(F.when(at > 0, F.substr(line, F.lit(1), at - 1)).otherwise(line))
        value = F.trim(F.when(at > 0, F.substr(line, at + 1)).otherwise(F.lit("")))
        return F.struct(key.alias("key"), F.when(value.rlike(r"""(?s)\A(".*"|'.*')\z""") & (F.length(value) > 1), F.substr(value, F.lit(2), F.length(value) - 2)).otherwise(value).alias("value"))

    entries = F.transform(lines, entry)
    return F.filter(entries, lambda x, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda y: y["key"] == x["key"]))


def body(source: Column) -> Column:
    """A page without its head."""
    return F.regexp_replace(source, _HEAD, "")
