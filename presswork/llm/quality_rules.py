"""Quality rules with a hashed n-gram log-likelihood ratio, in DataFrame functions only.

Base rules count word characters, symbols, repeated lines and words inside
repeated 3-word windows. The verdict for documents that pass them: every word and
every pair of neighbours is hashed to one of ``BUCKETS``; two multinomials with
additive smoothing are counted, one from trusted texts (labelled quality 1) and
one from the raw corpus, and the mean of log(trusted / raw) over a document's
n-grams must reach its language's threshold. Raw counts cover every word of every
document and need no join; trusted counts cover every word of every trusted one.

No document is scored by trusted counts that hold it: ids are dealt to ``FOLDS``
folds by their hash, and a fold is scored by the trusted texts of the others. So
the scores of trusted rows are like those of unseen ones, and the threshold of a
language comes from them: the median less ``WIDE`` times its distance to the
``LOW`` quantile. Quantiles are exact (interpolated) over scores rounded down to 1/``STEPS``.
Languages with fewer than ``LEAST_TRUSTED`` trusted rows share the threshold of
all trusted rows.

The model has FOLDS * BUCKETS numbers whatever the input; it reaches the scan as
one folded literal, so scoring has no shuffle. Trusted ids and thresholds (a row a
language) are broadcast only where they are counted to be few; beyond that Spark
shuffles both sides.

Edge cases: null or empty text has no words, fails the base rule and has ratio
0; a null doc_id is scored but never trusted; a null language is a language of
its own, and without a column lang all rows are of one; repeated rows are scored
alike; without labels the ratio is 0 everywhere and only base rules decide; an
empty table gives an empty table; extra columns are not read.
"""

from __future__ import annotations

import math
import struct

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

BUCKETS = 1 << 14
SMOOTHING = 1.0
FOLDS = 4
#: A threshold lies this many times the distance from the median to the LOW quantile below the median.
WIDE, LOW, STEPS = 5, 0.16, 10_000
LEAST_TRUSTED = 30
MIN_WORDS = 50
REPEAT_PERCENT = 50
#: Up to this many repeated windows are found by looking through the list of them.
LOOKUPS = 48

_SPACES = " \t\n\x0b\x0c\r"
_SYMBOLS = "[^#*$%&|<>]+"


def words_of(text: Column) -> Column:
    inside = F.btrim(text, F.lit(_SPACES))
    return F.when(inside == "", F.array().cast("array<string>")).otherwise(F.split(inside, r"[\x20\x09-\x0D]+"))


def _one(w: Column) -> Column:
    return F.pmod(F.xxhash64(w), F.lit(BUCKETS)).cast("int")


def _two(w: Column, after: Column) -> Column:
    """The bucket of a pair; the last word pairs with the end (null)."""
    return F.pmod(F.xxhash64(w, after, F.lit(2)), F.lit(BUCKETS)).cast("int")


def trusted_ids(labels: DataFrame) -> DataFrame:
    return labels.where("quality = 1 AND doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("trusted")).distinct()


def _fold(doc_id: Column) -> Column:
    return F.pmod(F.xxhash64(doc_id.cast("long")), F.lit(FOLDS)).cast("int")


def _of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of docs whose id is trusted; only ids are on the other side."""
    return docs.join(common.sized(ids), docs["doc_id"].cast("long") == F.col("trusted"), "left_semi")


def fit(docs: DataFrame, labels: DataFrame) -> list[float]:
    """The log ratio of every fold and bucket, one fold after the other; their counts reach the driver."""

    def counts(rows: DataFrame, *keys: Column) -> list:
        rows = rows.select(*keys, words_of(common.text_or_empty()).alias("words"))
        names = [c for c in rows.columns if c != "words"]
        pairs = F.arrays_zip(F.col("words").alias("w"), F.slice("words", F.lit(2), F.size("words")).alias("v"))
        rows = rows.select(*names, F.explode(pairs).alias("x"))
        rows = rows.select(*names, F.explode(F.array(_one(F.col("x.w")), _two(F.col("x.w"), F.col("x.v")))).alias("g"))
        return rows.groupBy(*names, "g").agg(F.count(F.lit(1)).alias("n")).collect()

    raw, trusted = [0] * BUCKETS, [[0] * BUCKETS for _ in range(FOLDS)]
    for r in counts(docs.select("text")):
        raw[r.g] = r.n
    for r in counts(_of(docs, trusted_ids(labels)), _fold(docs["doc_id"]).alias("fold")):
        for k in range(FOLDS):
            if k != r.fold:
                trusted[k][r.g] += r.n
    n_all, s, out = sum(raw), SMOOTHING, []
    for own in trusted:
        t_all = sum(own)
        out += [round(math.log((t + s) / (t_all + s * BUCKETS)) - math.log((n + s) / (n_all + s * BUCKETS)), 6) if t_all else 0.0 for t, n in zip(own, raw)]
    return out


def _array(numbers: list[float]) -> Column:
    """A constant array of which plans show no values: every plan's text stays on the driver, in several copies of them."""
    jvm = SparkSession.active()._jvm
    values = SparkSession.active().sparkContext._gateway.new_array(jvm.double, len(numbers))
    jvm.java.nio.ByteBuffer.wrap(struct.pack(f">{len(numbers)}d", *numbers)).asDoubleBuffer().get(values)
    catalyst = jvm.org.apache.spark.sql.catalyst.expressions
    literal = catalyst.Literal(catalyst.UnsafeArrayData.fromPrimitiveArray(values), jvm.org.apache.spark.sql.types.DataType.fromDDL("array<double>"))
    return Column(jvm.org.apache.spark.sql.classic.ExpressionUtils.column(literal))


def ratio_of(words: Column, fold: Column, model: list[float]) -> Column:
    """The mean log ratio of a text's words and pairs, by the counts of the other folds."""
    table = _array(model)
    scores = F.transform(words, lambda w, i: F.get(table, _one(w) + fold * BUCKETS) + F.get(table, _two(w, F.get(words, i + 1)) + fold * BUCKETS))
    return F.aggregate(scores, F.lit(0.0), lambda a, x: a + x) / F.greatest(2 * F.size(words), F.lit(1))


def _lang(docs: DataFrame) -> Column:
    return docs["lang"].cast("string") if "lang" in docs.columns else F.lit(None).cast("string")


def _thresholds(bins: DataFrame, *key: str) -> DataFrame:
    """(key, n, threshold) from counts (key, bin, n)."""
    mid, low = (F.percentile("bin", F.lit(q), F.col("n")) for q in (0.5, LOW))
    found = bins.groupBy(*key).agg(F.sum("n").alias("rows"), mid.alias("mid"), low.alias("low"))
    return found.select(*key, "rows", ((F.col("mid") - WIDE * F.greatest(F.col("mid") - F.col("low"), F.lit(1.0))) / STEPS).alias("threshold"))


def limits(docs: DataFrame, labels: DataFrame, model: list[float]) -> tuple[DataFrame, float | None]:
    """((of, threshold) by language, the threshold of all other languages) from the trusted rows with enough words."""
    rows = _of(docs, trusted_ids(labels))
    rows = rows.select(_lang(docs).alias("of"), _fold(docs["doc_id"]).alias("fold"), words_of(common.text_or_empty()).alias("words")).where(F.size("words") >= MIN_WORDS)
    rows = rows.select("of", F.floor(ratio_of(F.col("words"), F.col("fold"), model) * STEPS).alias("bin"))
    bins = common.durable(rows.groupBy("of", "bin").agg(F.count(F.lit(1)).alias("n")))
    every = _thresholds(bins).first()
    return common.durable(_thresholds(bins, "of").where(F.col("rows") >= LEAST_TRUSTED).select("of", "threshold")), every.threshold


def features(docs: DataFrame, model: list[float]) -> DataFrame:
    """docs with the base counts, ``ratio``, ``base_failed`` and ``kept``; needs the columns text, fold and threshold."""
    df = docs.withColumn("text", common.text_or_empty()).withColumn("words", words_of(F.col("text")))
    df = df.withColumn("n", F.size("words"))
    three = F.transform(F.slice("words", F.lit(1), F.greatest(F.col("n") - 2, F.lit(0))), lambda w, i: F.xxhash64(w, F.get("words", i + 1), F.get("words", i + 2)))
    df = df.withColumn("h", three)
    # Places of repeated windows. Few repeated values: look each window up among them;
    # many: sort windows by hash and compare neighbours, so cost stays n log n.
    none = F.array().cast("array<bigint>")
    df = df.withColumn("o", F.when(F.size(F.array_distinct("h")) < F.size("h"), F.sort_array("h")).otherwise(none))
    df = df.withColumn("d", F.array_distinct(F.filter("o", lambda x, j: x == F.get("o", j + 1))))
    looked_up = F.transform("h", lambda x, i: F.when(F.array_contains("d", x), i))
    pairs = F.array_sort(F.transform("h", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    many = F.size("d") > LOOKUPS
    df = df.withColumn("s", F.when(many, pairs).otherwise(F.array().cast("array<struct<h:bigint,i:int>>")))
    again = F.transform("s", lambda x, j: F.when((x["h"] == F.get("s", j + 1)["h"]) | (x["h"] == F.get("s", j - 1)["h"]), x["i"]))
    df = df.withColumn("p", F.when(many, F.array_sort(F.array_compact(again))).when(F.size("d") > 0, F.array_compact(looked_up)).otherwise(F.array().cast("array<int>")))
    covered = F.aggregate(F.transform("p", lambda x, j: F.least(F.lit(3), F.coalesce(F.get("p", j + 1) - x, F.lit(3)))), F.lit(0), lambda a, x: a + x)
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = df.withColumn("lines", lines)
    ratio = ratio_of(F.col("words"), F.col("fold"), model)
    df = df.select(
        "*", F.col("n").cast("long").alias("n_words"), F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("text", _SYMBOLS, "")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        covered.cast("long").alias("n_repeat_words"), ratio.alias("ratio"),
    ).drop("words", "n", "h", "o", "d", "s", "p", "lines")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    return df.withColumn("base_failed", failed).withColumn("kept", ~failed & F.coalesce(F.col("ratio") >= F.col("threshold"), F.lit(True)))


def judged(docs: DataFrame, labels: DataFrame, *columns: Column) -> DataFrame:
    """The given columns of docs, with those of ``features``."""
    model = fit(docs, labels)
    own, rest = limits(docs, labels, model)
    rows = docs.select(*columns, docs["text"].alias("text"), _lang(docs).alias("lang_of"), _fold(docs["doc_id"]).alias("fold"))
    rows = rows.join(common.sized(own), F.col("lang_of").eqNullSafe(F.col("of")), "left").withColumn("threshold", F.coalesce("threshold", F.lit(rest).cast("double")))
    return features(rows.drop("lang_of", "of"), model)


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    df = judged(docs, labels, docs["doc_id"].cast("long").alias("doc_id"))
    found = F.struct("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "ratio", "threshold")
    # Behind a generator, a filter on the result is not pushed below the projections, where it would evaluate them many times over.
    return df.select(F.explode(F.array(found)).alias("found")).select("found.*")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that the rules keep, with the columns of docs.

    The document travels as one struct, so its other columns may have any name.
    """
    df = judged(docs, labels, F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    # A plain filter would be pushed below the projections and evaluate them many times over.
    df = df.select(F.explode_outer(F.when(F.col("kept"), F.array("row"))).alias("row"))
    return df.where("row IS NOT NULL").select("row.*")
