import math
import random
import re
import struct
from collections import Counter

import pytest
import xxhash

from presswork.llm import quality_rules as m

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def h64(text, seed):
    return xxhash.xxh64_intdigest(text.encode(), seed)


def grams(words):
    out = []
    for a, b in zip(words, [*words[1:], None]):
        one = h64(a, 42)
        two = one if b is None else h64(b, one)
        two = xxhash.xxh64_intdigest(struct.pack("<i", 2), two)
        out += [one, two]
    return [(x - (1 << 64) if x >> 63 else x) % m.BUCKETS for x in out]


def base(text):
    text = text or ""
    w = WORD.findall(text)
    three = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    c = Counter(three)
    cover = {i + j for i, t in enumerate(three) if c[t] > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in text), len(lines) - len(set(lines)), len(cover)


def fold(i):
    h = 42 if i is None else xxhash.xxh64_intdigest(struct.pack("<q", i), 42)
    return (h - (1 << 64) if h >> 63 else h) % m.FOLDS


def limit(bins):
    bins = sorted(bins)

    def at(q):
        x = (len(bins) - 1) * q
        lo, hi = bins[math.floor(x)], bins[math.ceil(x)]
        return lo + (hi - lo) * (x - math.floor(x))

    return (at(0.5) - m.WIDE * max(at(0.5) - at(m.LOW), 1)) / m.STEPS


def slow(rows, trusted):
    """rows: (id, text, language)."""
    raw, good = Counter(), [Counter() for _ in range(m.FOLDS)]
    for i, text, _ in rows:
        g = grams(WORD.findall(text or ""))
        raw.update(g)
        if i in trusted:
            for k in range(m.FOLDS):
                if k != fold(i):
                    good[k].update(g)
    n, tables = sum(raw.values()), []
    for own in good:
        t = sum(own.values())
        tables.append([0.0] * m.BUCKETS if not t else [round(math.log((own[g] + 1) / (t + m.BUCKETS)) - math.log((raw[g] + 1) / (n + m.BUCKETS)), 6) for g in range(m.BUCKETS)])
    scored, known = [], {}
    for i, text, lang in rows:
        g = grams(WORD.findall(text or ""))
        ratio = sum(tables[fold(i)][x] for x in g) / max(1, len(g))
        scored.append(ratio)
        if i in trusted and len(g) >= 100:
            known.setdefault(lang, []).append(math.floor(ratio * m.STEPS))
    every = [b for x in known.values() for b in x]
    out = []
    for (i, text, lang), ratio in zip(rows, scored):
        b = base(text)
        failed = b[0] < 50 or 100 * b[4] > 50 * b[0]
        own = known.get(lang, [])
        least = limit(own if len(own) >= m.LEAST_TRUSTED else every) if every else None
        out.append((i, *b, failed, not failed and (least is None or ratio >= least), ratio))
    return out


def same(got, want):
    key = lambda r: tuple(str(x) for x in r[:-1])
    got, want = sorted(map(tuple, got), key=key), sorted(want, key=key)
    assert [r[:-1] for r in got] == [r[:-1] for r in want]
    assert all(abs(a[-1] - b[-1]) < 1e-9 for a, b in zip(got, want))


@pytest.mark.parametrize("lookups", [0, 48])
def test_against_the_plain_definition(spark, monkeypatch, lookups):
    monkeypatch.setattr(m, "LOOKUPS", lookups)
    rnd = random.Random(1)
    vocab = ["the", "of", "Ça", "x#y", "<b>", "|", "naïve", "𝒳", *[f"w{i}" for i in range(60)]]
    rows = [(None, "a b\x0bc", "x"), (1, None, "x"), (2, "", None), (2, " \n\t", None), (3, "one two", "y"), (3, "a a a a a a\na a a a a a\n\n \nx\r\nx\r\n", "y"), (9, "word " * 20_000, "x")]
    for i in range(240):
        sep = rnd.choice([" ", "\n", "  "])
        words = vocab[: rnd.randrange(30, 68)] if i % 3 else [f"odd{rnd.randrange(10**6)}" for _ in range(90)]
        rows.append((i, sep.join(rnd.choices(words, k=rnd.randrange(1, 150))), rnd.choice(["x", "x", "x", "y", None])))
    labels = [(i, int(i % 3 != 0), None) for i in range(180)] + [(None, 1, 0), (4, 1, 0), (4, 1, 0)]
    df = spark.createDataFrame([(*r, "clash", 7) for r in rows], "doc_id long, text string, lang string, words string, ratio long").repartition(2)
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    want = slow(rows, {i for i, q, _ in labels if q == 1 and i is not None})
    assert len({r[7] for r in want if not r[6]}) == 2
    same(m.digest(df, lab).drop("threshold").collect(), want)
    kept = m.keep_good(df, lab)
    assert kept.columns == df.columns and kept.count() == sum(r[7] for r in want)
    bare = m.digest(df.drop("lang"), lab).where("kept").count()
    assert bare == sum(r[7] for r in slow([(i, t, None) for i, t, _ in rows], {i for i, q, _ in labels if q == 1 and i is not None}))


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    lab = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert m.digest(docs, lab).count() == 0
    some = spark.createDataFrame([(1, "w " * 20 + " ".join(f"v{i}" for i in range(60)))], "doc_id long, text string").repartition(2)
    assert m.digest(some, lab).first().kept and m.digest(some, lab).first().ratio == 0


def test_unseen_good_rows_are_kept_like_trusted_ones(spark):
    """Half the good labels are hidden; their rows are kept as often as those of the other half, and bad rows go."""
    folder = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    hidden = "pmod(hash(doc_id), 2) = 0"
    rows = m.digest(docs, labels.where(f"NOT (quality = 1 AND {hidden})")).where("NOT base_failed").join(docs.select("doc_id", "lang"), "doc_id").join(labels, "doc_id")
    got = {(r.lang, r.quality, r.hid): r.kept for r in rows.selectExpr("lang", "quality", f"{hidden} AS hid", "kept").groupBy("lang", "quality", "hid").agg({"kept": "count"}).selectExpr("*", "`count(kept)` AS kept").collect()}
    kept = {(r.lang, r.quality, r.hid): r.n for r in rows.selectExpr("lang", "quality", f"{hidden} AS hid", "CAST(kept AS INT) AS k").groupBy("lang", "quality", "hid").agg({"k": "sum"}).withColumnRenamed("sum(k)", "n").collect()}
    for lang in ("de", "en", "es", "fr"):
        seen, unseen = (kept[lang, 1, h] / got[lang, 1, h] for h in (False, True))
        assert abs(seen - unseen) <= 0.05 and unseen >= 0.95, (lang, seen, unseen)
        bad = sum(kept[lang, 0, h] for h in (False, True)) / sum(got[lang, 0, h] for h in (False, True))
        assert bad <= 0.1, (lang, bad)


def test_trusted_ids_beyond_the_broadcast_bound_give_the_same_model(spark, sf_dir, monkeypatch):
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    want = m.fit(docs, labels)
    monkeypatch.setattr(m.common, "BROADCAST_IDS", 0)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert m.fit(docs, labels) == want and any(want)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
