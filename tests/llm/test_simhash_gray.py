import random
import re

import numpy as np
import xxhash

from presswork.llm import simhash_gray as m

SCHEMA = "doc_id long, text string, fp string, key long"


def slow_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda x: x[0].lower(), text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_components(pairs):
    ids = {i for i, _ in pairs}
    least = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for i, a in pairs:
            for j, b in pairs:
                if (a ^ b).bit_count() <= 2 and least[j] < least[i]:
                    least[i], changed = least[j], True
    return least


def test_fingerprints_equal_the_plain_definition():
    rnd = random.Random(3)
    words = ["Ab", "çÉ", "x" * 90, "the", "a", "Zz9", "é ü", "w" * 31, "w" * 13]
    texts = ["", " \t\n", "one", "One two", "a  b\x0bc", *[" ".join(rnd.choices(words, k=rnd.randrange(1, 40))) for _ in range(120)]]
    got = m.fingerprints([t.encode() for t in texts])
    assert [int(x) for x in got] == [slow_fingerprint(t) for t in texts]


def test_forest_finds_the_same_sets_as_all_pairs():
    rnd = random.Random(5)
    for spread in (2, 4, 9):
        base = [rnd.getrandbits(64) for _ in range(6)]
        codes = set()
        while len(codes) < 300:
            c = rnd.choice(base)
            for _ in range(rnd.randrange(spread)):
                c ^= 1 << rnd.randrange(64)
            codes.add(c)
        codes = np.array(sorted(codes), np.uint64)
        group = np.arange(len(codes)) % 3
        a, b = m.forest(group, codes)
        label = m._merge(np.arange(len(codes)), a, b)
        for g in range(3):
            at = np.flatnonzero(group == g)
            slow = slow_components([(int(i), int(codes[i])) for i in at])
            assert [int(label[i]) == int(label[j]) for i in at for j in at] == [slow[int(i)] == slow[int(j)] for i in at for j in at]


def test_documents_with_nulls_repeats_and_other_columns(spark):
    rnd = random.Random(9)
    vocab = [f"w{i}" for i in range(400)]
    base = [rnd.choices(vocab, k=200) for _ in range(8)]
    rows = [(None, "a b c", "x", 1), (1, None, "x", 1), (2, "", None, 1), (2, "", None, 1), (3, " \n ", "y", None)]
    for i in range(80):
        t = list(rnd.choice(base))
        for _ in range(rnd.randrange(3)):
            t[rnd.randrange(200)] = rnd.choice(vocab)
        rows.append((10 + i, " ".join(t), "z", i))
    got = {(r.doc_id, r.fingerprint, r.component_id) for r in m.digest(spark.createDataFrame(rows, SCHEMA)).collect()}
    slow = slow_components([(r[0], slow_fingerprint(r[1])) for r in rows if r[0] is not None])
    # Two texts of one id that do not link are apart.
    rows.append((10, " ".join(f"z{i}" for i in range(40)), "z", 0))
    more = {(r.doc_id, r.fingerprint, r.component_id) for r in m.digest(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert more == got | {(10, f"{slow_fingerprint(rows[-1][1]):016x}", 10)}
    del rows[-1]
    assert got == {(r[0], f"{slow_fingerprint(r[1]):016x}", slow.get(r[0])) for r in rows}
    assert m.digest(spark.createDataFrame([], SCHEMA)).count() == 0


def test_hot_buckets_are_split_without_loss(spark):
    rnd = random.Random(2)
    codes = {rnd.getrandbits(10) << 6 | 0xABCD << 48 for _ in range(400)}
    codes |= {c ^ 1 << rnd.randrange(64) ^ 1 << rnd.randrange(64) for c in list(codes)[:50]}
    rows = [(i, c - (1 << 64) if c >> 63 else c) for i, c in enumerate(sorted(codes))]
    df = spark.createDataFrame(rows, "node long, fp long")
    found = {r.node: r.root for r in m.component_roots(m.linked(df, hot=20)).collect()}
    slow = slow_components([(i, c & (1 << 64) - 1) for i, c in rows])
    assert {i: found.get(i, i) for i, _ in rows} == slow


def test_one_document_of_each_group_stays(spark):
    rows = [(5, "a b c d e", "l", 1), (3, "a b c d e", "l", 2), (3, "a b c d e", "l", 2), (9, "q r s t u v", "l", 3), (None, "a b c d e", "l", 4)]
    got = sorted((r.doc_id or -1) for r in m.keep_one(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == [-1, 3, 9]


def test_no_text_goes_with_a_row_that_shares_its_id(spark):
    rnd = random.Random(4)
    vocab = [f"w{i}" for i in range(300)]
    base = [rnd.choices(vocab, k=150) for _ in range(5)]
    rows = []
    for i in range(60):
        t = list(rnd.choice(base))
        t[rnd.randrange(150)] = rnd.choice(vocab)
        rows.append((i // 3, " ".join(t), "l", i % 2))
    rows += [(5, "beta beta beta x", "l", 1), (5, "alpha one two three", "l", 1), (3, "beta beta beta x", "l", 1), (5, "alpha one two three", "l", 1), (6, None, "l", None), (6, "", None, 1)]
    codes = sorted({slow_fingerprint(t) for _, t, _, _ in rows})
    least = slow_components(list(enumerate(codes)))
    groups = {}
    for i, t, _, _ in rows:
        c = slow_fingerprint(t)
        groups.setdefault(least[codes.index(c)], []).append((i, c - (1 << 64) if c >> 63 else c, t))
    for order in (rows, rows[::-1]):
        got = m.keep_one(spark.createDataFrame(order, SCHEMA).repartition(2)).collect()
        assert sorted(r.doc_id for r in got) == sorted(min(x[:2] for x in g)[0] for g in groups.values())
        for r in got:
            c = slow_fingerprint(r.text)
            own = groups[least[codes.index(c)]]
            best = min(x[:2] for x in own)
            assert (r.doc_id, c - (1 << 64) if c >> 63 else c) == best
    texts = {(r.doc_id, r.text) for r in got}
    assert (3, "beta beta beta x") in texts and (5, "alpha one two three") in texts and (5, "beta beta beta x") not in texts
