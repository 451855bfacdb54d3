import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from presswork.llm import debruijn as m

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, mark string, spans long"


def slow(rows):
    """(id, words, words removed, digest, spans, paths): spans are runs of repeated windows without a branching node between them."""
    least, edges, words = {}, set(), [WORD.findall(t or "") for _, t in rows]
    windows = [[tuple(w[k : k + 13]) for k in range(len(w) - 12)] if i is not None else [] for (i, _), w in zip(rows, words)]
    for (i, _), own in zip(rows, windows):
        for key in own:
            least[key] = min(i, least.get(key, i))
    for (i, _), own in zip(rows, windows):
        edges.update(key for key in own if least[key] < i)
    ins, outs = Counter(e[1:] for e in edges), Counter(e[:-1] for e in edges)
    into = {e[1:]: e for e in edges}
    root = {e: e for e in edges}

    def find(e):
        while root[e] != e:
            root[e] = root[root[e]]
            e = root[e]
        return e

    for e in edges:
        if ins[e[:-1]] == outs[e[:-1]] == 1:
            root[find(e)] = find(into[e[:-1]])
    out = []
    for (i, _), w, own in zip(rows, words, windows):
        again = [k for k, key in enumerate(own) if least[key] < i]
        spans = sum(not n or again[n - 1] != k - 1 or not ins[own[k][:-1]] == outs[own[k][:-1]] == 1 for n, k in enumerate(again))
        gone = {k + j for k in again for j in range(13)}
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest(), spans, len({find(own[k]) for k in again})))
    return sorted(out, key=str)


@pytest.mark.parametrize("least", [2000, 3])
def test_against_the_plain_definition(spark, monkeypatch, least):
    monkeypatch.setattr(m, "HOT_LEAST", least)
    monkeypatch.setattr(m, "HOT_TIMES", 0)
    monkeypatch.setattr(m, "HOT_ROWS", least // 3)
    rnd = random.Random(8)
    vocab = ["the", "of", "é", "Ça", *[f"w{i}" for i in range(300)]]
    text = lambda n: rnd.choices(vocab, k=n)
    passages = [text(n) for n in (13, 14, 20, 60, 12)] + [["a"] * 40, ["a", "b"] * 20]
    rows = [(None, " ".join(passages[3])), (None, None), (7, None), (7, ""), (8, " \n"), (500, " ".join(passages[3])), (500, " ".join(passages[2])), (500, " ".join(passages[3]))]
    for i in range(120):
        w = text(rnd.randrange(40))
        for _ in range(rnd.randrange(4)):
            p = rnd.choice(passages)
            w += p[rnd.choice([0, 0, 3]) :] + text(rnd.randrange(9))
        rows.append((rnd.randrange(10, 100), rnd.choice([" ", "\n", " \t"]).join(w)))
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA).repartition(3)
    got = sorted((tuple(r) for r in m.digest(df).collect()), key=str)
    assert got == slow(rows)
    assert m.digest(df.limit(0)).count() == 0


def test_on_the_documents(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in df.collect()]
    want = slow(rows)
    assert sorted((tuple(r) for r in m.digest(df).collect()), key=str) == want and any(r[2] for r in want)


def test_paths_end_at_branching_nodes(spark):
    """Two passages that share a middle part: the node before and the node after it branch."""
    word = lambda c, n: [f"{c}{k}" for k in range(n)]
    mid = word("m", 30)
    one, two = word("a", 20) + mid + word("b", 20), word("c", 20) + mid + word("d", 20)
    rows = [(k, " ".join(x)) for k, x in enumerate((one, two, one, two, word("z", 5) + mid))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    rows_ = m.compacted(m.graph(docs, m.repeated_spans(docs), 8)).collect()
    assert len({p.path for r in rows_ for p in r.pieces}) == 5 and sorted((tuple(r) for r in m.digest(docs).collect()), key=str) == slow(rows)


def test_windows_with_equal_fingerprints_but_other_words_stay(spark, monkeypatch):
    """With a first hash that takes all words for one, only the second one can tell windows apart."""
    real = m.common.word_hashes
    monkeypatch.setattr(m.common, "word_hashes", lambda w, second=False: real(w, True) if second else np.ones(len(w.start), np.uint64))
    p = m.Paths([b"a b c d e f g h i j k l m", b"n o p q r s t u v w x y z"], np.array([True, True]))
    assert p.wh[0] == p.wh[1]
    raw = b" ".join(b"w%d" % k for k in range(20))
    check = m._node_hashes(m.common.Words([raw]))[1][:8]
    wrong = check.copy()
    wrong[3] += np.uint64(1)
    kind = pa.list_(pa.struct([("start", pa.int32()), ("checks", pa.binary()), ("cuts", pa.list_(pa.struct([("at", pa.int32()), ("path", pa.int64()), ("brk", pa.bool_())])))]))
    span = lambda start, x: [{"start": start, "checks": x.tobytes(), "cuts": [{"at": 0, "path": 7, "brk": False}]}]
    words, stay, spans, paths = m._verified([raw, raw, raw, raw], pa.array([span(0, wrong), None, span(0, check), span(3, wrong[3:4])], kind))
    assert spans.tolist() == [2, 0, 1, 0] and paths.tolist() == [1, 0, 1, 0]
    assert [int(stay[a:b].sum()) for a, b in zip(words.first, words.first[1:])] == [0, 20, 0, 20]


def test_cut_repeats_keeps_columns_nulls_and_long_texts(spark):
    text = " ".join(f"w{k}" for k in range(40))
    long = " ".join(f"x{k % 5000}" for k in range(60_000))
    rows = [(1, text, "a", 1, 2), (2, "head " + text, None, None, 3), (2, None, "b", 1, 2), (None, text, "c", 1, 2), (3, "", "d", 1, 2), (4, long, "e", 1, 2), (5, long + " tail", "f", 1, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, mark string, row long, spans long")
    got = m.cut_repeats(docs)
    assert got.columns == docs.columns
    want = [(1, text, "a", 1, 2), (2, "head", None, None, 3), (2, None, "b", 1, 2), (None, text, "c", 1, 2), (3, "", "d", 1, 2), (4, long, "e", 1, 2), (5, "tail", "f", 1, 2)]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert m.cut_repeats(docs.limit(0)).collect() == []
