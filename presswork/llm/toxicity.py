"""Toxicity by subword-bag embeddings averaged into a linear softmax.

A word is the bag of its byte 3- to 5-grams with its borders (A-Z lower-cased),
hashed to ``BUCKETS`` embeddings; a window of ``WINDOW`` words is the average of
its n-grams' embeddings, fed to a linear two-class softmax. A document is as
toxic as its most toxic window, so length does not dilute one bad word, and a
misspelling shares most n-grams with the words it was made from. Embeddings and
softmax are trained jointly in numpy (Adam, whole batches) on at most
``TRAIN_TOXIC`` + ``TRAIN_CLEAN`` labelled documents, the ones with the least
hash of their id, as far as their texts fit in ``TRAIN_BYTES`` a class (a text
that would go beyond is passed over); only ids whose CRC-32 is not a multiple of 5
are read. Epochs and decay were chosen on a fold of those ids, never on held-out ones.

For a linear softmax the margin of an average is the average of the n-grams'
margins, so scoring needs one number a bucket, and runs over flat byte arrays.

Edge cases: null or empty text, and text of white space, has no window and gets the
log odds of the classes in the sample; null
toxic labels and null ids are not learnt from; an id with several labels is toxic
if any is; without labels of both classes every score is 0.5 or the class's
prior; texts of any length are scored whole; repeated rows score alike; an empty
table gives an empty table; other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

BUCKETS, WIDTH, SIZES = 1 << 17, 8, (3, 4, 5)
WINDOW = 5
TRAIN_TOXIC, TRAIN_CLEAN = 2000, 5000
#: Bytes of text of one class that reach the driver at most.
TRAIN_BYTES = 24 << 20
EPOCHS, RATE, DECAY, SEED = 30, 0.06, 3e-5, 7
SLICE = 1 << 20

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[common.SPACE] = 32


def held_out(doc_id: Column) -> Column:
    """Whether CRC-32 of the id as text is a multiple of 5; null ids are held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


class Grams:
    """N-grams of all words of a list of texts: bucket numbers by size and place, and where words begin."""

    def __init__(self, raw: list[bytes]):
        w = self.words = common.Words(raw)
        b = np.concatenate(([np.uint8(32)], _FOLD[w.buf], np.full(8, 32, np.uint8)))  # place p + 1 holds byte p
        space = np.flatnonzero(b == 32)
        after = np.repeat(space[1:], np.diff(space))[: len(w.buf) + 1]  # the next border after each place
        self.n = n = len(after)
        h = b[:n].astype(np.uint32)
        self.bucket, self.valid = [], []
        place = np.arange(n)
        for k in range(1, max(SIZES)):
            h = h * np.uint32(16777619) ^ b[k : n + k]
            if k + 1 in SIZES:
                self.bucket.append(((h * np.uint32(2654435761)) >> np.uint32(32 - BUCKETS.bit_length() + 1)).astype(np.int32))
                self.valid.append(place + k <= after)
        self.at = w.start  # the border before word k is at its start, counted with the leading border
        size = w.end - w.start
        self.count = sum(np.maximum(size + 2 - k + 1, 0) for k in SIZES)

    def word_sums(self, value: np.ndarray) -> np.ndarray:
        total = np.zeros(self.n, np.float32)
        for g, v in zip(self.bucket, self.valid):
            total += np.where(v, value[g], np.float32(0))
        return np.add.reduceat(total, self.at, dtype=np.float64) if len(self.at) else np.zeros(0)


def _windows(words: common.Words) -> tuple[np.ndarray, np.ndarray]:
    """First word and text of each window; texts without words have none."""
    n = -(-words.n // WINDOW)
    doc = np.repeat(np.arange(len(n)), n)
    first = words.first[:-1][doc] + (np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)) * WINDOW
    return first, doc


def margins(raw: list[bytes], value: np.ndarray, bias: float, odds: float) -> np.ndarray:
    """The largest window margin of each text; ``odds`` for texts without words."""
    g = Grams(raw)
    out = np.full(len(raw), odds)
    first, doc = _windows(g.words)
    if len(first):
        m = np.add.reduceat(g.word_sums(value), first) / np.add.reduceat(g.count, first)
        has = np.flatnonzero(g.words.n)
        out[has] = np.maximum.reduceat(m, np.searchsorted(doc, has)) + bias
    return out


def _gram_lists(words: list[bytes], chunk: int = 20_000) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of all words' n-grams in a row, and how many each word has."""
    grams, counts = [], []
    for k in range(0, len(words), chunk):
        g = Grams(words[k : k + chunk])
        place = np.concatenate([np.flatnonzero(v).astype(np.int32) for v in g.valid])
        bucket = np.concatenate([b[v] for b, v in zip(g.bucket, g.valid)])
        owner = np.searchsorted(g.at, place, "right") - 1
        grams.append(bucket[np.argsort(owner, kind="stable")])
        counts.append(np.bincount(owner, minlength=len(g.at)))
    return np.concatenate(grams), np.concatenate(counts)


def train(raw: list[bytes], toxic: np.ndarray) -> tuple[np.ndarray, float, float]:
    """(a margin for each bucket, bias, log odds of the classes) of embeddings and softmax trained together."""
    if not len(raw) or toxic.all() or not toxic.any():
        prior = 0.0 if not len(raw) else (4.0 if toxic.all() else -4.0)
        return np.zeros(BUCKETS, np.float32), prior, prior
    # Distinct words and their n-grams, so that an epoch touches each word once.
    number: dict[bytes, int] = {}
    tokens = [np.fromiter((number.setdefault(w, len(number)) for w in x.translate(bytes(_FOLD)).split()), np.int32) for x in raw]
    keep = [k for k, t in enumerate(tokens) if len(t)]
    y = toxic[keep].astype(np.float64)
    odds = float(np.log(toxic.mean() / (1 - toxic.mean())))
    if not keep or y.min() == y.max():  # one class has no words to learn from
        return np.zeros(BUCKETS, np.float32), odds, odds
    tokens = [tokens[k] for k in keep]
    grams, count = _gram_lists(list(number))
    at = np.cumsum(count) - count
    flat = np.concatenate(tokens)
    n = np.fromiter(map(len, tokens), np.int64, len(tokens))
    w = -(-n // WINDOW)
    doc = np.repeat(np.arange(len(n)), w)
    step = np.arange(len(doc)) - np.repeat(np.cumsum(w) - w, w)
    first = (np.cumsum(n) - n)[doc] + step * WINDOW
    long = np.minimum(WINDOW, n[doc] - step * WINDOW)
    of_doc = np.cumsum(w) - w
    total = np.add.reduceat(count[flat], first)
    rnd = np.random.default_rng(SEED)
    emb = rnd.normal(0, 0.1, (BUCKETS, WIDTH)).astype(np.float32)
    top = rnd.normal(0, 0.5, (WIDTH, 2)).astype(np.float32)
    bias = np.array([0.0, np.log(y.mean() / (1 - y.mean()))], np.float32)
    state = [[np.zeros_like(p), np.zeros_like(p)] for p in (emb, top, bias)]
    for epoch in range(1, EPOCHS + 1):
        value = emb @ (top[:, 1] - top[:, 0])
        words = np.add.reduceat(value[grams], at)
        m = np.add.reduceat(words[flat], first) / total
        hit = np.flatnonzero(m == np.repeat(np.maximum.reduceat(m, of_doc), w))
        best = hit[np.searchsorted(doc[hit], np.arange(len(w)))]
        p = 1 / (1 + np.exp(-np.clip(m[best] + bias[1] - bias[0], -30, 30)))
        coef = (p - y) / len(y)
        # Down to the words of each best window, then to their n-grams.
        k = long[best]
        pick = flat[np.repeat(first[best] - (np.cumsum(k) - k), k) + np.arange(int(k.sum()))]
        share = np.repeat(coef / total[best], k)
        c = count[pick]
        idx = grams[np.repeat(at[pick] - (np.cumsum(c) - c), c) + np.arange(int(c.sum()))]
        down = np.bincount(idx, np.repeat(share, c), BUCKETS).astype(np.float32)
        g_top = (down @ emb)[:, None] * np.array([-1, 1], np.float32)
        g_emb = down[:, None] * (top[:, 1] - top[:, 0])
        g_bias = np.array([-coef.sum(), coef.sum()], np.float32)
        for param, grad, (a, b) in zip((emb, top, bias), (g_emb + DECAY * emb, g_top + DECAY * top, g_bias), state):
            a += 0.1 * (grad - a)
            b += 0.001 * (grad * grad - b)
            param -= RATE * (a / (1 - 0.9**epoch)) / (np.sqrt(b / (1 - 0.999**epoch)) + 1e-8)
    return (emb @ (top[:, 1] - top[:, 0])).astype(np.float32), float(bias[1] - bias[0]), odds


def _within(sizes: list[int], limit: int) -> list[bool]:
    """Which texts are taken, in order, so that their sizes add up to the limit at most."""
    out, at = [], 0
    for n in sizes:
        out.append(at + n <= limit)
        at += n if out[-1] else 0
    return out


def fit(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, float, float]:
    """Trains on the sample of labelled documents that are not held out; its rows and bytes are bounded."""
    key = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("label_id")).agg(F.max("toxic").alias("y"))
    key = key.where(~held_out(F.col("label_id")))
    order = [F.xxhash64("label_id"), F.col("label_id")]
    some = key.where("y = 1").orderBy(*order).limit(TRAIN_TOXIC).unionByName(key.where("y = 0").orderBy(*order).limit(TRAIN_CLEAN))
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text").join(F.broadcast(some), F.col("doc_id") == F.col("label_id"))
    # One text an id, at most the sample; the texts stay in the shared folder until it is known which fit.
    found = common.durable(rows.groupBy("label_id").agg(F.max("y").alias("y"), F.max("text").alias("text")))
    sizes = found.select("label_id", "y", F.coalesce(F.octet_length("text"), F.lit(0)).alias("n"), F.xxhash64("label_id").alias("h")).orderBy("h", "label_id").collect()
    ids = [r.label_id for y in (0, 1) for own in [[r for r in sizes if r.y == y]] for r, ok in zip(own, _within([r.n for r in own], TRAIN_BYTES)) if ok]
    taken = found.join(F.broadcast(docs.sparkSession.createDataFrame([(i,) for i in ids], "label_id long")), "label_id").toArrow()
    turn = np.argsort(taken.column("label_id").to_numpy(), kind="stable")
    raw = common.texts(taken.column("text").combine_chunks()) if len(turn) else []
    return train([raw[k] for k in turn], taken.column("y").to_numpy()[turn] == 1)


def score(docs: DataFrame, model: tuple[np.ndarray, float, float]) -> DataFrame:
    """(doc_id, score) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in common.slices(batches, limit=SLICE):
            m = margins(common.texts(part.column(1)), *shared.value)
            yield common.record(doc_id=part.column(0), score=1 / (1 + np.exp(-np.clip(m, -500, 500))))

    return common.map_arrow(docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.col("text")), run, "doc_id long, score double")


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    found = score(docs, fit(docs, labels))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
