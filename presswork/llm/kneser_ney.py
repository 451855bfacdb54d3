"""Quality classifier: an interpolated modified Kneser-Ney trigram model of words.

The model learns from all trusted texts (labelled quality 1), so what it counts
grows with the input; only every ``FOLD``-th trusted document (by a hash of its
id) is left out, to set the thresholds. Counts and lookups are sharded joins:

1. pairs: each slice of texts sends its distinct word pairs, sorted, with the distinct
   words that follow each; trusted occurrences carry counts and the distinct words before
   each pair. A shard holds a range of pair hashes, so for its pairs all counts of
   trigrams, context sums and numbers of words before are local. Its answers (small
   integers, nearly all zero or one) go back a slice at a time.
2. words: one slice owns each pair and adds the pair up for its two words; sharded by
   word, the sums give the number of pairs that end in a word and that begin with it, and
   go back to the slices that have the word.
3. each slice puts the answers together to log probabilities and sums them by document.

Texts are read again in every step instead of being carried along, and pairs are taken in
``PASSES`` ranges one after the other, so at any time the exchange of one range is on
disk. Answers lie in the shared folder, grouped by the partition that asked; a task reads
those of its own slices. That needs rows that come in the same order whenever docs is
read, as tables give them; a checksum of each slice guards it, and labels that are too
many to broadcast are joined once into a written table first.

No table of the model is broadcast or collected: the driver sees the counts of counts.
Shards follow the bytes of text, so their tables fit one task at any size. Pairs are
known by hashes of ``bits`` bits, which grow with the logarithm of the text, words that
follow a pair by 32 bits of their hash, words by 48.

A document is kept when its perplexity does not exceed the threshold of its
language and length class (under ``SHORT`` words or not): the ``QUANTILE`` of the
left-out trusted documents of that language and class. Where there are none, all
documents of the language and class are used. Quantiles are exact over log
perplexities rounded up to 1/``STEPS``.

Edge cases: null or empty text has no words, perplexity 1 and is kept; null ids
are scored and never trusted; a null language is a language of its own; repeated rows score alike;
without any trusted text perplexity is null and all is kept; an empty table
gives an empty table; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.dataset
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: One trusted document in FOLD sets thresholds instead of being counted.
FOLD = 8
QUANTILE, STEPS = 0.99, 10_000
#: Documents under so many words have less steady perplexities and thresholds of their own.
SHORT = 20
SLICE = 3 << 20
#: Ranges of pairs that are exchanged one after the other, and bytes of text a shard of pairs or words.
PASSES, BYTES_A_SHARD = 4, 16 << 20
#: Folders of answers; a task reads one of them.
GROUPS = 256

_LOW = np.uint64((1 << 48) - 1)
_EDGE = np.uint64(0x5EED5EED5EED)
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)

ASK = "shard int, slice long, n long, keys binary, values array<binary>"
REPLY = "part int, slice long, shard int, check long, values array<binary>"


def contexts(raw: list[bytes]) -> tuple[common.Words, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the two words before each word and of the word; a fixed hash stands before a text."""
    w = common.Words(raw)
    h = common.word_hashes(w) & _LOW
    place = np.arange(len(h)) - w.first[:-1][w.doc]
    back = lambda k: np.where(place >= k, np.concatenate((np.full(k, _EDGE), h))[: len(h)], _EDGE)
    return w, back(2), back(1), h


def pair_key(a: np.ndarray, b: np.ndarray, bits: int) -> np.ndarray:
    return common.mix(a * _A + b) >> np.uint64(64 - bits)


def _short(w: np.ndarray) -> np.ndarray:
    """32 bits of a word."""
    return common.mix(w * _B) >> np.uint64(32)


def _pack(x: np.ndarray) -> bytes:
    """Numbers as planes of their bytes, compressed."""
    raw = np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes()
    return len(raw).to_bytes(4, "little") + pa.compress(raw, "zstd", asbytes=True)


def _numbers(raw: bytes, kind: str = "<u4") -> np.ndarray:
    flat = pa.decompress(raw[4:], int.from_bytes(raw[:4], "little"), "zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(flat, np.uint8).reshape(int(kind[2:]), -1).T).view(kind)[:, 0]


def _pack_keys(keys: np.ndarray) -> bytes:
    """Sorted keys as their differences."""
    return _pack(np.diff(keys, prepend=np.uint64(0)).astype("<u8"))


def _keys(raw: bytes) -> np.ndarray:
    return np.cumsum(_numbers(raw, "<u8"), dtype=np.uint64)


def _distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(where each distinct value of sorted x begins, one past its end)."""
    head = np.flatnonzero(np.append(True, x[1:] != x[:-1])) if len(x) else np.zeros(0, np.int64)
    return head, np.append(head[1:], len(x))


def discounts(found: dict[int, int]) -> tuple[float, float, float]:
    """The three discounts of modified Kneser-Ney from the counts of counts."""
    n1, n2, n3, n4 = (found.get(k, 0) for k in (1, 2, 3, 4))
    if not (n1 and n2 and n3):
        return (0.5, 0.75, 0.9)
    y = n1 / (n1 + 2 * n2)
    return tuple(min(max(d, 0.05), k - 0.05) for k, d in ((1, 1 - 2 * y * n2 / n1), (2, 2 - 3 * y * n3 / n2), (3, 3 - 4 * y * n4 / n3)))


def _cut(n: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
    return np.array([0.0, *d])[np.minimum(n, 3)]


def trusted_ids(labels: DataFrame, fold: int = FOLD) -> DataFrame:
    """(trusted, held): the ids labelled quality 1, and which of them set thresholds."""
    ids = labels.where("quality = 1 AND doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("trusted")).distinct()
    return ids.withColumn("held", F.pmod(F.xxhash64("trusted"), F.lit(fold)) == 0 if fold else F.lit(False))


class Plan:
    """How keys are dealt: ``shards`` equal ranges of ``bits``-bit keys, ``passes`` of them at a time."""

    def __init__(self, size: int, least: int):
        self.bits = min(max(size.bit_length() + 18, 40), 62)
        self.words = max(least, -(-size // BYTES_A_SHARD))
        self.pairs = PASSES * max(least, -(-size // BYTES_A_SHARD // PASSES))

    def starts(self, shards: int, bits: int) -> np.ndarray:
        """The least key of each shard, and one past the last."""
        return np.array([(k << bits) // shards for k in range(shards + 1)], np.uint64)


def _numbered(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(the distinct values of x in order, the number of each x among them, an order of x, where each value begins in it)."""
    order = np.argsort(x)
    ordered = x[order]
    new = np.append(True, ordered[1:] != ordered[:-1]) if len(x) else np.zeros(0, bool)
    number = np.empty(len(x), np.int64)
    number[order] = np.cumsum(new) - 1
    head = np.flatnonzero(new)
    return ordered[head], number, order, head


class Pairs:
    """The pairs of a slice whose keys lie in a range, the words after them, and for trusted texts the words before.

    own: the key of each word's pair (with the word before it). A word's context is the pair of the word before, or
    the pair of two edges. pairs: distinct keys in order. tri: pair number and 32-bit word, distinct and in order; n:
    trusted occurrences. back: pair number and 32-bit word before, distinct, of trusted texts.
    own_at and ctx_at: which words have their pair and their context in the range; own, ctx and tri_of: their numbers.
    """

    def __init__(self, own: np.ndarray, first: np.ndarray, edges: int, u: np.ndarray, w: np.ndarray, learnt: np.ndarray, lo: int, hi: int, words: bool = True):
        """first: whether a word is the first of its text; words: whether the words around pairs are wanted."""
        inside = (own >= np.uint64(lo)) & (own < np.uint64(hi))
        at = np.flatnonzero(inside)
        edge_in = bool(len(own)) and lo <= edges < hi
        keys = np.append(own[at], np.uint64(edges)) if edge_in else own[at]
        self.pairs, number, _, _ = _numbered(keys)
        self.own_at, self.own = at, number[: len(at)]
        if not words:
            return
        of = np.full(len(own) + 1, -1)
        of[at + 1] = self.own
        ctx = np.where(first, number[-1] if edge_in else -1, of[:-1])
        self.ctx_at = np.flatnonzero(ctx >= 0)
        self.ctx = ctx[self.ctx_at]
        self.tri, self.tri_of, order, head = _numbered((self.ctx.astype(np.uint64) << np.uint64(32)) | _short(w[self.ctx_at]))
        self.n = np.add.reduceat(learnt[self.ctx_at][order].astype(np.int64), head) if len(head) else np.zeros(0, np.int64)
        some = learnt[at]
        back = np.sort((self.own[some].astype(np.uint64) << np.uint64(32)) | _short(u[at][some]))
        self.back = back[_distinct(back)[0]]

    def rows(self, starts: np.ndarray, first: int, slice_: int) -> Iterator[tuple]:
        """A row a shard: the keys, how many words follow each and are before each, those words, and the trusted counts."""
        at = np.searchsorted(self.pairs, starts)
        tri, back = ((x >> np.uint64(32)).astype(np.int64) for x in (self.tri, self.back))
        n_tri, n_back = (np.bincount(x, minlength=len(self.pairs)).astype("<u4") for x in (tri, back))
        t, b = np.searchsorted(tri, at), np.searchsorted(back, at)
        for k in np.flatnonzero(np.diff(at)):
            i, j = at[k], at[k + 1]
            words = lambda x, e, k=k: _pack((x[e[k] : e[k + 1]] & np.uint64(0xFFFFFFFF)).astype("<u4"))
            yield int(first + k), slice_, int(j - i), _pack_keys(self.pairs[i:j]), [_pack(n_tri[i:j]), words(self.tri, t), _pack(self.n[t[k] : t[k + 1]].astype("<u4")), _pack(n_back[i:j]), words(self.back, b)]


def _batch(schema: str, rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    """Rows as batches of a few MB."""
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "array<binary>": pa.list_(pa.binary())}
    fields = [f.split(" ") for f in schema.split(", ")]
    held, size = [], 0

    def done() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, (_, t) in zip(zip(*held), fields)], [n for n, _ in fields])

    for row in rows:
        held.append(row)
        size += 64 + sum(len(x) for v in row for x in (v if isinstance(v, list) else [v] if isinstance(v, bytes) else []))
        if size > 4 << 20:
            yield done()
            held, size = [], 0
    if held:
        yield done()


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for at in range(0, batch.num_rows, 16):
            yield from zip(*(c.to_pylist() for c in batch.slice(at, 16).columns))


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch, list[bytes], int]]:
    """(slice number, rows, texts, checksum) of a task's slices; numbers tell the partition."""
    base = TaskContext.get().partitionId() << 32
    held: list[pa.RecordBatch] = []

    def whole() -> Iterator[pa.RecordBatch]:  # slices must not follow the sizes of Arrow batches
        size = 0
        for one in common.slices(batches, 2, SLICE):
            n = one.column(2).nbytes
            if held and size + n > SLICE:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held.clear()
                size = 0
            held.append(one)
            size += n
        if held:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    for k, part in enumerate(whole()):
        raw = common.texts(part.column(2))
        check = 0
        for x in raw:
            check = zlib.crc32(x, check)
        yield base + k, part, raw, check


def _write(replies: DataFrame, folder: str) -> None:
    """Answers by group of partitions, so that a task finds its own in one folder."""
    replies.withColumn("group", F.pmod("part", F.lit(GROUPS))).repartition("group").sortWithinPartitions("group", "part", "slice", "shard").write.mode("append").partitionBy("group").parquet(folder)


def _answers(folder: str) -> dict[int, list[dict]]:
    """The answers for this task's slices, by slice and in order of shards."""
    own = TaskContext.get().partitionId()
    path = f"{folder}/group={own % GROUPS}"
    local = common.local_path(path)
    system, path = (pyarrow.fs.LocalFileSystem(), local) if local else pyarrow.fs.FileSystem.from_uri(path)
    if system.get_file_info(path).type != pyarrow.fs.FileType.Directory:
        return {}
    files = pyarrow.dataset.dataset(path, filesystem=system, format="parquet", exclude_invalid_files=False, ignore_prefixes=[".", "_"])
    out: dict[int, list[dict]] = {}
    found = files.to_batches(filter=pyarrow.dataset.field("part") == own, batch_size=256, batch_readahead=1, fragment_readahead=1, use_threads=False)
    for row in (r for batch in found for r in batch.to_pylist()):
        out.setdefault(row["slice"], []).append(row)
    return {k: sorted(v, key=lambda r: r["shard"]) for k, v in out.items()}


def _rows_of(answers: dict[int, list[dict]], number: int, check: int) -> list[list[bytes]]:
    """The answers to a slice, in order of shards; they are read once and not kept."""
    rows = answers.pop(number, [])
    if any(r["check"] != check for r in rows):
        raise RuntimeError("the documents came in another order than when they were counted; write them to a table first")
    return [r["values"] for r in rows]


def _of_pairs(answers: dict[int, list[dict]], number: int, check: int) -> list[np.ndarray]:
    """For the pairs of a slice: context sum, words after once, twice, more often, words before, whether owned; then the trigrams' counts."""
    rows = _rows_of(answers, number, check)
    pairs = np.concatenate([np.zeros((6, 0), np.uint32), *(_untuples(v[0], v[1], 6) for v in rows)], axis=1).astype(np.int64)
    return [*pairs, np.concatenate([np.zeros(0, np.uint32), *(_numbers(v[2]) for v in rows)]).astype(np.int64)]


def _of_words(answers: dict[int, list[dict]], number: int, check: int) -> list[np.ndarray]:
    """For the words of a slice: pairs' sums that begin with it and how many are one, two, more; pairs that end in it."""
    rows = _rows_of(answers, number, check)
    return list(np.concatenate([np.zeros((5, 0), np.uint32), *(_untuples(v[0], v[1], 5) for v in rows)], axis=1).astype(np.int64))


def _stats(n: np.ndarray) -> np.ndarray:
    """Counts of counts 1 to 4, of 3 and more, all, and their sum."""
    return np.array([*((n == c).sum() for c in (1, 2, 3, 4)), (n >= 3).sum(), (n > 0).sum(), n.sum()], np.int64)


def _tuples(columns: list[np.ndarray]) -> list[bytes]:
    """Columns of small numbers that go together, as the distinct tuples and the number of each row's tuple."""
    key = columns[0].astype(np.uint64)
    for c in columns[1:]:
        key = common.mix(key * _A + c.astype(np.uint64))
    _, first, number = np.unique(key, return_index=True, return_inverse=True)
    return [_pack(np.concatenate([c[first] for c in columns]).astype("<u4")), _pack(number.astype("<u4"))]


def _untuples(table: bytes, number: bytes, columns: int) -> np.ndarray:
    """The columns, as rows of a matrix."""
    return _numbers(table).reshape(columns, -1)[:, _numbers(number)]


def _meet_pairs(own: list[tuple]) -> Iterator[tuple]:
    """The answers of one shard of pairs to each slice, and its counts of counts (part -1: of trigrams, -2: of pairs)."""
    keys = [_keys(r[3]) for r in own]
    n_tri, tri, n, n_back, back = (np.concatenate([_numbers(r[4][k]) for r in own]).astype(np.int64) for k in range(5))
    sizes = [len(k) for k in keys]
    keys = np.concatenate(keys)
    order = np.argsort(keys)
    ordered = keys[order]
    new = np.append(True, ordered[1:] != ordered[:-1])
    pair = np.empty(len(keys), np.int64)
    pair[order] = np.cumsum(new) - 1
    size = int(new.sum())
    triple = (np.repeat(pair, n_tri).astype(np.uint64) << np.uint64(32)) | tri.astype(np.uint64)
    values, number, by, head = _numbered(triple)
    n3 = np.add.reduceat(n[by], head) if len(head) else np.zeros(0, np.int64)
    of = (values >> np.uint64(32)).astype(np.int64)
    sums = [np.bincount(of, x, size).astype(np.int64) for x in (n3, n3 == 1, n3 == 2, n3 >= 3)]
    before = np.unique((np.repeat(pair, n_back).astype(np.uint64) << np.uint64(32)) | back.astype(np.uint64))
    ends = np.bincount((before >> np.uint64(32)).astype(np.int64), minlength=size)
    yield -1, 0, 0, 0, [_pack(_stats(n3).astype("<i8"))]
    yield -2, 0, 0, 0, [_pack(_stats(ends).astype("<i8"))]
    # The first slice that has a pair in trusted text owns it.
    mine = np.zeros(len(keys), np.int64)
    some = np.flatnonzero(n_back > 0)
    mine[some[np.unique(pair[some], return_index=True)[1]]] = 1
    columns = [*(x[pair] for x in (*sums, ends)), mine]
    counts = n3[number] if len(n3) else n3
    a = t = 0
    upto = np.append(0, np.cumsum(n_tri))
    for row, k in zip(own, sizes):
        b, u = a + k, int(upto[a + k])
        yield row[1] >> 32, row[1], row[0], 0, [*_tuples([c[a:b] for c in columns]), _pack(counts[t:u].astype("<u4"))]
        a, t = b, u


def _meet_words(own: list[tuple]) -> Iterator[tuple]:
    """The sums of one shard of words for each slice that asks, and counts of counts (part -3: pairs that end in a word)."""
    rows = [(r[1], _keys(r[3]), [_numbers(x).astype(np.int64) for x in r[4]]) for r in own]
    known = np.unique(np.concatenate([k for _, k, _ in rows]))
    sums = [np.zeros(len(known), np.int64) for _ in rows[0][2]]
    for _, keys, values in rows:
        at = np.searchsorted(known, keys)
        for s, v in zip(sums, values):
            s[at] += v
    yield -3, 0, 0, 0, [_pack(_stats(sums[4]).astype("<i8"))]
    for number, keys, _ in rows:
        at = np.searchsorted(known, keys)
        yield number >> 32, number, own[0][0], 0, _tuples([s[at] for s in sums])


def _exchange(asked: DataFrame, shards: int, meet, folder: str) -> dict[int, np.ndarray]:
    """Brings questions to their shards, writes the answers, and gives the counts of counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for _, group in groupby(_each(batches), key=lambda r: r[0]):
                own = list(group)
                checks = {r[1]: int.from_bytes(r[4][-1], "little") for r in own}
                for part, number, shard, _, values in meet([(*r[:4], r[4][:-1]) for r in own]):
                    yield part, number, shard, checks.get(number, 0), values

        return _batch(REPLY, rows())

    out = common.scratch(asked.sparkSession, "answers")
    met = common.map_arrow(asked.repartition(shards, "shard").sortWithinPartitions("shard", "slice"), run, REPLY)
    met.write.parquet(out)
    found = asked.sparkSession.read.schema(met.schema).parquet(out)
    stats: dict[int, np.ndarray] = {}
    for r in found.where("part < 0").select("part", F.col("values")[0].alias("v")).toLocalIterator():  # seven numbers a shard
        stats[r.part] = stats.get(r.part, 0) + _numbers(bytes(r.v), "<i8")
    _write(found.where("part >= 0"), folder)
    common.remove(asked.sparkSession, out)
    common.release(asked.sparkSession)
    return stats


def perplexity(docs: DataFrame, labels: DataFrame, fold: int = FOLD, used: list[str] | None = None) -> DataFrame:
    """(doc_id, lang, n_words, log_perplexity) of every row; used gets the folders that the result reads."""
    spark = docs.sparkSession
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["lang"].cast("string").alias("lang"), F.col("text"))
    ids = trusted_ids(labels, fold).where("NOT held")
    few = ids.count() <= common.BROADCAST_IDS
    rows = rows.join(F.broadcast(ids) if few else ids, F.col("doc_id") == F.col("trusted"), "left").select("doc_id", "lang", "text", F.col("trusted").isNotNull().alias("learnt"))
    if not few:  # a shuffle would bring rows in another order each time
        rows = common.written(rows, "documents")
    plan = Plan(docs.select(F.sum(F.octet_length("text"))).first()[0] or 0, common.parts(spark))
    bits, starts, w_starts = plan.bits, plan.starts(plan.pairs, plan.bits), plan.starts(plan.words, 48)
    pair_folder, word_folder = common.scratch(spark, "pairs"), common.scratch(spark, "words")
    if used is not None:
        used += [pair_folder, word_folder]

    edges = int(pair_key(np.array([_EDGE]), np.array([_EDGE]), bits)[0])

    def keyed(part: pa.RecordBatch, raw: list[bytes]) -> tuple:
        w, u, v, h = contexts(raw)
        first = np.zeros(len(h), bool)
        first[w.first[:-1][w.n > 0]] = True
        return w, v, h, pair_key(v, h, bits), first, u, part.column(3).to_numpy(zero_copy_only=False)[w.doc]

    def ask_pairs(first: int, last: int) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def out() -> Iterator[tuple]:
                for number, part, raw, check in _slices(batches):
                    _, _, h, own, begins, u, learnt = keyed(part, raw)
                    p = Pairs(own, begins, edges, u, h, learnt, int(starts[first]), int(starts[last]))
                    for row in p.rows(starts[first : last + 1], first, number):
                        yield *row[:4], [*row[4], check.to_bytes(8, "little")]

            return _batch(ASK, out())

        return common.map_arrow(rows, run, ASK)

    stats: dict[int, np.ndarray] = {}
    step = plan.pairs // PASSES
    for k in range(PASSES):
        for key, n in _exchange(ask_pairs(k * step, (k + 1) * step), step, _meet_pairs, pair_folder).items():
            stats[key] = stats.get(key, 0) + n

    def ask_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> Iterator[tuple]:
            answers = _answers(pair_folder)
            for number, part, raw, check in _slices(batches):
                _, v, h, own, begins, u, learnt = keyed(part, raw)
                p = Pairs(own, begins, edges, u, h, learnt, 0, 1 << bits, words=False)
                _, _, _, _, ends, mine, _ = _of_pairs(answers, number, check)
                words = np.unique(np.append(h, _EDGE)) if len(h) else h
                # One occurrence of each pair that this slice owns.
                at = np.zeros(len(p.pairs), np.int64)
                at[p.own] = p.own_at
                some = at[mine.astype(bool)]
                n = ends[mine.astype(bool)]
                a, b = (np.searchsorted(words, x[some]) for x in (v, h))
                sums = [np.bincount(a, x, len(words)) for x in (n, n == 1, n == 2, n >= 3)] + [np.bincount(b, minlength=len(words))]
                cut = np.searchsorted(words, w_starts)
                for k in np.flatnonzero(np.diff(cut)):
                    i, j = cut[k], cut[k + 1]
                    yield int(k), number, int(j - i), _pack_keys(words[i:j]), [*(_pack(x[i:j].astype("<u4")) for x in sums), check.to_bytes(8, "little")]

        return _batch(ASK, out())

    stats |= _exchange(common.map_arrow(rows, ask_words, ASK), plan.words, _meet_words, word_folder)
    one = dict(enumerate(stats.get(-3, np.zeros(7)).tolist(), 1))
    d3, d2, d1 = (discounts(dict(enumerate(stats.get(k, np.zeros(7)).tolist(), 1))) for k in (-1, -2, -3))
    total = one[7]
    unseen = (d1[0] * one[1] + d1[1] * one[2] + d1[2] * one[5]) / total / (one[6] + 1) if total else 0

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, words_ = _answers(pair_folder), _answers(word_folder)
        for number, part, raw, check in _slices(batches):
            w, _, h, own, begins, u, learnt = keyed(part, raw)
            p = Pairs(own, begins, edges, u, h, learnt, 0, 1 << bits)
            c, c1, c2, c3, ends, _, n3 = _of_pairs(pairs, number, check)
            value = pa.nulls(len(raw), pa.float64())
            if total:
                s, s1, s2, s3, k = _of_words(words_, number, check)
                # Every pair, context and word of the slice is in the range; the word before is the edge at a text's start.
                _, of, _, _ = _numbered(np.append(h, _EDGE) if len(h) else h)
                at_w = of[: len(h)]
                at_v = np.where(begins, of[-1] if len(h) else 0, np.append(0, at_w[:-1]) if len(h) else at_w)
                own, ctx, tri = p.own, p.ctx, p.tri_of
                low = np.maximum(k - _cut(k, d1), 0) / total + unseen
                share = np.where(s > 0, s, 1)
                left2 = np.where(s > 0, (d2[0] * s1 + d2[1] * s2 + d2[2] * s3) / share, 1.0)
                p2 = np.maximum(ends - _cut(ends, d2), 0)[own] / share[at_v] + left2[at_v] * low[at_w]
                left3 = np.where(c > 0, (d3[0] * c1 + d3[1] * c2 + d3[2] * c3) / np.where(c > 0, c, 1), 1.0)
                p3 = np.maximum(n3 - _cut(n3, d3), 0)[tri] / np.where(c > 0, c, 1)[ctx] + left3[ctx] * p2
                sums = np.bincount(w.doc, np.log(p3), len(raw))
                value = pa.array(np.round(-sums / np.maximum(w.n, 1), 9) + 0.0)
            yield common.record(doc_id=part.column(0), lang=part.column(1), n_words=pa.array(w.n, pa.int64()), log_perplexity=value)

    return common.map_arrow(rows, finish, "doc_id long, lang string, n_words long, log_perplexity double")


def _quantile(rows: DataFrame, name: str) -> DataFrame:
    """(of, brief, name): the least rounded log perplexity that QUANTILE of the documents of a language and length class do not exceed."""
    bins = rows.where("log_perplexity IS NOT NULL").select(F.col("lang").alias("of"), F.col("short").alias("brief"), F.ceil(F.col("log_perplexity") * STEPS).alias("bin"))
    return bins.groupBy("of", "brief").agg((F.expr(f"percentile_disc({QUANTILE}) WITHIN GROUP (ORDER BY bin)") / STEPS).alias(name))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, perplexity, threshold, kept)."""
    used: list[str] = []
    found = common.written(perplexity(docs, labels, used=used), "perplexities").withColumn("short", F.col("n_words") < SHORT)
    for folder in used:
        common.remove(docs.sparkSession, folder)
    held = found.join(common.sized(trusted_ids(labels).where("held")), F.col("doc_id") == F.col("trusted"), "left_semi")
    own, every = _quantile(held, "own"), _quantile(found, "every")
    same = every["of"].eqNullSafe(own["of"]) & (every["brief"] == own["brief"])
    limits = every.join(own, same, "left").select(every["of"], every["brief"], F.exp(F.coalesce("own", "every")).alias("threshold"))
    mine = F.col("lang").eqNullSafe(F.col("of")) & (F.col("short") == F.col("brief"))
    out = found.join(common.sized(common.durable(limits)), mine, "left").withColumn("perplexity", F.exp("log_perplexity"))
    return out.select("doc_id", "perplexity", "threshold", F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(True)).alias("kept"))
