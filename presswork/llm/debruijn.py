"""Repeated passages by a compacted De Bruijn graph of 13-word windows.

1. Which windows repeat. Consecutive windows of a document that share a minimizer (the
   least hash of their 5-word grams) travel as one record with their coordinate and 48-bit
   fingerprints. Equal windows have equal minimizers, so they meet in one bucket; paths
   whose minimizer occurs in one document only are dropped there, and each other window
   gets the least document that has it, as its source coordinate.
2. The graph. Each distinct repeated window is an edge between the 12-word nodes at its
   ends; the source's words are read again at its coordinate for the hashes of its nodes
   and a second hash of its words. Nodes meet in buckets, each with the words before and
   after it, which count its distinct edges in and out: a node is unbranched with one of
   each. A run of edges in a source without a branching node between is a piece, so most
   nodes (met once, inside a run) send nothing on. Pieces that meet in an unbranched node
   join by it, and star contraction joins give each chain of pieces one name: the
   compacted path.
3. Verification. Every repeated window of a document is compared with its source by the
   second hash of the words at both coordinates; a window whose words differ stays.
   Verified windows in a row without a branching node between are one span.

Skew: a first pass counts paths per minimizer in ``COUNTERS`` counters. Where a
counter stands out its windows are dealt by their own fingerprint instead of the
minimizer's, and each slice sends only its least document of each such window
(larger ones are settled on the spot and dealt by slice), so a passage shared by a
third of all documents costs one record a slice. Source intervals with more than
``HOT_ROWS`` copies are salted in the join that brings their hashes to the copies.
The number of buckets follows the number of paths, so a bucket fits a task.

Only documents with a repeated window, and sources, send their text to a join; Bloom
filters of at most ``BLOOM_WORDS`` longs say which may (a false yes costs a little
shuffle, never a wrong row).

Edge cases: null text has no words; a null id neither removes nor loses words;
equal ids never remove from each other (the id must be smaller), so repeated
rows give equal results, and rows that share an id but not the text are kept
apart by a checksum; documents under 13 words lose nothing; an empty table gives
an empty table; other columns are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .components import component_roots

WINDOW = 13
GRAM = 5
COUNTERS = 1 << 14
#: A counter is hot beyond this many times the mean, and beyond HOT_LEAST paths.
HOT_TIMES, HOT_LEAST = 8, 2000
BLOOM_WORDS = 1 << 20
BUCKETS_A_PARTITION, PATHS_A_BUCKET, NODES_A_BUCKET = 4, 1 << 18, 1 << 20
#: Copies of a source interval beyond which they are salted.
HOT_ROWS = 2000
SLICE = 1 << 20
#: Longest path in one record.
PATH = 64

_C = np.uint64(0x9E3779B97F4A7C15)
SPAN = "doc_id long, mark long, start int, windows int, src_doc long, src_mark long, src_start int"


def _poly(h: np.ndarray, size: int) -> np.ndarray:
    out, power = h.copy(), np.uint64(1)
    with np.errstate(over="ignore"):
        for j in range(1, size):
            power = power * _C
            out[: len(h) - j] += h[j:] * power
    return out


class Paths:
    """The windows of a list of texts, and the paths of windows with one minimizer."""

    def __init__(self, raw: list[bytes], usable: np.ndarray):
        w = self.words = common.Words(raw)
        h = common.word_hashes(w)
        n = np.where(usable, np.maximum(w.n - WINDOW + 1, 0), 0)
        total = int(n.sum())
        self.doc = np.repeat(np.arange(len(raw)), n)
        base = np.cumsum(n) - n
        self.start = np.arange(total) - base[self.doc]
        if not total:
            self.mv = self.wh = np.zeros(0, np.uint64)
            self.first, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)
            return
        at = w.first[:-1][self.doc] + self.start
        five = _poly(h, GRAM)
        g = common.mix(five.copy())
        two = np.minimum(g[:-1], g[1:])
        four = np.minimum(two[:-2], two[2:])
        eight = np.minimum(four[:-4], four[4:])
        self.mv = np.minimum(eight[at], g[at + 8])
        with np.errstate(over="ignore"):
            c5 = _C**np.uint64(5)
            c10 = c5 * c5
            three = h[:-2] + h[1:-1] * _C + h[2:] * (_C * _C)
            self.wh = common.mix(five[at] + five[at + 5] * c5 + three[at + 10] * c10)
        cut = np.append(True, (self.mv[1:] != self.mv[:-1]) | (self.doc[1:] != self.doc[:-1]))
        first = np.flatnonzero(cut)
        inside = np.arange(total) - np.repeat(first, np.diff(np.append(first, total)))
        self.first = np.flatnonzero(inside % PATH == 0)
        self.size = np.diff(np.append(self.first, total))


def _counter(mv: np.ndarray) -> np.ndarray:
    return (common.mix(mv.copy()) & np.uint64(COUNTERS - 1)).astype(np.int64)


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.col("text"))


def _usable(part: pa.RecordBatch) -> np.ndarray:
    return ~part.column(0).is_null().to_numpy(zero_copy_only=False)


def hot_counters(docs: DataFrame) -> tuple[np.ndarray, int]:
    """(which counters stand out, how many paths there are); at most COUNTERS numbers reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(COUNTERS, np.int64)
        for part in common.slices(batches, limit=SLICE):
            p = Paths(common.texts(part.column(1)), _usable(part))
            n += np.bincount(_counter(p.mv[p.first]), minlength=COUNTERS)
        some = np.flatnonzero(n)
        yield common.record(counter=pa.array(some, pa.int64()), n=pa.array(n[some], pa.int64()))

    found = common.map_arrow(_rows(docs), run, "counter long, n long").groupBy("counter").agg(F.sum("n").alias("n")).collect()
    n = np.zeros(COUNTERS, np.int64)
    for r in found:
        n[r.counter] = r.n
    return n > max(HOT_LEAST, HOT_TIMES * n.mean()), int(n.sum())


def _blob(sel: np.ndarray, columns: list[np.ndarray]) -> list[bytes]:
    return [c[sel].tobytes() for c in columns]


def _deal(docs: DataFrame, hot: np.ndarray, buckets: int) -> DataFrame:
    """One row for each slice and bucket: the paths as flat little-endian arrays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() * 7919
        for k, part in enumerate(common.slices(batches, limit=SLICE)):
            raw = common.texts(part.column(1))
            p = Paths(raw, _usable(part))
            if not len(p.mv):
                continue
            ids = part.column(0).fill_null(0).to_numpy()
            marks = np.fromiter(map(zlib.crc32, raw), np.uint32, len(raw))
            first, size = p.first, p.size
            is_hot = hot[_counter(p.mv[first])]
            done = np.zeros(0, np.int64), np.zeros(0, np.int64)
            spread = np.mod(common.mix(p.mv[first] + np.uint64(1)), np.uint64(buckets)).astype(np.int64)
            if is_hot.any():
                at = np.repeat(first[is_hot], size[is_hot])
                at = at + np.arange(len(at)) - np.repeat(np.cumsum(size[is_hot]) - size[is_hot], size[is_hot])
                order = at[np.lexsort((p.start[at], ids[p.doc[at]], p.wh[at]))]
                head = np.flatnonzero(np.append(True, p.wh[order[1:]] != p.wh[order[:-1]]))
                least = np.repeat(order[head], np.diff(np.append(head, len(order))))
                later = ids[p.doc[order]] > ids[p.doc[least]]
                done = order[later], least[later]
                keep = order[~later]
                first, size = np.concatenate((first[~is_hot], keep)), np.concatenate((size[~is_hot], np.ones(len(keep), np.int64)))
                spread = np.concatenate((spread[~is_hot], np.mod(p.wh[keep], np.uint64(buckets)).astype(np.int64)))
            order = np.argsort(spread, kind="stable")
            first, size, spread = first[order], size[order], spread[order]
            doc = p.doc[first]
            cut = np.flatnonzero(np.append(True, spread[1:] != spread[:-1]))
            at = np.repeat(first - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
            wh = np.ascontiguousarray(p.wh[at].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6])
            ends = np.append(0, np.cumsum(size))
            cols = [p.mv[first], ids[doc], marks[doc], p.start[first].astype(np.int32), size.astype(np.uint8)]
            out: list[list] = [[] for _ in range(7)]
            for a, b in zip(cut, np.append(cut[1:], len(first))):
                for o, v in zip(out, [int(spread[a]), *(c[a:b].tobytes() for c in cols), wh[ends[a] : ends[b]].tobytes()]):
                    o.append(v)
            names = ("bucket", "mv", "doc", "mark", "start", "size", "wh")
            yield pa.RecordBatch.from_arrays([*(pa.array(o, pa.int32() if k == 0 else pa.binary()) for k, o in enumerate(out)), pa.nulls(len(cut), pa.binary())], [*names, "done"])
            if len(done[0]):
                a, b = done
                settled = np.stack([ids[p.doc[a]], marks[p.doc[a]].astype(np.int64), p.start[a], ids[p.doc[b]], marks[p.doc[b]].astype(np.int64), p.start[b]])
                yield pa.RecordBatch.from_arrays([pa.array([(number + k) % buckets], pa.int32()), *(pa.nulls(1, pa.binary()) for _ in range(6)), pa.array([settled.tobytes()], pa.binary())], [*names, "done"])

    return common.map_arrow(_rows(docs), run, "bucket int, mv binary, doc binary, mark binary, start binary, size binary, wh binary, done binary")


def _spans(doc, mark, start, src_doc, src_mark, src_start) -> pa.RecordBatch:
    """Spans from windows in document order: neighbours on one diagonal of one source become one."""
    same = (doc[1:] == doc[:-1]) & (mark[1:] == mark[:-1]) & (start[1:] == start[:-1] + 1) & (src_doc[1:] == src_doc[:-1]) & (src_mark[1:] == src_mark[:-1]) & (src_start[1:] == src_start[:-1] + 1)
    f = np.flatnonzero(np.append(True, ~same))
    n = np.diff(np.append(f, len(doc)))
    return common.record(
        doc_id=pa.array(doc[f], pa.int64()), mark=pa.array(mark[f], pa.int64()), start=pa.array(start[f], pa.int32()), windows=pa.array(n, pa.int32()),
        src_doc=pa.array(src_doc[f], pa.int64()), src_mark=pa.array(src_mark[f], pa.int64()), src_start=pa.array(src_start[f], pa.int32()),
    )


def _settle(rows: list[list[bytes]]) -> pa.RecordBatch | None:
    """The repeated windows of one bucket, as spans."""
    mv, doc, mark, start, size, wh = (np.frombuffer(b"".join(r[k] for r in rows), t) for k, t in enumerate(("<u8", "<i8", "<u4", "<i4", "u1", "u1")))
    size = size.astype(np.int64)
    order = np.argsort(mv, kind="stable")
    head = np.flatnonzero(np.append(True, mv[order[1:]] != mv[order[:-1]]))
    count = np.diff(np.append(head, len(order)))
    own = doc[order]
    many = np.repeat(np.minimum.reduceat(own, head) < np.maximum.reduceat(own, head), count)
    pick = np.sort(order[many])
    if not len(pick):
        return None
    base = np.cumsum(size) - size
    n = size[pick]
    path = np.repeat(pick, n)
    step = np.arange(len(path)) - np.repeat(np.cumsum(n) - n, n)
    six = wh.reshape(-1, 6)[base[path] + step]
    wide = np.zeros((len(six), 8), np.uint8)
    wide[:, :6] = six
    key = common.mix(mv[path].copy()) ^ (wide.view("<u8")[:, 0] << np.uint64(16))
    d, s, m = doc[path], start[path] + step, mark[path].astype(np.int64)
    order = np.lexsort((m, s, d, key))
    head = np.flatnonzero(np.append(True, key[order[1:]] != key[order[:-1]]))
    least = np.empty(len(order), np.int64)
    least[order] = np.repeat(order[head], np.diff(np.append(head, len(order))))
    dup = np.flatnonzero(d > d[least])
    if not len(dup):
        return None
    return _spans(d[dup], m[dup], s[dup].astype(np.int64), d[least[dup]], m[least[dup]], s[least[dup]].astype(np.int64))


def repeated_spans(docs: DataFrame) -> DataFrame:
    """Spans of windows that begin in a document with a smaller id too, with the source's coordinate."""
    parts = common.parts(docs.sparkSession)
    hot, paths = hot_counters(docs)
    buckets = max(parts * BUCKETS_A_PARTITION, -(-paths // PATHS_A_BUCKET))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now = [], None
        for batch in batches:  # sorted by bucket
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[0] != now and held:
                    if (out := _settle(held)) is not None:
                        yield out
                    held = []
                now = row[0]
                if row[7] is None:
                    held.append(row[1:7])
                else:
                    x = np.frombuffer(row[7], np.int64).reshape(6, -1)
                    yield _spans(*x[:, np.lexsort((x[2], x[1], x[0]))])
        if held and (out := _settle(held)) is not None:
            yield out

    dealt = _deal(docs, hot, buckets).repartition(parts, "bucket").sortWithinPartitions("bucket")
    return common.map_arrow(dealt, run, SPAN)


def _bloom_places(ids: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    h = common.mix(ids.astype(np.uint64) + _C)
    both = np.stack([h, common.mix(h + _C)])
    return (both >> np.uint64(6)) & np.uint64(words - 1), np.uint64(1) << (both & np.uint64(63))


def _bloom(ids: DataFrame) -> np.ndarray:
    """A filter of the ids: a power of two of longs, at most BLOOM_WORDS, or-ed together by Spark."""
    n = ids.count()
    words = 1 << min(max((n // 4).bit_length(), 6), BLOOM_WORDS.bit_length() - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(words, np.uint64)
        for batch in batches:
            for w, b in zip(*_bloom_places(batch.column(0).to_numpy(), words)):
                np.bitwise_or.at(bits, w.astype(np.int64), b)
        some = np.flatnonzero(bits)
        yield common.record(word=pa.array(some, pa.int64()), bits=pa.array(bits[some].view(np.int64), pa.int64()))

    out = np.zeros(words, np.uint64)
    for r in common.map_arrow(ids, run, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toLocalIterator():
        out[r.word] = np.uint64(r.bits & (1 << 64) - 1)
    return out


def _node_hashes(words: common.Words) -> tuple[np.ndarray, np.ndarray]:
    """(the hash of the 12-word node at each word, the second hash of the window at each word); those that leave a text mean nothing."""
    def padded(h: np.ndarray, size: int) -> np.ndarray:
        return common.mix(_poly(np.append(h, np.zeros(size, np.uint64)), size))

    return padded(common.word_hashes(words), WINDOW - 1), padded(common.word_hashes(words, second=True), WINDOW)


def _texts(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(doc_id, mark, raw): the texts of documents whose id may be among ids, each once."""
    shared = docs.sparkSession.sparkContext.broadcast(_bloom(ids))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in common.slices(batches, limit=SLICE):
            raw = common.texts(part.column(1))
            word, bit = _bloom_places(part.column(0).fill_null(0).to_numpy(), len(shared.value))
            some = np.flatnonzero(_usable(part) & ((shared.value[word.astype(np.int64)] & bit) == bit).all(0))
            yield common.record(doc_id=part.column(0).take(pa.array(some)), mark=pa.array([zlib.crc32(raw[k]) for k in some], pa.int64()), raw=pa.array([raw[k] for k in some], pa.binary()))

    return common.map_arrow(_rows(docs), look, "doc_id long, mark long, raw binary").groupBy("doc_id", "mark").agg(F.first("raw").alias("raw"))


SOURCE = ["src_doc", "src_mark"]
GRAPH = "kind int, src_doc long, src_mark long, bucket int, a binary, b binary, c binary, d binary, e binary, f binary"
DOC, NODE = 0, 1


def graph(docs: DataFrame, spans: DataFrame, buckets: int) -> DataFrame:
    """Rows of two kinds, read from the sources' texts: the edges of a source (a starts, b second hashes), and nodes by bucket.

    A node has its hash (a), its coordinate (b document, c mark, d place) and 32 bits of the words before and after it (e, f), zero at an end of its run.
    """
    wanted = spans.select(*SOURCE, "src_start", "windows").distinct().groupBy(*SOURCE).agg(F.collect_list(F.struct("src_start", "windows")).alias("own"))
    texts = _texts(docs, spans.select(F.col("src_doc").alias("doc_id")).distinct())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in common.slices(batches, 2, SLICE):
            words = common.Words(common.texts(part.column(2)))
            node, check = _node_hashes(words)
            word = (common.word_hashes(words) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
            docs_, marks = part.column(0).to_numpy(), part.column(1).to_numpy()
            rows: list[list] = [[] for _ in range(2)]
            nodes: list[tuple] = []
            for k, own in enumerate(part.column(3).to_pylist()):
                at = np.unique(np.concatenate([np.arange(x["src_start"], x["src_start"] + x["windows"]) for x in own]))
                base = words.first[k]
                rows[0].append(at.astype("<i4").tobytes())
                rows[1].append(check[at + base].astype("<u8").tobytes())
                new = np.append(True, at[1:] != at[:-1] + 1)
                ends = at[np.append(new[1:], True)] + 1
                place = np.concatenate((at, ends))
                before = np.where(np.append(new, np.zeros(len(ends), bool)), 0, word[place + base - 1])
                after = np.where(np.arange(len(place)) < len(at), word[np.minimum(place + base + WINDOW - 1, len(word) - 1)], 0)
                nodes.append((node[place + base], np.full(len(place), docs_[k]), np.full(len(place), marks[k]), place, before, after))
            none = pa.nulls(part.num_rows, pa.binary())
            yield common.record(kind=pa.array([DOC] * part.num_rows, pa.int32()), src_doc=part.column(0), src_mark=part.column(1), bucket=pa.nulls(part.num_rows, pa.int32()), a=pa.array(rows[0], pa.binary()), b=pa.array(rows[1], pa.binary()), c=none, d=none, e=none, f=none)
            cols = [np.concatenate(x).astype(t) for x, t in zip(zip(*nodes), ("<u8", "<i8", "<u4", "<i4", "<u4", "<u4"))]
            spread = (common.mix(cols[0].copy()) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(spread, kind="stable")
            spread, cols = spread[order], [c[order] for c in cols]
            cut = np.flatnonzero(np.append(True, spread[1:] != spread[:-1]))
            blobs = [[c[x:y].tobytes() for x, y in zip(cut, [*cut[1:], len(spread)])] for c in cols]
            n = len(cut)
            yield common.record(kind=pa.array([NODE] * n, pa.int32()), src_doc=pa.nulls(n, pa.int64()), src_mark=pa.nulls(n, pa.int64()), bucket=pa.array(spread[cut], pa.int32()), **{c: pa.array(x, pa.binary()) for c, x in zip("abcdef", blobs)})

    rows = texts.join(wanted, (F.col("doc_id") == F.col("src_doc")) & (F.col("mark") == F.col("src_mark"))).select(*SOURCE, "raw", "own")
    return common.map_arrow(rows, run, GRAPH)


def _junctions(rows: list[list[bytes]]) -> pa.RecordBatch:
    """What the nodes of one bucket tell their documents; a node that stands once tells nothing."""
    node, doc, mark, place, before, after = (np.frombuffer(b"".join(r[k] for r in rows), t) for k, t in enumerate(("<u8", "<i8", "<u4", "<i4", "<u4", "<u4")))
    order = np.lexsort((place, mark, doc, node))
    node, doc, mark, place, before, after = (x[order] for x in (node, doc, mark, place, before, after))
    head = np.flatnonzero(np.append(True, node[1:] != node[:-1]))
    size = np.diff(np.append(head, len(node)))
    group = np.repeat(np.arange(len(head)), size)

    def kinds(x: np.ndarray) -> np.ndarray:
        both = np.unique((group[x > 0].astype(np.uint64) << np.uint64(32)) | x[x > 0])
        return np.bincount((both >> np.uint64(32)).astype(np.int64), minlength=len(head))

    branching = ((kinds(before) != 1) | (kinds(after) != 1))[group]
    many = (size > 1)[group]
    least = np.zeros(len(node), bool)
    least[head] = True
    heads = np.flatnonzero(branching & many & (after > 0))
    ends = np.flatnonzero(~branching & many & (least | (before == 0) | (after == 0)))
    some = np.concatenate((heads, ends))
    edge = np.where(after[some] > 0, place[some], place[some] - 1)
    return common.record(
        src_doc=pa.array(doc[some], pa.int64()), src_mark=pa.array(mark[some], pa.int64()), place=pa.array(edge, pa.int32()),
        node=pa.array(node[some].view(np.int64), pa.int64(), mask=np.arange(len(some)) < len(heads)),
    )


def compacted(rows: DataFrame) -> DataFrame:
    """(src_doc, src_mark, pieces): the pieces (first, n, path, brk) of each source in order; brk tells that a branching node begins it."""

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now = [], None
        for batch in batches:  # sorted by bucket
            for bucket, *blobs in zip(*(c.to_pylist() for c in batch.columns)):
                if bucket != now and held:
                    yield _junctions(held)
                    held = []
                now = bucket
                held.append(blobs)
        if held:
            yield _junctions(held)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, tags = [], []
            for doc, mark, starts, told in zip(*(c.to_pylist() for c in batch.columns)):
                at = np.frombuffer(starts, "<i4").astype(np.int64)
                heads = np.isin(at, [x["place"] for x in told or [] if x["node"] is None])
                first = np.flatnonzero(np.append(True, at[1:] != at[:-1] + 1) | heads)
                names = common.mix(np.full(len(first), doc, np.int64).view(np.uint64) * _C + np.uint64(mark) + (at[first].astype(np.uint64) << np.uint64(32))).view(np.int64)
                size = np.diff(np.append(first, len(at)))
                out.append([{"first": int(a), "n": int(n), "piece": int(p), "brk": bool(b)} for a, n, p, b in zip(at[first], size, names, heads[first])])
                ends = [x for x in told or [] if x["node"] is not None]
                of = np.searchsorted(at[first], [x["place"] for x in ends], "right") - 1
                tags.append([{"piece": int(names[k]), "node": x["node"]} for k, x in zip(of, ends)])
            yield common.record(
                src_doc=batch.column(0), src_mark=batch.column(1), pieces=pa.array(out, pa.list_(pa.struct([("first", pa.int32()), ("n", pa.int32()), ("piece", pa.int64()), ("brk", pa.bool_())]))),
                tags=pa.array(tags, pa.list_(pa.struct([("piece", pa.int64()), ("node", pa.int64())]))),
            )

    parts = common.parts(rows.sparkSession)
    dealt = rows.where(F.col("kind") == NODE).select("bucket", *"abcdef").repartition(parts, "bucket").sortWithinPartitions("bucket")
    told = common.map_arrow(dealt, meet, "src_doc long, src_mark long, place int, node long").groupBy(*SOURCE).agg(F.collect_list(F.struct("place", "node")).alias("told"))
    owned = rows.where(F.col("kind") == DOC).select(*SOURCE, F.col("a").alias("starts")).join(told, SOURCE, "left").select(*SOURCE, "starts", "told")
    pieces = common.durable(common.map_arrow(owned, cut, "src_doc long, src_mark long, pieces array<struct<first:int,n:int,piece:long,brk:boolean>>, tags array<struct<piece:long,node:long>>"))
    # Pieces that meet in an unbranched node are one path.
    tags = pieces.select(F.explode("tags").alias("t")).select("t.*").distinct()
    least = tags.groupBy("node").agg(F.min("piece").alias("v"))
    roots = component_roots(tags.join(least, "node").select(F.col("piece").alias("u"), "v"))
    flat = pieces.select(*SOURCE, F.explode("pieces").alias("p")).join(roots, F.col("p.piece") == F.col("node"), "left")
    return flat.groupBy(*SOURCE).agg(F.array_sort(F.collect_list(F.struct("p.first", "p.n", F.coalesce("root", "p.piece").alias("path"), "p.brk"))).alias("pieces"))


def verified_by(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """(doc_id, mark, spans): every document's spans with the second hashes of their sources' windows, and their paths."""
    windows = spans.agg(F.sum("windows")).first()[0] or 0
    rows = common.durable(graph(docs, spans, max(common.parts(docs.sparkSession) * BUCKETS_A_PARTITION, -(-windows // NODES_A_BUCKET))))
    common.release(docs.sparkSession)
    of = spans.groupBy(*SOURCE, "src_start", "windows").agg(F.count(F.lit(1)).alias("copies"))
    salts = F.ceil(F.col("copies") / HOT_ROWS).cast("int")
    hot = common.durable(of.where(F.col("copies") > HOT_ROWS).select(*SOURCE, "src_start", "windows", salts.alias("salts")))
    wanted = of.groupBy(*SOURCE).agg(F.collect_list(F.struct("src_start", "windows", salts.alias("salts"))).alias("own"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, mark, starts, checks, pieces, own in zip(*(c.to_pylist() for c in batch.columns)):
                at, firsts = np.frombuffer(starts, "<i4"), [p["first"] for p in pieces]
                out: list[list] = [[] for _ in range(5)]
                for x in own:
                    a, n = x["src_start"], x["windows"]
                    k = int(np.searchsorted(at, a))
                    cuts = []
                    for p in pieces[bisect_right(firsts, a) - 1 : bisect_left(firsts, a + n)]:
                        cuts.append({"at": max(p["first"] - a, 0), "path": p["path"], "brk": p["brk"] and p["first"] >= a})
                    for salt in range(x["salts"]):
                        for o, v in zip(out, (a, n, salt, checks[8 * k : 8 * (k + n)], cuts)):
                            o.append(v)
                    if len(out[0]) >= 4096:
                        yield _intervals(doc, mark, out)
                        out = [[] for _ in range(5)]
                if out[0]:
                    yield _intervals(doc, mark, out)

    owned = rows.where(F.col("kind") == DOC).select(*SOURCE, F.col("a").alias("starts"), F.col("b").alias("checks"))
    joined = owned.join(compacted(rows), SOURCE).join(wanted, SOURCE).select(*SOURCE, "starts", "checks", "pieces", "own")
    intervals = common.map_arrow(joined, run, "src_doc long, src_mark long, src_start int, windows int, salt int, checks binary, cuts array<struct<at:int,path:long,brk:boolean>>")
    key = [*SOURCE, "src_start", "windows"]
    salted = spans.join(common.sized(hot), key, "left").withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.coalesce("salts", F.lit(1))).cast("int"))
    both = salted.join(intervals, [*key, "salt"])
    return both.groupBy("doc_id", "mark").agg(F.collect_list(F.struct("start", "checks", "cuts")).alias("spans"))


def _intervals(doc: int, mark: int, rows: list[list]) -> pa.RecordBatch:
    n = len(rows[0])
    return common.record(
        src_doc=pa.array([doc] * n, pa.int64()), src_mark=pa.array([mark] * n, pa.int64()), src_start=pa.array(rows[0], pa.int32()), windows=pa.array(rows[1], pa.int32()), salt=pa.array(rows[2], pa.int32()),
        checks=pa.array(rows[3], pa.binary()), cuts=pa.array(rows[4], pa.list_(pa.struct([("at", pa.int32()), ("path", pa.int64()), ("brk", pa.bool_())]))),
    )


def _lengths(column: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def _verified(raw: list[bytes], spans: pa.Array) -> tuple[common.Words, np.ndarray, np.ndarray, np.ndarray]:
    """(words, which of them stay, spans a text, paths a text), for all texts at once."""
    words = common.Words(raw)
    _, check = _node_hashes(words)
    n = len(raw)
    flat = spans.flatten()
    start, checks, cuts = (flat.field(k) for k in range(3))
    sizes = pc.binary_length(checks).to_numpy(zero_copy_only=False).astype(np.int64) // 8
    base = np.cumsum(sizes) - sizes
    total = int(sizes.sum())
    doc = np.repeat(np.repeat(np.arange(n), _lengths(spans)), sizes)
    at = np.repeat(start.to_numpy(zero_copy_only=False).astype(np.int64) - base, sizes) + np.arange(total)
    good = check[words.first[doc] + at] == np.frombuffer(b"".join(checks.to_pylist()), "<u8") if total else np.zeros(0, bool)
    cut = cuts.flatten()
    place = np.repeat(base, _lengths(cuts)) + cut.field(0).to_numpy(zero_copy_only=False).astype(np.int64)
    path = np.repeat(cut.field(1).to_numpy(zero_copy_only=False).astype(np.int64), np.diff(np.append(place, total)))
    brk = np.zeros(total, bool)
    brk[place[cut.field(2).to_numpy(zero_copy_only=False).astype(bool)]] = True
    doc, at, path, brk = doc[good], at[good], path[good], brk[good]
    _, first = np.unique((doc << 32) | at, return_index=True)
    doc, at, path, brk = doc[first], at[first], path[first], brk[first]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (at[1:] != at[:-1] + 1) | brk[1:]
    order = np.lexsort((path, doc))
    d, p = doc[order], path[order]
    other = np.ones(len(d), bool)
    other[1:] = (d[1:] != d[:-1]) | (p[1:] != p[:-1])
    gone = np.zeros(len(words.start) + 1, np.int32)
    np.add.at(gone, words.first[doc] + at, 1)
    np.add.at(gone, words.first[doc] + at + WINDOW, -1)
    return words, np.cumsum(gone[:-1]) == 0, np.bincount(doc[new], minlength=n), np.bincount(d[other], minlength=n)


def _kept(raw: list[bytes], spans: pa.Array) -> Iterator[tuple[list[bytes], list[bytes], int, int]]:
    """(words, words that stay, spans, paths) of each text."""
    words, stay, n_spans, n_paths = _verified(raw, spans)
    for k, x in enumerate(raw):
        mine = x.split()
        keep = stay[words.first[k] : words.first[k + 1]].tolist()
        yield mine, [w for w, s in zip(mine, keep) if s] if n_spans[k] else mine, int(n_spans[k]), int(n_paths[k])


def repeats(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((doc_id, mark, spans) of the documents that have repeated windows, their ids)."""
    spans = common.durable(repeated_spans(docs))
    common.release(docs.sparkSession)
    return verified_by(docs, spans), spans.select("doc_id").distinct()


def without_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, mark, n_words, n_removed, n_spans, n_paths, kept_sha256, kept): kept holds the words that stay, null where all do.

    mark is the CRC-32 of the text.
    """
    spans, ids = repeats(docs)
    shared = docs.sparkSession.sparkContext.broadcast(_bloom(ids))

    def sift(part: pa.RecordBatch) -> np.ndarray:
        word, bit = _bloom_places(part.column(0).fill_null(0).to_numpy(), len(shared.value))
        return _usable(part) & ((shared.value[word.astype(np.int64)] & bit) == bit).all(0)

    def plain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Documents without repeats need no join."""
        for part in common.slices(batches, limit=SLICE):
            part = part.filter(pa.array(~sift(part)))
            raw = common.texts(part.column(1))
            words = [x.split() for x in raw]
            zero = np.zeros(len(raw), np.int64)
            sha = [hashlib.sha256(b" ".join(w)).hexdigest() for w in words]
            yield common.record(doc_id=part.column(0), mark=pa.array([zlib.crc32(x) for x in raw], pa.int64()), n_words=pa.array([len(w) for w in words], pa.int64()), n_removed=zero, n_spans=zero, n_paths=zero, kept_sha256=pa.array(sha, pa.string()), kept=pa.nulls(len(raw), pa.string()))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in common.slices(batches, limit=SLICE):
            part = part.filter(pa.array(sift(part)))
            raw = common.texts(part.column(1))
            yield common.record(doc_id=part.column(0), mark=pa.array([zlib.crc32(x) for x in raw], pa.int64()), raw=pa.array(raw, pa.binary()))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, 2, SLICE):
            out: list[list] = [[] for _ in range(6)]
            for words, stay, n, paths in _kept(common.texts(batch.column(2)), batch.column(3)):
                text = b" ".join(stay)
                for o, v in zip(out, (len(words), len(words) - len(stay), n, paths, hashlib.sha256(text).hexdigest(), text.decode() if n else None)):
                    o.append(v)
            kinds = (*[pa.int64()] * 4, pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(o, t) for o, t in zip(out, kinds))], ["doc_id", "mark", "n_words", "n_removed", "n_spans", "n_paths", "kept_sha256", "kept"])

    schema = "doc_id long, mark long, n_words long, n_removed long, n_spans long, n_paths long, kept_sha256 string, kept string"
    joined = common.map_arrow(_rows(docs), look, "doc_id long, mark long, raw binary").join(spans, ["doc_id", "mark"], "left").select("doc_id", "mark", "raw", "spans")
    return common.map_arrow(_rows(docs), plain, schema).unionByName(common.map_arrow(joined, cut, schema))


def digest(docs: DataFrame) -> DataFrame:
    return without_repeats(docs).select("doc_id", "n_words", "n_removed", "kept_sha256", "n_spans", "n_paths")


def cut_repeats(docs: DataFrame) -> DataFrame:
    """docs with the text of each row that loses words replaced by the words that stay, joined by one space.

    Rows of documents without repeats pass as they are; the others travel as one struct to the join with their spans.
    """
    spans, ids = repeats(docs)
    shared = docs.sparkSession.sparkContext.broadcast(_bloom(ids))
    whole = F.struct(*[docs[c] for c in docs.columns]).alias("row")

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                word, bit = _bloom_places(batch.column(0).fill_null(0).to_numpy(), len(shared.value))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array((~batch.column(0).is_null().to_numpy(zero_copy_only=False)) & ((shared.value[word.astype(np.int64)] & bit) == bit).all(0))], ["doc_id", "row", "maybe"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, 1, SLICE):
            texts = batch.column(1)
            new = [b" ".join(stay).decode() if n else None for _, stay, n, _ in _kept(common.texts(texts), batch.column(2))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([y if y is not None else x for x, y in zip(texts.to_pylist(), new)], pa.string())], ["row", "kept"])

    schema = docs.select(whole).schema["row"].dataType.simpleString()
    looked = common.map_arrow(docs.select(docs["doc_id"].cast("long").alias("doc_id"), whole), look, f"doc_id long, row {schema}, maybe boolean")
    rows = looked.where("maybe").withColumn("mark", F.crc32(F.col("row.text").cast("binary")))
    joined = rows.join(spans, ["doc_id", "mark"], "left").select("row", F.col("row.text").alias("text"), "spans")
    changed = common.map_arrow(joined, cut, f"row {schema}, kept string")
    out = changed.select(*[F.col("kept").alias(c) if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns])
    return looked.where("NOT maybe").select("row.*").unionByName(out)
