"""SimHash near-duplicates found with Gray-order hierarchical indexes.

Fingerprints: 64 bits, the majority of the XXH64 values (seed 42) of a text's
3-word shingles after A-Z are lower-cased; computed in numpy over flat byte
arrays, one pass for all texts of a slice.

Links at 2 or fewer differing bits, exactly: equal fingerprints are merged
first, so only distinct ones are searched. The 64 bits are four blocks; a pair
within 2 bits agrees on at least two whole blocks, so each fingerprint goes to
the six buckets named by two blocks. A bucket with more than ``HOT_BUCKET``
fingerprints is split once more by two of the four bytes that are left, which
leaves 16 free bits and so at most 65,536 distinct fingerprints, whatever the
data. Inside a bucket fingerprints are sorted by Gray rank; runs of eight are
factored into upper nodes that hold the bits on which all below agree. A search
goes down from the root, adds up the differences in the bits each node settles,
and drops a whole group once the sum exceeds 2. Where the bits still open under
a node cannot take the sum over 2, the whole group links at once. A bucket
emits a spanning forest of its links, never its pairs; components come from
Spark joins over those edges.

Edge cases: null text counts as empty; texts without words have fingerprint
zero and link like any other; null ids keep their fingerprint, link nothing and
have a null component; repeated rows share a fingerprint and component; rows of
one id with unlike texts are in components of their own; an
empty table gives an empty table; only the id and text columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .components import component_roots

BITS = 2
FAN = 8
HOT_BUCKET = 4096
#: Searches that go down together; bounds the memory of a step.
BLOCK = 2048
SLICE = 1 << 20
#: Shingles whose bits are counted at once; a longer text is counted alone.
SHINGLES = 1 << 14

# The XXH64 primes (fixed values of the hash).
P1, P2, P3, P4, P5 = (np.uint64(x) for x in (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def xxh64(buf: np.ndarray, start: np.ndarray, length: np.ndarray, seed: int = 42) -> np.ndarray:
    """XXH64 of many byte ranges of buf, which has at least 8 spare bytes at its end."""
    eight = np.ndarray((len(buf) - 7,), "<u8", buf.data, strides=(1,))
    four = np.ndarray((len(buf) - 3,), "<u4", buf.data, strides=(1,))
    seed64, at = np.uint64(seed), start.copy()
    h = np.full(len(start), seed64 + P5, np.uint64)
    long = np.flatnonzero(length >= 32)
    if len(long):
        with np.errstate(over="ignore"):
            v = [np.full(len(long), s, np.uint64) for s in (seed64 + P1 + P2, seed64 + P2, seed64, seed64 - P1)]
        stripes = length[long] >> 5
        for s in range(int(stripes.max())):
            go = np.flatnonzero(stripes > s)
            for i in range(4):
                v[i][go] = _rotl(v[i][go] + eight[at[long[go]] + 8 * i] * P2, 31) * P1
            at[long[go]] += 32
        acc = _rotl(v[0], 1) + _rotl(v[1], 7) + _rotl(v[2], 12) + _rotl(v[3], 18)
        for x in v:
            acc = (acc ^ (_rotl(x * P2, 31) * P1)) * P1 + P4
        h[long] = acc
    h += length.astype(np.uint64)
    left = length & 31
    for step in (8, 16, 24):
        go = np.flatnonzero(left >= step)
        if len(go):
            x = h[go] ^ (_rotl(eight[at[go]] * P2, 31) * P1)
            h[go] = _rotl(x, 27) * P1 + P4
            at[go] += 8
    left &= 7
    go = np.flatnonzero(left >= 4)
    x = h[go] ^ (four[at[go]].astype(np.uint64) * P1)
    h[go] = _rotl(x, 23) * P2 + P3
    at[go] += 4
    left &= 3
    for step in (1, 2, 3):
        go = np.flatnonzero(left >= step)
        h[go] = _rotl(h[go] ^ (buf[at[go]].astype(np.uint64) * P5), 11) * P1
        at[go] += 1
    h = (h ^ (h >> np.uint64(33))) * P2
    h = (h ^ (h >> np.uint64(29))) * P3
    return h ^ (h >> np.uint64(32))


def fingerprints(raw: list[bytes], size: int = 3) -> np.ndarray:
    """One unsigned 64-bit fingerprint a text."""
    w = common.Words(raw)
    out = np.zeros(len(raw), np.uint64)
    if not len(w.start):
        return out
    # The same words with single spaces between, so that a shingle is one byte range.
    lens = w.end - w.start
    to = np.cumsum(lens + 1) - lens - 1
    flat = np.full(int(lens.sum()) + len(lens) + 16, 32, np.uint8)
    shift = np.repeat(to - w.start, lens)
    src = np.flatnonzero(~common.SPACE[w.buf])
    flat[src + shift] = _LOWER[w.buf[src]]
    count = np.where(w.n >= size, w.n - size + 1, np.minimum(w.n, 1))
    who = np.repeat(np.arange(len(raw)), count)
    base = np.cumsum(count) - count
    i = w.first[:-1][who] + np.arange(len(who)) - base[who]
    j = np.minimum(i + size, w.first[1:][who]) - 1
    h = xxh64(flat, to[i], to[j] + lens[j] - to[i])
    has = np.flatnonzero(count)
    ends = (base + count)[has]
    at = 0
    while at < len(has):  # a shingle takes some 320 bytes as separate bits and their sums
        lo = base[has[at]]
        to = max(at + 1, int(np.searchsorted(ends, lo + SHINGLES, "right")))
        some = has[at:to]
        bits = np.unpackbits(h[lo : ends[to - 1]].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        sums = np.add.reduceat(bits, base[some] - lo, axis=0, dtype=np.int32)
        over = (2 * sums > count[some][:, None]).astype(np.uint8)
        out[some] = np.packbits(over, axis=1).view(">u8")[:, 0]
        at = to
    return out


def fingerprint_column(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", marks: tuple[Column, ...] = ()) -> DataFrame:
    """(doc_id, fp, mark0, mark1, ...): fp holds the 64 bits as a signed long; marks are long columns that travel along."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in common.slices(batches, limit=SLICE):
            more = {f"mark{k}": part.column(2 + k) for k in range(part.num_columns - 2)}
            yield common.record(doc_id=part.column(0), fp=fingerprints(common.texts(part.column(1))).view(np.int64), **more)

    names = [f"mark{k}" for k in range(len(marks))]
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"), *[m.alias(n) for m, n in zip(marks, names)])
    return common.map_arrow(rows, run, ", ".join(["doc_id long, fp long", *[f"{n} long" for n in names]]))


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """The place of each 64-bit code in the reflected Gray sequence: a prefix XOR from the top."""
    out = codes.copy()
    for s in (1, 2, 4, 8, 16, 32):
        out ^= out >> np.uint64(s)
    return out


class GrayIndex:
    """Hierarchical indexes over several groups of distinct codes, searched together.

    codes are ordered by group and Gray rank. levels[0] are the codes; each level
    above has a node for every FAN nodes of one group, with the mask of the bits on
    which all its codes agree and their pattern; levels end when each group has one.
    """

    def __init__(self, group: np.ndarray, codes: np.ndarray):
        self.order = np.lexsort((gray_rank(codes), group))
        g = group[self.order]
        both, either = codes[self.order], codes[self.order]
        self.levels = []
        while True:
            first = np.flatnonzero(np.append(True, g[1:] != g[:-1]))
            size = np.diff(np.append(first, len(g)))
            level = {"mask": ~(both ^ either), "pattern": both}
            self.levels.append(level)
            if size.max() == 1:
                self.groups = g
                break
            inside = np.arange(len(g)) - np.repeat(first, size)
            cut = np.flatnonzero(inside % FAN == 0)
            level["up"] = {"first": cut, "n": np.diff(np.append(cut, len(g)))}
            both, either, g = np.bitwise_and.reduceat(both, cut), np.bitwise_or.reduceat(either, cut), g[cut]

    def links(self, group: np.ndarray, codes: np.ndarray, bits: int = BITS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (query number, a place in ``order``) that link, by blocks of queries; of a group that links whole, its first."""
        root = np.searchsorted(self.groups, group)
        for at in range(0, len(codes), BLOCK):
            q = np.arange(at, min(at + BLOCK, len(codes)))
            node, depth = root[q], len(self.levels) - 1
            top = self.levels[depth]
            acc = np.bitwise_count((codes[q] ^ top["pattern"][node]) & top["mask"][node]).astype(np.int16)
            while True:
                level = self.levels[depth]
                keep = acc <= bits
                q, node, acc = q[keep], node[keep], acc[keep]
                if depth == 0 or not len(q):
                    if len(q):
                        yield q, node
                    break
                open_bits = np.bitwise_count(~level["mask"][node])
                whole = acc + open_bits <= bits
                below = self.levels[depth - 1]
                up = below["up"]
                if whole.any():
                    first = node[whole]
                    for d in range(depth - 1, -1, -1):
                        first = self.levels[d]["up"]["first"][first]
                    yield q[whole], first
                    q, node, acc = q[~whole], node[~whole], acc[~whole]
                n = up["n"][node]
                mask = np.repeat(level["mask"][node], n)
                child = np.repeat(up["first"][node] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
                q, acc = np.repeat(q, n), np.repeat(acc, n)
                acc = acc + np.bitwise_count((codes[q] ^ below["pattern"][child]) & below["mask"][child] & ~mask)
                node, depth = child, depth - 1


def _merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels (each the least of its set) after the sets of a and b are joined."""
    while True:
        x, y = label[a], label[b]
        differ = x != y
        if not differ.any():
            return label
        a, b = a[differ], b[differ]
        np.minimum.at(label, np.maximum(x, y)[differ], np.minimum(x, y)[differ])
        while True:
            down = label[label]
            if (down == label).all():
                break
            label = down


def forest(group: np.ndarray, codes: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Edges (places in the input) of a spanning forest of the links inside each group."""
    index = GrayIndex(group, codes)
    g, c = group[index.order], codes[index.order]
    label = np.arange(len(c))
    for level in range(1, len(index.levels)):  # groups whose open bits are few link whole
        up, nodes = index.levels[level - 1]["up"], index.levels[level]
        tight = np.flatnonzero(np.bitwise_count(~nodes["mask"]) <= bits)
        lo, n = up["first"][tight], up["n"][tight]
        child = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        head = np.repeat(lo, n)
        for d in range(level - 2, -1, -1):
            child, head = index.levels[d]["up"]["first"][child], index.levels[d]["up"]["first"][head]
        label = _merge(label, child, head)
    for q, place in index.links(g, c, bits):
        label = _merge(label, q, place)
    far = np.flatnonzero(label != np.arange(len(label)))
    return index.order[far], index.order[label[far]]


def _bits(x: Column, lo: int, width: int) -> Column:
    return F.shiftrightunsigned(x, lo).bitwiseAND(F.lit((1 << width) - 1).cast("long"))


def _buckets(x: Column, lo: list[int], width: int) -> Column:
    """An array of one number for each two of the blocks that begin at bits lo: the pair and both blocks."""
    return F.array(*[F.lit(k << (2 * width)).cast("long") + F.shiftleft(_bits(x, a, width), width) + _bits(x, b, width) for k, (a, b) in enumerate(combinations(lo, 2))])


def linked(codes: DataFrame, bits: int = BITS, hot: int = HOT_BUCKET) -> DataFrame:
    """(u, v): spanning edges of the links between the distinct codes of (node long, fp long)."""
    spark = codes.sparkSession
    keyed = codes.select("node", "fp", F.explode(_buckets(F.col("fp"), [0, 16, 32, 48], 16)).alias("key"))
    large = common.durable(keyed.groupBy("key").count().where(F.col("count") > hot).select("key"))
    if not large.isEmpty():
        blocks = list(combinations([0, 16, 32, 48], 2))
        rest = [[x + h for x in (0, 16, 32, 48) if x not in pair for h in (0, 8)] for pair in blocks]
        finer = reduce(lambda other, k: F.when(F.shiftright("key", 32) == k, _buckets(F.col("fp"), rest[k], 8)).otherwise(other), range(5), _buckets(F.col("fp"), rest[5], 8))
        split = keyed.join(large, "key").select("node", "fp", "key", F.explode(finer).alias("fine"))
        keyed = keyed.join(large, "key", "left_anti").select("node", "fp", F.xxhash64("key").alias("key")).unionByName(split.select("node", "fp", F.xxhash64("key", "fine").alias("key")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def done(rows: pa.Table) -> pa.RecordBatch:
            key, node, fp = (rows.column(i).to_numpy() for i in range(3))
            _, group, size = np.unique(key, return_inverse=True, return_counts=True)
            many = np.flatnonzero(size[group] > 1)
            a = b = np.zeros(0, np.int64)
            if len(many):
                x, y = forest(group[many], fp[many].view(np.uint64), bits)
                a, b = node[many][x], node[many][y]
            return common.record(u=pa.array(a, pa.int64()), v=pa.array(b, pa.int64()))

        for batch in batches:  # sorted by key: all but the last key of a batch are whole
            if not batch.num_rows:
                continue
            key = batch.column(0).to_numpy()
            cut = int(np.searchsorted(key, key[-1]))
            if cut or (held and held[-1].column(0)[-1].as_py() != key[-1]):
                yield done(pa.Table.from_batches([*held, batch.slice(0, cut)]))
                held = []
            held.append(batch.slice(cut))
        if held:
            yield done(pa.Table.from_batches(held))

    dealt = keyed.select("key", "node", "fp").repartition(common.parts(spark), "key").sortWithinPartitions("key")
    return common.map_arrow(dealt, run, "u long, v long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = BITS, marks: tuple[Column, ...] = ()) -> DataFrame:
    """(doc_id, fp, marks, root, component_id) for every row of docs; the nodes of the graph are fingerprints, never ids.

    root names the component by a fingerprint: unlike components can share their least id.
    """
    rows = common.durable(fingerprint_column(docs, id_col, text_col, marks))
    classes = rows.where("doc_id IS NOT NULL").groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = component_roots(linked(classes.select(F.col("fp").alias("node"), "fp"), bits))
    rooted = classes.join(roots, classes["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    found = rooted.join(named, "root").select("fp", "root", "component_id")
    return rows.join(found, "fp", "left").select("doc_id", "fp", *[c for c in rows.columns if c.startswith("mark")], "root", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def digest(docs: DataFrame) -> DataFrame:
    found = near_duplicates(docs)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of docs for each component; rows with a null id stay.

    It is the row with the least id; of rows that share that id the one with the
    least fingerprint, then the least hash of the text, then of the other columns.
    Rows of one id whose texts lie in different components are kept one by one, so
    no text goes without a near copy that stays. Of wholly equal rows one stays.
    """
    taken = [common.fresh(docs, f"kept_{c}") for c in ("id", "text", "rest")]
    rest = [docs[c] for c in docs.columns if c not in (id_col, text_col)]
    keys = (docs[id_col].cast("long"), F.xxhash64(docs[text_col]), F.xxhash64(F.to_json(F.struct(*rest))) if rest else F.lit(0).cast("long"))
    found = common.durable(near_duplicates(docs, id_col, text_col, marks=keys[1:]).where("doc_id IS NOT NULL"))
    best = found.groupBy("root").agg(F.min(F.struct("doc_id", "fp", "mark0", "mark1")).alias("b"))
    best = best.select(*[F.col(f"b.{c}").alias(t) for c, t in zip(("doc_id", "mark0", "mark1"), taken)])
    out = docs.join(best, reduce(lambda a, b: a & b, [k == F.col(t) for k, t in zip(keys, taken)]), "left_semi")
    same = found.join(best, reduce(lambda a, b: a & b, [F.col(c) == F.col(t) for c, t in zip(("doc_id", "mark0", "mark1"), taken)]), "left_semi").count()
    if same != found.select("root").distinct().count():
        out = out.withColumns(dict(zip(taken, keys))).dropDuplicates(taken).drop(*taken)
    return out.unionByName(docs.where(docs[id_col].isNull()))
