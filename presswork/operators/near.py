"""All pairs of 64-bit fingerprints within a few bits, in groups of bounded size.

The 64 bits are cut into ``2 * bits`` blocks; a pair within ``bits`` bits agrees
on at least ``bits`` whole blocks, so each code goes to one bucket for every choice
of ``bits`` blocks. A bucket with more than ``HOT`` codes is split once more in
the same way: the blocks left free are halved and ``bits`` of the halves chosen.
For 3 bits that leaves at most 18 free bits, whatever the data. Only codes of one bucket
meet, and a pair is given in the first bucket that holds it, so none comes twice.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Codes of a bucket that meet as they are; a larger bucket is split.
HOT = 1024
Piece = tuple[int, int]


def _mask(pieces: tuple[Piece, ...]) -> int:
    return sum(((1 << width) - 1) << lo for lo, width in pieces)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def masks(bits: int) -> list[list[int]]:
    """A list for each choice of blocks: its mask, then the masks of its finer buckets."""
    cut = [64 * i // (2 * bits) for i in range(2 * bits + 1)]
    blocks = [(lo, hi - lo) for lo, hi in zip(cut, cut[1:])]
    out = []
    for chosen in combinations(blocks, bits):
        halves = [p for lo, w in blocks if (lo, w) not in chosen for p in ((lo, w // 2), (lo + w // 2, w - w // 2))]
        out.append([_mask(chosen), *(_mask(chosen) | _mask(x) for x in combinations(halves, bits))])
    return out


def _meet(kind: np.ndarray, key: np.ndarray, code: np.ndarray, bits: int, levels: list[list[int]]) -> pa.RecordBatch:
    """Pairs of the whole buckets in these rows, sorted by kind, key and code."""
    fine = len(levels[0])
    last = np.append((kind[1:] != kind[:-1]) | (key[1:] != key[:-1]), True)
    end = np.flatnonzero(last)[np.cumsum(last) - last]
    found, step, at = [], 1, np.flatnonzero(~last)
    while len(at):
        x = code[at] ^ code[at + step]
        near = np.bitwise_count(x.view(np.uint64)) <= bits
        found.append((at[near], at[near] + step))
        step += 1
        at = at[at + step <= end[at]]
    a, b = (np.concatenate([np.zeros(0, np.int64), *(x[i] for x in found)]) for i in (0, 1))
    x, k = (code[a] ^ code[b]).view(np.uint64), kind[a]
    first = np.ones(len(a), bool)
    for v in np.unique(k):  # a pair that an earlier bucket holds too is given there
        i, j = divmod(int(v), fine)
        rows = np.flatnonzero(k == v)
        for mask in [m[0] for m in levels[:i]] + levels[i][1:j]:
            first[rows] &= (x[rows] & np.uint64(mask)) != 0
    a, b, x = a[first], b[first], x[first]
    return pa.RecordBatch.from_arrays([pa.array(code[a]), pa.array(code[b]), pa.array(np.bitwise_count(x).astype(np.int32))], ["a", "b", "distance"])


def near_pairs(codes: DataFrame, bits: int = 3, hot: int = HOT) -> DataFrame:
    """(a, b, distance) of distinct fingerprints (column simhash) within ``bits`` bits, a < b."""
    distinct = codes.select(F.col("simhash").cast("long").alias("code")).where("code IS NOT NULL").distinct()
    if bits < 1:
        return distinct.select("code", F.col("code").alias("b"), F.lit(0).alias("distance")).toDF("a", "b", "distance").limit(0)
    levels = masks(bits)
    fine = len(levels[0])

    def bucket(kind: int, mask: int):
        return F.struct(F.lit(kind).alias("kind"), F.col("code").bitwiseAND(F.lit(_signed(mask)).cast("long")).alias("key"))

    def keyed(rows: DataFrame, *buckets) -> DataFrame:
        return rows.select("code", F.explode(F.array(*buckets)).alias("at")).select("at.kind", "at.key", "code")

    coarse = keyed(distinct, *(bucket(i * fine, m[0]) for i, m in enumerate(levels)))
    large = coarse.groupBy("kind", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot).drop("n")
    split = coarse.join(large, ["kind", "key"], "left_semi")
    by_kind = F.create_map(*[x for i, m in enumerate(levels) for x in (F.lit(i * fine), F.array(*(F.lit(_signed(v)).cast("long") for v in m[1:])))])
    split = split.select("kind", "code", F.posexplode(by_kind[F.col("kind")]).alias("j", "mask"))
    split = split.select((F.col("kind") + F.col("j") + 1).alias("kind"), F.col("code").bitwiseAND(F.col("mask")).alias("key"), "code")
    rows = coarse.join(large, ["kind", "key"], "left_anti").unionByName(split)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []

        def done() -> pa.RecordBatch:
            return _meet(*(np.concatenate(x) for x in zip(*held)), bits, levels)

        for batch in batches:  # sorted by bucket: all but the last bucket of a batch are whole
            if not batch.num_rows:
                continue
            kind, key, code = (batch.column(i).to_numpy() for i in range(3))
            new = np.flatnonzero((kind != kind[-1]) | (key != key[-1]))
            cut = int(new[-1]) + 1 if len(new) else 0
            if cut or (held and (held[-1][0][-1] != kind[-1] or held[-1][1][-1] != key[-1])):
                held.append([kind[:cut], key[:cut], code[:cut]])
                yield done()
                held = []
            held.append([kind[cut:], key[cut:], code[cut:]])
        if held:
            yield done()

    return rows.repartition("kind", "key").sortWithinPartitions("kind", "key", "code").mapInArrow(run, "a long, b long, distance int")
