"""Packing token pieces into sequences: shortest pack first over the length histogram.

Each document is encoded, gets an end id, and is cut every ``size`` ids; the rest
is one shorter piece. Only the histogram of piece lengths (at most ``size``
numbers) reaches the driver. There lengths are placed longest first: each goes
to the packing patterns with the least content so far, whole counts at a time,
and new packs open only when even the shortest is too full. The plan maps, for
each length, ranges of ranks to (sequence, offset). Ranks come from counts per
(length, partition) and prefix sums, so a hot length is never one task's work.
Patterns are joined back by rank through a table whose size depends on ``size``
only.

Edge cases: null or empty text is the end id alone; null ids and repeated rows
are pieces of their own; equal lengths are ranked by partition, id and start;
texts are never truncated; an empty table gives an empty table; only the id and
text columns are read.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .pretoken import library_cache

SIZE = 2048
END = 1
SLICE = 1 << 20
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def pieces(docs: DataFrame, tokenizer: str, kind: str = "byte", size: int = SIZE, end: int = END) -> DataFrame:
    """One row a piece: which ids of which document, and their checksum."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = library_cache(tokenizer, kind)
        for part in common.slices(batches, limit=SLICE):
            ids, n = encode([x.decode() for x in common.texts(part.column(1))])
            raw = memoryview(np.insert(ids, np.cumsum(n), end).astype("<u4").tobytes())
            n = n + 1
            k = -(-n // size)
            doc = np.repeat(np.arange(len(n)), k)
            start = (np.arange(len(doc)) - np.repeat(np.cumsum(k) - k, k)) * size
            length = np.minimum(size, n[doc] - start)
            at = ((np.cumsum(n) - n)[doc] + start) * 4
            crc = [zlib.crc32(raw[a:b]) for a, b in zip(at.tolist(), (at + 4 * length).tolist())]
            yield common.record(doc_id=part.column(0).take(pa.array(doc)), start=start, length=length, ids_crc32=crc, doc_tokens=n[doc])

    return common.map_arrow(docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.col("text")), run, PIECE)


def shortest_pack_first(histogram: dict[int, int], size: int = SIZE) -> list[tuple[int, list[tuple[int, int]]]]:
    """Patterns (how many sequences, [(length, times), ...]) that hold exactly the pieces of the histogram."""
    open_packs: dict[int, list[tuple[int, list[tuple[int, int]]]]] = {}
    heap: list[int] = []

    def put(used: int, count: int, pattern: list[tuple[int, int]]) -> None:
        if count:
            if used not in open_packs:
                open_packs[used] = []
                heapq.heappush(heap, used)
            open_packs[used].append((count, pattern))

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            if not heap or heap[0] + length > size:  # even the shortest is too full
                times = size // length
                put(length * times, left // times, [(length, times)])
                put(length * (left % times), int(left % times > 0), [(length, left % times)])
                break
            used = heap[0]
            count, pattern = open_packs[used].pop()
            if not open_packs[used]:
                del open_packs[heapq.heappop(heap)]
            taken = min(count, left)
            put(used, count - taken, pattern)
            grown = [*pattern[:-1], (length, pattern[-1][1] + 1)] if pattern[-1][0] == length else [*pattern, (length, 1)]
            put(used + length, taken, grown)
            left -= taken
    return [p for used in sorted(open_packs, reverse=True) for p in open_packs[used]]


def plan(histogram: dict[int, int], size: int = SIZE) -> dict[str, np.ndarray]:
    """For each length, ranges of ranks: the first rank, times a pattern has it, first sequence and offset; sorted."""
    rows, next_rank, sequence = [], dict.fromkeys(histogram, 0), 0
    for count, pattern in shortest_pack_first(histogram, size):
        offset = 0
        for length, times in pattern:
            rows.append((length, next_rank[length], times, sequence, offset))
            next_rank[length] += count * times
            offset += length * times
        sequence += count
    rows.sort()
    return dict(zip(("length", "rank", "times", "sequence", "offset"), np.array(rows, np.int64).reshape(-1, 5).T))


def pack(rows: DataFrame, size: int = SIZE) -> DataFrame:
    """rows (with a length of 1 to size) and their sequence_id and offset."""
    rows = common.durable(rows).withColumn("part", F.spark_partition_id())
    counts = common.durable(rows.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n")))
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most size rows
    table = plan(histogram, size)
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    own = Window.partitionBy("length", "part").orderBy("doc_id", "start")
    ranked = rows.withColumn("own", F.row_number().over(own)).join(base, ["length", "part"])
    ranked = ranked.select(*[c for c in rows.columns if c != "part"], (F.col("base") + F.col("own") - 1).alias("rank"))
    key = table["length"] << 44 | table["rank"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", "rank"))
            i = np.searchsorted(key, length << 44 | rank, "right") - 1
            r = rank - table["rank"][i]
            where = {"sequence_id": table["sequence"][i] + r // table["times"][i], "offset": table["offset"][i] + r % table["times"][i] * length}
            names = [c for c in batch.schema.names if c != "rank"]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in names), *map(pa.array, where.values())], [*names, *where])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name != "part")
    return common.map_arrow(ranked, run, f"{schema}, sequence_id long, offset long")


def packed(docs: DataFrame, tokenizer: str, size: int = SIZE) -> DataFrame:
    return pack(pieces(docs, tokenizer, size=size), size)
