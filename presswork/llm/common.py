"""Shared helpers: table access, durable checkpoints, and flat views of text batches.

Python operators work on Arrow batches cut into slices of a few MB of text, so
memory follows the slice (or the one longest document), never the partition.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one numpy pass handles; a longer document is handled alone.
SLICE_BYTES = 2 << 20

#: The six ASCII white-space bytes that end a word.
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own only in local mode, where none is set."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="presswork-")
        spark.conf.set("spark.checkpoint.dir", found)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(found)
    return found


def scratch(spark: SparkSession, kind: str) -> str:
    """A new folder name below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder that ``scratch`` named, once nothing reads it any more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def durable(df: DataFrame) -> DataFrame:
    """Cuts the lineage with a replicated-by-storage checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame, kind: str) -> DataFrame:
    """Cuts the lineage with a Parquet table in the shared folder, for results that are read by column or kind."""
    path = scratch(df.sparkSession, kind)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Ids that are broadcast at most (8 bytes each, some 64 as a hash table).
BROADCAST_IDS = 1_000_000


def sized(ids: DataFrame) -> DataFrame:
    """A frame of distinct ids, to be broadcast if it is counted to be small; else Spark shuffles both sides."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def release(spark: SparkSession) -> None:
    """Lets Spark's cleaner drop the shuffle files of frames that nothing refers to any more."""
    gc.collect()
    spark._jvm.System.gc()


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have yet."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def slices(batches: Iterator[pa.RecordBatch], column: int = 1, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts batches so that ``column`` holds about ``limit`` bytes in each slice."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < n:
            before = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + limit, "right")))
            yield batch.slice(at, to - at)
            at = to


def as_bytes(array: pa.Array) -> list[bytes | None]:
    return array.cast(pa.large_binary()).to_pylist() if not pa.types.is_binary(array.type) else array.to_pylist()


def texts(array: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; null counts as empty."""
    return [x or b"" for x in as_bytes(array)]


class Words:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a list of UTF-8 texts as flat arrays.

    buf: all texts, each followed by one space; start, end: byte range of each
    word; doc: its text's number; first: for each text the number of its first
    word, with one more entry at the end.
    """

    def __init__(self, raw: list[bytes]):
        self.buf = np.frombuffer(b" ".join(raw) + b" ", np.uint8)
        lens = np.fromiter(map(len, raw), np.int64, len(raw))
        self.doc_end = np.cumsum(lens + 1)
        self.doc_start = self.doc_end - lens - 1
        space = SPACE[self.buf]
        edge = np.flatnonzero(space[1:] != space[:-1]) + 1
        if len(space) and not space[0]:
            edge = np.concatenate(([0], edge))
        self.start, self.end = edge[0::2], edge[1::2]
        self.first = np.searchsorted(self.start, np.append(self.doc_start, len(self.buf)))
        self.n = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(raw)), self.n)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finisher on unsigned 64-bit values (the SplitMix64 steps)."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_ODD = np.uint64(0xD6E8FEB86659FD93)


_BYTE_2 = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
_ODD_2 = np.uint64(0xA0761D6478BD642F)


#: Bytes that are hashed at once by prefix sums; a longer word goes in blocks.
PREFIX_BYTES = 1 << 18
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(odd: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd number and of its inverse, modulo 2^64; kept for the next call."""
    known = _POWERS.get(int(odd))
    if known is None or len(known[0]) < n:
        size = 1 << max(n - 1, 1).bit_length()
        known = tuple(np.append(np.uint64(1), np.multiply.accumulate(np.full(size - 1, x, np.uint64))) for x in (odd, np.uint64(pow(int(odd), -1, 1 << 64))))
        _POWERS[int(odd)] = known
    return known


def word_hashes(w: Words, second: bool = False) -> np.ndarray:
    """A 64-bit hash of each word's bytes, by a polynomial over random byte values; ``second`` is an independent one."""
    byte, odd = (_BYTE_2, _ODD_2) if second else (_BYTE, _ODD)
    lens = w.end - w.start
    out = np.empty(len(lens), np.uint64)
    block = max(PREFIX_BYTES, 64)
    power, back = _powers(odd, block)
    at = 0
    while at < len(out):
        lo = int(w.start[at])
        to = int(np.searchsorted(w.end, lo + PREFIX_BYTES, "right"))
        if to > at:
            upto = byte[w.buf[lo : w.end[to - 1]]]
            upto *= power[: len(upto)]
            np.cumsum(upto, out=upto)
            start = w.start[at:to] - lo
            out[at:to] = (upto[w.end[at:to] - lo - 1] - np.where(start > 0, upto[start - 1], np.uint64(0))) * back[start]
        else:
            sums = ((k, byte[w.buf[lo + k : min(lo + k + block, w.end[at])]]) for k in range(0, int(lens[at]), block))
            out[at] = sum(pow(int(odd), k, 1 << 64) * int((x * power[: len(x)]).sum(dtype=np.uint64)) for k, x in sums) & (1 << 64) - 1
            to = at + 1
        at = to
    return mix(out + lens.astype(np.uint64))


def give_back() -> None:
    """Returns the memory that the last task freed to the system; workers stay beside the executor's heap, also while stages run that do not use them."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # glibc only
        ctypes.CDLL(None).malloc_trim(0)


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from fn(batches)
        give_back()

    return df.mapInArrow(run, schema)


def record(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c) for c in columns.values()], list(columns))


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column), F.lit(""))


def local_path(uri: str) -> str | None:
    """The path of a file:// URI or plain path, else None."""
    if uri.startswith("file:"):
        return "/" + uri[5:].lstrip("/")
    return uri if uri.startswith("/") else None


def make_dirs(path: str) -> None:
    os.makedirs(path, exist_ok=True)
