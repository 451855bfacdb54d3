"""Token-id files: flat unsigned integers, 64-bit document offsets, memory-mapped reading.

Layout of one folder: ``ids-NNNNN.bin`` holds the ids of a range of documents in
ascending id order, little-endian and flat; ``ids-NNNNN.idx`` holds a header, the
local end offset of each document (int64), its id (int64) and a null mark
(uint8). The width is two bytes where the largest id of the vocabulary and the end
id allow it, else four; an id that does not fit is an error, never cut.
Documents are range-partitioned by id (ties by a hash of the text, so that one
id cannot fill a task), each task encodes and writes its range under a name of
its own and renames it, so repeated attempts leave one whole file. Each file's
first token position is the prefix sum of the sizes before it.

Memory mapping needs a mounted folder: a plain path or file:// URI that driver and
executors share.

Edge cases: null text is an empty document (the end id alone); null ids sort
first; repeated rows are separate documents; long texts are whole; an empty
table writes no files and gives an empty table; only id and text are read.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .pretoken import largest_id, library_cache

MAGIC = b"PWTOKEN1"
END = 1
SLICE = 1 << 20


class Writer:
    """Writes one range of documents; ids go to the file as they come."""

    def __init__(self, folder: str, number: int, width: int):
        self.path = common.local_path(folder)
        if self.path is None:
            raise ValueError(f"token files need a mounted folder, not {folder}")
        os.makedirs(self.path, exist_ok=True)
        self.name, self.width = f"ids-{number:05d}", width
        self.temp = f"{self.path}/.{self.name}.{uuid.uuid4().hex}"
        self.out = open(self.temp, "wb")
        self.ends, self.docs, self.null, self.at = [], [], [], 0

    def add(self, ids: np.ndarray, sizes: np.ndarray, docs: np.ndarray, null: np.ndarray) -> None:
        if len(ids) and int(ids.max()) >> (8 * self.width):
            raise ValueError(f"id {int(ids.max())} does not fit in {self.width} bytes")
        self.out.write(ids.astype("<u2" if self.width == 2 else "<u4").tobytes())
        self.ends.append(self.at + np.cumsum(sizes))
        self.docs.append(docs)
        self.null.append(null)
        self.at += int(sizes.sum())

    def close(self) -> tuple[str, int, int]:
        """The name, and how many documents and tokens the file has."""
        self.out.close()
        ends, docs, null = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (self.ends, self.docs, self.null))
        mine = f"{self.temp}.idx"
        with open(mine, "wb") as f:
            f.write(MAGIC + struct.pack("<IIqq", self.width, 0, len(ends), self.at))
            f.write(ends.astype("<i8").tobytes() + docs.astype("<i8").tobytes() + null.astype(np.uint8).tobytes())
        os.replace(self.temp, f"{self.path}/{self.name}.bin")
        os.replace(mine, f"{self.path}/{self.name}.idx")
        return self.name, len(ends), self.at


class Reader:
    """A memory-mapped file: ``ids`` (flat), ``ends``, ``docs``, ``null``."""

    def __init__(self, path: str):
        with open(f"{path}.idx", "rb") as f:
            if f.read(8) != MAGIC:
                raise ValueError(f"not a token file: {path}")
            width, _, n, total = struct.unpack("<IIqq", f.read(24))
        at = 32
        self.ends = np.memmap(f"{path}.idx", "<i8", "r", at, (n,)) if n else np.zeros(0, np.int64)
        self.docs = np.memmap(f"{path}.idx", "<i8", "r", at + 8 * n, (n,)) if n else np.zeros(0, np.int64)
        self.null = np.memmap(f"{path}.idx", np.uint8, "r", at + 16 * n, (n,)) if n else np.zeros(0, np.uint8)
        self.ids = np.memmap(f"{path}.bin", "<u2" if width == 2 else "<u4", "r", 0, (total,)) if total else np.zeros(0, np.uint32)

    def document(self, k: int) -> np.ndarray:
        return self.ids[int(self.ends[k - 1]) if k else 0 : int(self.ends[k])]


def width_of(largest: int) -> int:
    """Bytes an id, by the largest one."""
    return 2 if largest < 1 << 16 else 4


def write(docs: DataFrame, folder: str, tokenizer: str, kind: str = "word", width: int | None = None, end: int = END) -> DataFrame:
    """Writes the files; (name, first_doc, start, n_docs, n_tokens) per file, in order. The table has one row a file.

    width: bytes an id; by default as the vocabulary needs.
    """
    spark = docs.sparkSession
    width = width or width_of(max(end, largest_id(tokenizer)))
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.col("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    ranged = rows.repartitionByRange(common.parts(spark), *order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, out, number = library_cache(tokenizer, kind), None, TaskContext.get().partitionId()
        for part in common.slices(batches, limit=SLICE):
            out = out or Writer(folder, number, width)
            ids, n = encode([x.decode() for x in common.texts(part.column(1))])  # uint32
            null = part.column(0).is_null().to_numpy(zero_copy_only=False)
            whole = np.insert(ids, np.cumsum(n), end)
            out.add(whole, n + 1, part.column(0).fill_null(0).to_numpy(), null)
        if out:
            name, n_docs, n_tokens = out.close()
            yield common.record(number=[number], name=[name], n_docs=[n_docs], n_tokens=[n_tokens])

    files = common.map_arrow(ranged, run, "number long, name string, n_docs long, n_tokens long").collect()  # one row a file
    files.sort(key=lambda r: r.number)
    table, doc, at = [], 0, 0
    for r in files:
        table.append((r.name, doc, at, r.n_docs, r.n_tokens))
        doc, at = doc + r.n_docs, at + r.n_tokens
    return spark.createDataFrame(table, "name string, first_doc long, start long, n_docs long, n_tokens long")


def read(spark: SparkSession, folder: str, files: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, read back from the mapped files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                r = Reader(f"{common.local_path(folder)}/{name}")
                for lo in range(0, len(r.ends), 4096):
                    ks = range(lo, min(lo + 4096, len(r.ends)))
                    docs = [r.document(k) for k in ks]
                    yield common.record(
                        doc_id=pa.array(r.docs[lo : lo + 4096], pa.int64(), mask=np.asarray(r.null[lo : lo + 4096], bool)),
                        start=[base + int(r.ends[k]) - len(d) for k, d in zip(ks, docs)], n_tokens=[len(d) for d in docs],
                        ids_crc32=[zlib.crc32(d.astype("<u4").tobytes()) for d in docs],
                    )

    dealt = files.select("name", "start").repartition(max(1, min(common.parts(spark), files.count())))
    return common.map_arrow(dealt, run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def digest(docs: DataFrame, tokenizer: str) -> DataFrame:
    spark = docs.sparkSession
    folder = common.scratch(spark, "tokens")
    return read(spark, folder, write(docs, folder, tokenizer))
