"""Request limits: a fixed window anchored at a key's first accepted request.

A window starts with the first request after the last one ended; within it up to
``limit`` requests pass and the rest are refused with the seconds left, and are
not counted. That is a sequential fold, so it runs as one pass over rows sorted
by key and time, with one (start, count) pair of state: memory does not grow with
a key's requests. Within a batch it goes from window to window by binary search
over a key's sorted times, so its steps follow the windows, not the requests.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_KEYS = 10_000


class Window:
    """The state of one key; times in microseconds."""

    def __init__(self, limit: int, seconds: float):
        self.limit, self.size = limit, round(seconds * 1e6)
        self.start: int | None = None
        self.count = 0

    def check(self, now: int) -> tuple[bool, int]:
        """(allowed, seconds to wait)."""
        if self.start is None or now - self.start >= self.size:
            self.start, self.count = now, 0
        if self.count < self.limit:
            self.count += 1
            return True, 0
        return False, max(1, math.ceil((self.start + self.size - now) / 1e6))


def decisions(requests: DataFrame, limit: int, seconds: float, keys: tuple[str, ...] = ("consumer",)) -> DataFrame:
    """requests (key columns, ts, request_id) with allowed and retry_after. Ties in time go by request_id."""
    cols = [F.col(k).cast("string").alias(k) for k in keys]
    rows = requests.select(*cols, F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), F.col("request_id").cast("long").alias("request_id"))

    size = round(seconds * 1e6)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, start, count = None, None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            names = [batch.column(k) for k in range(len(keys))]
            at = batch.column(len(keys)).to_numpy()
            allowed, wait = np.zeros(len(at), bool), np.zeros(len(at), np.int64)
            new = np.zeros(len(at), bool)
            for c in names:
                code = c.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
                new[1:] |= code[1:] != code[:-1]
            for a, b in zip(first := [0, *np.flatnonzero(new).tolist()], [*first[1:], len(at)]):
                mine = tuple(c[a].as_py() for c in names)
                if mine != key:
                    key, start, count = mine, None, 0
                while a < b:
                    if start is None or at[a] - start >= size:
                        start, count = int(at[a]), 0
                    end = a + int(np.searchsorted(at[a:b], start + size))
                    free = min(limit - count, end - a)
                    allowed[a : a + free] = True
                    count += free
                    wait[a + free : end] = np.maximum(1, -((at[a + free : end] - start - size) // 1_000_000))
                    a = end
            yield pa.RecordBatch.from_arrays([*names, batch.column(len(keys) + 1), pa.array(allowed), pa.array(wait)], [*keys, "request_id", "allowed", "retry_after"])

    dealt = rows.repartition(*[F.col(k) for k in keys]).sortWithinPartitions(*keys, "at", "request_id")
    return dealt.mapInArrow(run, ", ".join(f"{k} string" for k in keys) + ", request_id long, allowed boolean, retry_after long")


class Limiter:
    """Windows of many keys with the bound on keys: the window that started first goes first."""

    def __init__(self, limit: int, seconds: float, max_keys: int = MAX_KEYS):
        self.limit, self.seconds, self.max_keys = limit, seconds, max_keys
        self.windows: dict[str, Window] = {}
        self.swept: int | None = None

    def check(self, key: str, now: int) -> tuple[bool, int]:
        size = round(self.seconds * 1e6)
        if self.swept is None or now - self.swept >= size:
            self.windows = {k: w for k, w in self.windows.items() if w.start is not None and now - w.start < size}
            self.swept = now
        if key not in self.windows and len(self.windows) >= self.max_keys:
            del self.windows[min(self.windows, key=lambda k: self.windows[k].start)]
        return self.windows.setdefault(key, Window(self.limit, self.seconds)).check(now)
