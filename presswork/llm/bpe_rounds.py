"""BPE encoding and decoding by batched merge rounds in numpy.

The symbols of many words lie in one flat array. Each round looks up all
neighbouring pairs by binary search in the sorted pair keys, takes the lowest
rank of every word with a segmented minimum, merges all its occurrences from the
left, and packs the array; words without a pair leave it. The vocabulary file is
a parameter; nothing is trained.

``encode_column`` gives (doc_id, ids array), ``decode_column`` the text a
tokenizer without decoder gives: token strings joined by single spaces.

Edge cases: null text counts as empty and has no ids; special token strings in a
text are their ids, as in the library; texts of any length are encoded whole;
repeated rows and null ids pass through; an empty table gives an empty table;
only the id and text columns are read.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .pretoken import PieceCache, byte_letters

_NONE = np.int64(1 << 40)
SLICE = 1 << 20


class RoundsBpe:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.size = max([*vocab.values(), *self.special.values()]) + 1
        self.tokens = np.empty(self.size, object)
        for t, i in (vocab | self.special).items():
            self.tokens[i] = t
        suffix = model["end_of_word_suffix"] or ""
        letters = byte_letters()
        self.inner = np.array([vocab[c] for c in letters], np.int64)
        self.last = np.array([vocab[c + suffix] for c in letters], np.int64)
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        left, right, made = (np.array([vocab[x] for x in c], np.int64) for c in ([a for a, _ in merges], [b for _, b in merges], [a + b for a, b in merges]))
        keys = left * self.size + right
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank, self.made = keys[order], order.astype(np.int64), made[order]

    def words(self, words: list[str]) -> list[list[int]]:
        """Ids of many words (none empty), merged together round by round."""
        raw = [w.encode() for w in words]
        n = np.fromiter(map(len, raw), np.int64, len(raw))
        data = np.frombuffer(b"".join(raw), np.uint8)
        sym = self.inner[data]
        ends = np.cumsum(n)
        sym[ends - 1] = self.last[data[ends - 1]]
        word = np.repeat(np.arange(len(n)), n)
        done_sym, done_word = [], []
        while len(sym):
            key = sym[:-1] * self.size + sym[1:]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = (self.keys[at] == key) & (word[:-1] == word[1:])
            rank = np.append(np.where(hit, self.rank[at], _NONE), _NONE)
            first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            least = np.minimum.reduceat(rank, first)
            count = np.diff(np.append(first, len(sym)))
            low = np.repeat(least, count)
            live = low < _NONE
            if not live.all():
                done_sym.append(sym[~live])
                done_word.append(word[~live])
            pick = np.flatnonzero(live & (rank == low))
            if not len(pick):
                break
            # In a run of overlapping occurrences every other one merges, from the left.
            fresh = np.append(True, np.diff(pick) != 1)
            start = np.flatnonzero(fresh)
            place = np.arange(len(pick)) - np.repeat(start, np.diff(np.append(start, len(pick))))
            pick = pick[place % 2 == 0]
            sym[pick] = self.made[at[pick]]
            live[pick + 1] = False
            sym, word = sym[live], word[live]
        if not done_sym:
            return [[] for _ in words]
        sym, word = np.concatenate(done_sym), np.concatenate(done_word)
        order = np.argsort(word, kind="stable")
        ids, cut = sym[order].tolist(), np.cumsum(np.bincount(word, minlength=len(n))).tolist()
        return [ids[a:b] for a, b in zip([0, *cut], cut)]

    def decode(self, ids: np.ndarray) -> str:
        return " ".join(self.tokens[ids].tolist())


@lru_cache(maxsize=4)
def load(path: str) -> tuple[RoundsBpe, PieceCache]:
    """One model and one bounded cache of words a worker process."""
    bpe = RoundsBpe(path)
    return bpe, PieceCache("word", bpe.words, bpe.special)


def encode_column(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids): the ids of each whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, encode = load(path)
        for part in common.slices(batches, limit=SLICE):
            ids, n = encode([x.decode() for x in common.texts(part.column(1))])
            yield common.record(doc_id=part.column(0), ids=pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)), pa.int32()), pa.array(ids.view(np.int32), pa.int32())))

    return common.map_arrow(docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")), run, "doc_id long, ids array<int>")


def decode_column(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) from (doc_id, ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, _ = load(path)
        for batch in batches:
            yield common.record(doc_id=batch.column(0), text=[bpe.decode(np.array(x or [], np.int64)) for x in batch.column(1).to_pylist()])

    return common.map_arrow(encoded.select("doc_id", "ids"), run, "doc_id long, text string")


def digest(docs: DataFrame, path: str) -> DataFrame:
    """Encodes and decodes each text; counts and hashes of both results."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, encode = load(path)
        digits = np.array([str(i) for i in range(bpe.size)], object)
        for part in common.slices(batches, limit=SLICE):
            ids, n = encode([x.decode() for x in common.texts(part.column(1))])
            cut = np.cumsum(n).tolist()
            rows = []
            for a, b in zip([0, *cut], cut):
                own = ids[a:b]
                rows.append((hashlib.sha256(" ".join(digits[own].tolist()).encode()).hexdigest(), hashlib.sha256(bpe.decode(own).encode()).hexdigest()))
            yield common.record(doc_id=part.column(0), n_tokens=n, ids_sha256=[x for x, _ in rows], decoded_sha256=[x for _, x in rows])

    df = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.col("text"))
    return common.map_arrow(df, run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
