"""Pre-tokens of the two public BPE vocabularies, and token ids through a cache of pre-tokens.

Both tokenizers treat every pre-token alone, so a text's ids are its pre-tokens'
ids in a row. Most pre-tokens repeat: each distinct one is encoded once a worker
and kept in a bounded cache.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from itertools import chain, repeat

import numpy as np
import regex

# White space as Unicode defines it; letters and numbers below U+0250; the tokenizers' patterns.
_WS = r"\t-\r \x85\xa0  -     　"
_L = r"A-Za-zªµºÀ-ÖØ-öø-ɏ"
_N = r"0-9²³¹¼-¾"
_LOWER_WORDS = "'s|'t|'re|'ve|'m|'ll|'d|[{L}]+|[{N}]|[^{W}{L}{N}]+"
_BYTE_WORDS = "'s|'t|'re|'ve|'m|'ll|'d| ?[{L}]+| ?[{N}]+| ?[^{W}{L}{N}]+|[{W}]+(?![^{W}])|[{W}]+"



def byte_letters() -> list[str]:
    """The printable stand-in of each byte in byte-level BPE: itself if printable, else the next letter from U+0100."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


_HIGH = re.compile("[ɐ-\U0010ffff]")
#: Distinct pre-tokens a worker keeps; beyond it the cache starts anew.
CACHE = 800_000


def _pair(pattern: str) -> tuple[Callable[[str], list[str]], Callable[[str], list[str]]]:
    low = re.compile(pattern.format(L=_L, N=_N, W=_WS)).findall
    return low, regex.compile(pattern.format(L=r"\p{L}", N=r"\p{N}", W=_WS)).findall


_FINDERS = {"word": _pair(_LOWER_WORDS), "byte": _pair(_BYTE_WORDS)}


def normal(text: str) -> str:
    """NFC, then each character lower-cased by itself (no final sigma)."""
    if not text.isascii():
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
    return text.lower()


def pieces(text: str, kind: str) -> list[str]:
    if kind == "word":
        text = normal(text)
    low, full = _FINDERS[kind]
    return low(text) if text.isascii() or not _HIGH.search(text) else full(text)


class PieceCache:
    """Ids of texts: ``encode`` gives the id lists of new pre-tokens; special: token strings that are single ids."""

    def __init__(self, kind: str, encode: Callable[[list[str]], list[list[int]]], special: dict[str, int], limit: int = CACHE):
        self.kind, self.encode, self.special, self.limit = kind, encode, special, limit
        self.split = re.compile("(" + "|".join(map(re.escape, special)) + ")").split if special else None
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 0
        self.start, self.size = np.zeros(1 << 14, np.int32), np.zeros(1 << 14, np.int32)
        for token, i in self.special.items():
            self._add(["\0" + token], [[i]])

    def _add(self, words: list[str], ids: list[list[int]]) -> None:
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        total, n = int(sizes.sum()), len(self.number)
        while self.used + total > len(self.flat):
            self.flat = np.concatenate((self.flat, np.zeros_like(self.flat)))
        while n + len(words) > len(self.start):
            self.start, self.size = (np.concatenate((x, np.zeros_like(x))) for x in (self.start, self.size))
        self.flat[self.used : self.used + total] = np.fromiter((i for x in ids for i in x), np.uint32, total)
        self.start[n : n + len(words)] = self.used + np.cumsum(sizes) - sizes
        self.size[n : n + len(words)] = sizes
        self.used += total
        self.number.update(zip(words, range(n, n + len(words))))

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and how many each text has."""
        if len(self.number) > self.limit:
            self.clear()
        parts: list[list[str]] = []
        for text in texts:
            if self.split and any(x in text for x in self.special):
                parts.append([p for k, x in enumerate(self.split(text)) for p in (["\0" + x] if k % 2 else pieces(x, self.kind))])
            else:
                parts.append(pieces(text, self.kind))
        counts = np.fromiter(map(len, parts), np.int64, len(parts))
        flat = list(chain.from_iterable(parts))
        at = np.fromiter(map(self.number.get, flat, repeat(-1)), np.int64, len(flat))
        missing = np.flatnonzero(at < 0).tolist()
        if missing:
            new = list({flat[i] for i in missing})
            self._add(new, self.encode(new))
            for i in missing:
                at[i] = self.number[flat[i]]
        size = self.size[at]
        ends = np.cumsum(size, dtype=np.int64)
        ids = self.flat[np.repeat((self.start[at] - (ends - size)).astype(np.int32), size) + np.arange(int(ends[-1]) if len(ends) else 0, dtype=np.int32)]
        edge = np.append(0, ends)[np.append(0, np.cumsum(counts))]
        return ids, np.diff(edge)


_LOADED: dict[tuple, PieceCache] = {}


def library_cache(path: str, kind: str) -> PieceCache:
    """Ids by the tokenizers library; one cache a worker process."""
    if (path, kind) not in _LOADED:
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        tok.no_truncation()
        tok.no_padding()
        special = {t.content: i for i, t in tok.get_added_tokens_decoder().items()}
        _LOADED[path, kind] = PieceCache(kind, _model(tok), special)
    return _LOADED[path, kind]


def largest_id(path: str) -> int:
    """The largest id that a tokenizer file can give."""
    from tokenizers import Tokenizer

    return max(Tokenizer.from_file(path).get_vocab(with_added_tokens=True).values(), default=0)


def _model(tok) -> Callable[[list[str]], list[list[int]]]:
    """The library's BPE model on pre-tokens in the byte alphabet, without its per-text bookkeeping."""
    letters = str.maketrans(dict(enumerate(byte_letters())))
    tokenize = tok.model.tokenize

    def encode(words: list[str]) -> list[list[int]]:
        return [[t.id for t in tokenize(w.encode().decode("latin-1").translate(letters))] for w in words]

    return encode
