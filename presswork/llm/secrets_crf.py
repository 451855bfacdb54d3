"""Secret scans: base patterns, and a linear-chain conditional random field.

Texts are cut into tokens (runs of letters, digits and ``_-./+``, or one other
symbol). The field tags each token begin, inside or outside from its shape (length,
digits, case, changes of character class, first three characters), its word, its
neighbours' words and shapes, and features of the whole file. It is trained here by
maximum likelihood on generated lines (secrets in many formats and settings among
ordinary words, identifiers, numbers, addresses, placeholders and junk), so the
model is the same for every input. Scores come from table lookups over all tokens of a slice at once.
A token whose outside score leads by more than any pair of transitions can win
back is outside in the best path whatever surrounds it; Viterbi runs on the
stretches between such tokens, which gives the exact best path.

Base spans are reported as they are; of a span of the field the parts that no base
span covers are added. Spans are code points, end exclusive.

Edge cases: null text counts as empty; texts of any length are scanned whole; a
null id passes through; repeated rows get equal results; an empty table gives an
empty table; only the id and text columns are read, and ``redact`` keeps all
others.
"""

from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

# Fixed patterns of the base scan.
KINDS = ("assign", "access", "hex", "crf")
_ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE)
_WORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
_ACCESS = re.compile(rb"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(rb"[0-9a-f]{24,}")

SLICE = 1 << 20
#: Hash buckets of words and of first three bytes; shapes; file features.
WORDS, HEADS, SHAPES, FILES = 1 << 16, 1 << 16, 10 * 5 * 4 * 2 * 2 * 4, 12
#: Words and heads seen less often in training share one weight, so that random values are not learnt by heart.
LEAST_SEEN = 8
OUT, BEGIN, INSIDE = 0, 1, 2
#: Places of the neighbours whose words and shapes count.
NEAR_WORDS, NEAR_SHAPES = (0, -1, -2, -3, 1), (0, -1, 1)
SEED, LINES, ROUNDS = 11, 6000, 70
#: Shorter spans of the field, and shorter parts beside base spans, are not reported.
LEAST_BYTES, LEAST_PART = 6, 4


def _classes() -> tuple[np.ndarray, ...]:
    kind = np.full(256, 2, np.uint8)
    kind[common.SPACE] = 0
    inner = [*range(48, 58), *range(65, 91), *range(97, 123), *b"_-./+", *range(128, 256)]
    kind[inner] = 1
    is_in = lambda *r: np.isin(np.arange(256), np.concatenate([np.arange(a, b) for a, b in r]))
    return kind, is_in((48, 58)), is_in((65, 91)), is_in((97, 123)), is_in((48, 58), (97, 103)), is_in((128, 256))


_KIND, _DIGIT, _UPPER, _LOWER, _HEXES, _HIGH = _classes()
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_CLASS = (_DIGIT + 2 * _UPPER + 3 * _LOWER).astype(np.uint8)
_VALUE = common.mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))
_MUL = np.uint64(0xA24BAED4963EE407)


def base_spans(raw: bytes) -> list[tuple[str, int, int]]:
    """Byte spans of the base patterns."""
    out = []
    low = raw.lower()
    if any(w in low for w in _WORDS):
        out += [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(raw) if len(m[2]) >= 6]
    if b"AKIA" in raw:
        out += [("access", m.start(), m.end()) for m in _ACCESS.finditer(raw)]
    return out + [("hex", m.start(), m.end()) for m in _HEX.finditer(raw)]


class Tokens:
    """Tokens of a list of texts, with shape and word numbers and file features per text."""

    def __init__(self, raw: list[bytes]):
        self.buf = buf = np.frombuffer(b" ".join(raw) + b" ", np.uint8)
        lens = np.fromiter(map(len, raw), np.int64, len(raw))
        self.doc_start = np.cumsum(lens + 1) - lens - 1
        kind = _KIND[buf]
        new = np.append(True, kind[1:] != kind[:-1]) | (kind == 2)
        at = np.flatnonzero(new)
        size = np.diff(np.append(at, len(buf)))
        real = kind[at] != 0
        sums = np.stack([np.add.reduceat(t[buf].view(np.uint8), at, dtype=np.int32)[real] for t in (_DIGIT, _UPPER, _HEXES, _HIGH)])
        turns = np.add.reduceat(np.append(False, _CLASS[buf[1:]] != _CLASS[buf[:-1]]).view(np.uint8), at, dtype=np.int32)[real]
        place = np.arange(len(buf)) - np.repeat(at, size)
        power = np.full(int(size.max()), _MUL)
        power[0] = 1
        with np.errstate(over="ignore"):
            power = np.multiply.accumulate(power)
            h = np.add.reduceat(_VALUE[_FOLD[buf]] * power[place], at)[real]
        self.start, self.size = at[real], size[real]
        self.end = self.start + self.size
        self.word = (common.mix(h) & np.uint64(WORDS - 1)).astype(np.int32)
        digit, upper, hexes, high = sums
        n = self.size
        length = np.searchsorted([2, 4, 8, 12, 16, 20, 24, 32, 40], n, "right")
        share = np.where(digit == 0, 0, np.where(digit == n, 4, 1 + np.minimum(2, 4 * digit // np.maximum(n, 1))))
        case = np.where(upper == 0, 0, np.where(upper == n, 3, np.where((upper == 1) & _UPPER[buf[self.start]], 1, 2)))
        turn = np.searchsorted([2, 4, 8], turns, "right")  # the change before the token counts as well
        self.shape = (((((length * 5 + share) * 4 + case) * 2 + (hexes == n)) * 2 + (high > 0)) * 4 + turn).astype(np.int32)
        h = sum(_VALUE[np.where(n > k, buf[np.minimum(self.start + k, len(buf) - 1)], 0)] * _MUL ** np.uint64(k) for k in range(3))
        self.head = (common.mix(h) & np.uint64(HEADS - 1)).astype(np.int32)
        self.first = np.searchsorted(self.start, np.append(self.doc_start, len(buf)))
        self.doc = np.repeat(np.arange(len(raw)), np.diff(self.first))
        per = np.diff(self.first)
        many = np.searchsorted([20, 200, 2000], per, "right")
        cum = np.append(0, np.cumsum(digit > 0))
        numbers = np.searchsorted([1, 5, 20], 100 * (cum[self.first[1:]] - cum[self.first[:-1]]) // np.maximum(per, 1), "right")
        cum = np.append(0, np.cumsum(kind[self.start] == 2))
        marks = np.searchsorted([1, 10, 40], 100 * (cum[self.first[1:]] - cum[self.first[:-1]]) // np.maximum(per, 1), "right")
        self.file = np.stack([many, 4 + numbers, 8 + marks])

    def near(self, values: np.ndarray, offset: int, none: int) -> np.ndarray:
        """The neighbour's value; ``none`` beyond the text."""
        i = np.arange(len(values)) + offset
        ok = (i >= self.first[:-1][self.doc]) & (i < self.first[1:][self.doc])
        return np.where(ok, values[np.clip(i, 0, max(len(values) - 1, 0))], none)


class Crf:
    """Weights by feature and tag; ``pair[a, b]`` for tag b after a."""

    def __init__(self, words: np.ndarray, heads: np.ndarray) -> None:
        """words, heads: the buckets with weights of their own."""
        self.word_at, self.head_at = np.zeros(WORDS, np.int32), np.zeros(HEADS, np.int32)
        self.word_at[words] = np.arange(1, len(words) + 1)
        self.head_at[heads] = np.arange(1, len(heads) + 1)
        self.none = len(words) + 1  # beyond the text
        self.word = np.zeros((len(NEAR_WORDS), len(words) + 2, 3), np.float32)
        self.shape = np.zeros((len(NEAR_SHAPES), SHAPES + 1, 3), np.float32)
        self.head = np.zeros((len(heads) + 1, 3), np.float32)
        self.file = np.zeros((FILES, 3), np.float32)
        self.pair = np.zeros((3, 3), np.float32)

    def features(self, t: Tokens) -> list[tuple[np.ndarray, np.ndarray]]:
        """(weights, the row of each token) for every feature."""
        word = self.word_at[t.word]
        out = [(self.word[k], t.near(word, o, self.none) if o else word) for k, o in enumerate(NEAR_WORDS)]
        out += [(self.shape[k], t.near(t.shape, o, SHAPES) if o else t.shape) for k, o in enumerate(NEAR_SHAPES)]
        return [*out, (self.head, self.head_at[t.head])]

    def scores(self, t: Tokens) -> np.ndarray:
        out = self.file[t.file].sum(0)[t.doc]
        for w, row in self.features(t):
            out += w[row]
        return out

    def tags(self, t: Tokens) -> np.ndarray:
        """The best path of every text."""
        out = np.zeros(len(t.start), np.int8)
        if not len(out):
            return out
        s, p = self.scores(t), self.pair
        win = max(float(p[a, y] + p[y, c] - p[a, OUT] - p[OUT, c]) for a in range(3) for c in range(3) for y in (BEGIN, INSIDE))
        edge = max(float(p[a, y] - p[a, OUT]) for a in range(3) for y in (BEGIN, INSIDE)) + max(0.0, *(float(p[y, c] - p[OUT, c]) for c in range(3) for y in (BEGIN, INSIDE)))
        open_ = np.flatnonzero(s[:, OUT] - np.maximum(s[:, BEGIN], s[:, INSIDE]) <= max(win, edge) + 1e-3)
        if not len(open_):
            return out
        head = np.flatnonzero(np.append(True, (np.diff(open_) != 1) | (t.doc[open_[1:]] != t.doc[open_[:-1]])))
        first, size = open_[head], np.diff(np.append(head, len(open_)))
        order = np.argsort(-size, kind="stable")
        first, size = first[order], size[order]
        begins = first == t.first[:-1][t.doc[first]]  # no token before: no transition
        best = s[first] + np.where(begins[:, None], 0, p[OUT])
        back = np.zeros((int(size[0]), len(first), 3), np.int8)
        for k in range(1, int(size[0])):
            m = int(np.searchsorted(-size, -k, "left"))
            via = best[:m, :, None] + p
            back[k, :m] = via.argmax(1)
            best[:m] = via.max(1) + s[first[:m] + k]
        last = first + size - 1
        ends = last + 1 == t.first[1:][t.doc[first]]
        tag = (best + np.where(ends[:, None], 0, p[:, OUT])).argmax(1).astype(np.int8)
        for k in range(int(size[0]) - 1, -1, -1):
            m = int(np.searchsorted(-size, -k, "left"))
            out[first[:m] + k] = tag[:m]
            if k:
                tag[:m] = back[k, np.arange(m), tag[:m]]
        return out

    def fit(self, t: Tokens, gold: np.ndarray, rounds: int = ROUNDS, rate: float = 0.4, decay: float = 2e-5) -> None:
        """Maximum likelihood by full-batch AdaGrad; forward and backward sums for all texts at once."""
        n = np.diff(t.first)
        order = np.argsort(-n, kind="stable")
        order = order[n[order] > 0]
        n, first = n[order], t.first[:-1][order]
        feats = [*self.features(t), *((self.file, f[t.doc]) for f in t.file)]
        power = {id(w): np.full(w.shape, 1e-3, np.float32) for w in [self.pair, *(w for w, _ in feats)]}
        one = np.eye(3, dtype=np.float32)[gold]
        same = np.flatnonzero(t.doc[1:] == t.doc[:-1])
        seen = np.zeros((3, 3), np.float32)
        np.add.at(seen, (gold[same], gold[same + 1]), 1)
        active = [int(np.searchsorted(-n, -k, "left")) for k in range(int(n[0]))]
        lse = lambda x, axis: (lambda m: np.log(np.exp(x - m).sum(axis)) + m.squeeze(axis))(x.max(axis, keepdims=True))
        for _ in range(rounds):
            s = self.scores(t)
            alpha, beta = s.copy(), np.zeros_like(s)
            for k in range(1, len(active)):
                i = first[: active[k]] + k
                alpha[i] = lse(alpha[i - 1][:, :, None] + self.pair, 1) + s[i]
            for k in range(len(active) - 1, 0, -1):
                i = first[: active[k]] + k
                beta[i - 1] = lse(self.pair + (s[i] + beta[i])[:, None, :], 2)
            total = lse(alpha + beta, 1)
            grad = one - np.exp(alpha + beta - total[:, None])
            both = np.exp(alpha[same][:, :, None] + self.pair + (s + beta)[same + 1][:, None, :] - total[same][:, None, None])
            updates = [(self.pair, seen - both.sum(0))]
            sums: dict[int, tuple] = {}
            for w, f in feats:
                g = np.stack([np.bincount(f, grad[:, y], len(w)) for y in range(3)], 1).astype(np.float32)
                sums[id(w)] = (w, sums[id(w)][1] + g) if id(w) in sums else (w, g)
            for w, g in [*updates, *sums.values()]:
                g = g - decay * len(n) * w
                power[id(w)] += g * g
                w += rate * g / np.sqrt(power[id(w)])


# Fixed values of the generator: names that announce a secret, prefixes of issued keys, and names that do not.
_NAMES = (
    "password", "passwd", "pwd", "pass", "passphrase", "secret", "token", "api_key", "apikey", "api-key", "auth", "auth_token", "access_key", "access_token", "secret_key", "client_secret", "private_key", "signing_key",
    "encryption_key", "account_key", "credentials", "bearer", "master_key", "refresh_token", "session_key", "webhook_secret", "kennwort", "passwort", "mot_de_passe", "contraseña", "clave", "pin_code",
)
_ISSUERS = ("db", "aws", "stripe", "azure", "github", "mail", "smtp", "redis", "admin", "root", "my", "app", "service", "jenkins", "slack", "prod", "test", "gcp", "user", "mysql")
_PREFIXES = ("ghp_", "gho_", "github_pat_", "sk-", "sk_live_", "sk_test_", "rk_live_", "pk_live_", "xoxb-", "xoxp-", "glpat-", "AIza", "npm_", "hf_", "dop_v1_", "pypi-", "shpat_", "key-", "ya29.", "SG.")
_PROSE = (
    "{n} is", "my {n} is", "the {n} was", "{n} is now", "new {n} :", "your {n}:", "login with {n}", "use this {n}:", "das {n} ist", "{n} lautet", "le {n} est", "la {n} es", "{n} =>", "--{n}", "--{n}=", "-{n}", "set {n}", "export {n}=", "ENV {n}", "{n}:", "{n} -",
)
_PLAIN = ("color", "id", "version", "size", "name", "title", "user", "page", "lang", "source", "date", "type", "file", "path", "host", "port", "status", "request", "order", "ref", "commit", "branch", "build", "code", "class", "key")
_COMMON = tuple("this that is was use used with set new your now login my the das dies ist war le la est el es esta export lautet of for and key on in at to a as it mail from write see id user name not are has been".split())
_EMPTY = ("********", "<password>", "required", "None", "null", "true", "hidden", "reset", "expired", "must have 8 characters", "os.environ", "${SECRET}", "your_password_here", "xxxxxxxx", "[redacted]", "of the user", "field", "manager", "policy", "ring", "garden", "service", "is not shown", "was changed")


def _lines(rnd: random.Random) -> list[list[tuple[str, bool]]]:
    """Generated texts as pieces (string, is it a secret)."""
    lower, upper, digits, hexes = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "0123456789abcdef"
    alnum = lower + upper + digits
    some = lambda letters, a, b: "".join(rnd.choices(letters, k=rnd.randint(a, b)))
    parts = ["the", "er", "in", "tion", "re", "and", "ou", "en", "st", "é", "eau", "ß", "ung", "sch", "ñ", "ción", "la", "qu", "mo", "ti", "ing", "be", "ver", "al", "um", "to", "ar"]
    pick = rnd.choice

    def word() -> str:
        w = pick(_COMMON) if rnd.random() < 0.3 else "".join(rnd.choices(parts, k=rnd.randint(1, 5)))
        return pick([w, w, w, w, w.capitalize(), w + ",", w + ".", w.upper(), w + pick(["###", "&&&", "***", "%%%", "$$$", "!!"])])

    def plain() -> str:
        return "".join(x for x in word() if x.isalpha()) or "x"

    def uuid() -> str:
        return "-".join(some(hexes, k, k) for k in (8, 4, 4, 4, 12))

    def harmless() -> str:
        return pick([
            lambda: str(rnd.randrange(10**6)), lambda: f"{rnd.randrange(2100)}-{rnd.randrange(13):02}-{rnd.randrange(32):02}", lambda: f"{rnd.randrange(30)}.{rnd.randrange(99)}.{rnd.randrange(9)}",
            lambda: f"{plain()}.{rnd.randrange(99)}@{plain()}{rnd.randrange(9)}.{pick(['com', 'example.com', 'org'])}", lambda: f"{pick(_NAMES)} {pick(['is', 'was', 'ist', 'est', 'es', 'of', 'for', 'in'])} {plain()} {plain()}", lambda: f"{plain()} {pick(['is', 'was', 'ist', 'est', 'es', 'on', 'now', 'with', 'use', 'set', 'the key', 'my'])} {plain()}{pick(['', '', '.', ':'])} {plain()}",
            lambda: f"{plain()}.{rnd.randrange(100):02}@{pick(['mail', plain(), 'post'])}{rnd.randrange(10)}.{pick(['example.com', 'com', 'example'])}", lambda: f"{pick(['write to', 'from', ':', 'mail'])} {plain()}{pick(['.', '_', ''])}{plain()}{rnd.randrange(99)}@{plain()}.{plain()}.org",
            lambda: f"{pick(['le', 'la', 'das', 'el', 'the', 'my', 'der', 'your', 'new'])} {pick([plain(), '', pick(_NAMES)])} {pick(['est', 'ist', 'es', 'is', 'was'])} {plain()}{pick(['', ',', '.'])} {plain()}".replace("  ", " "),
            lambda: f"{plain()}.{plain()}@{plain()}.com", lambda: f"{plain()}{rnd.randrange(99)}@example.com", lambda: f"https://www.{plain()}.com/{some('abcdefghij', 3, 12)}/{some('abcde-', 4, 20)}?page={rnd.randrange(99)}",
            lambda: f"http://{plain()}:{rnd.randrange(80, 9999)}/{plain()}", lambda: f"see https://{plain()}.org/{plain()}/{plain()}.html", lambda: f"+{some(digits, 9, 12)}", lambda: f"({some(digits, 3, 3)}) {some(digits, 3, 3)}-{some(digits, 4, 4)}",
            lambda: f"10.{rnd.randrange(255)}.{rnd.randrange(255)}.1", lambda: f"src/{some('abcdefgh', 3, 9)}/{some('abcdefgh_', 3, 14)}.py", lambda: some(digits, 8, 18), lambda: f"{word()} = {rnd.randrange(99)}",
            lambda: f"{pick(_PLAIN)}{pick([': ', '=', ' = '])}{pick([plain(), plain() + str(rnd.randrange(99)), uuid(), str(rnd.randrange(10**6)), some(hexes, 4, 12), plain() + '-' + plain(), plain().capitalize() + plain().capitalize()])}",
            lambda: pick(_NAMES) + " " + plain(), lambda: "the " + pick(_NAMES) + " " + pick(_EMPTY), lambda: pick(_NAMES) + pick([": ", " = ", "=", " "]) + pick(_EMPTY), lambda: f"{plain()} {pick(_NAMES)}.", lambda: f"a {pick(_NAMES)} for the {plain()}",
            lambda: "|", lambda: "-", lambda: "x" * rnd.randint(5, 40), lambda: pick(lower) * rnd.randint(5, 30), lambda: some(lower, 14, 34), lambda: f"{pick(_PLAIN)}=\"{some('abcdef', 3, 8)}\"", lambda: "Licensed under the Apache License, Version 2.0.", lambda: some(hexes, 4, 10), uuid,
            lambda: f"{pick(['Get', 'Set', 'Make'])}{plain().capitalize()}{pick(['Value', plain().capitalize()])}", lambda: f"{plain()}_{plain()}_{rnd.randrange(99)}", lambda: f"{plain()}{plain().capitalize()}{rnd.randrange(9)}", lambda: f"{some(upper, 2, 3)}-{some(digits, 3, 6)}-{some(upper, 1, 3)}",
            lambda: f"{some(upper, 2, 2)}{some(digits, 16, 22)}", lambda: " ".join(some(digits, 4, 4) for _ in range(4)), lambda: f"#{some(hexes, 6, 6)}", lambda: f"<{plain()}>{word()}</{plain()}>", lambda: f"{plain()}@{plain()}:~/{plain()}", lambda: f"{rnd.randrange(24):02}:{rnd.randrange(60):02}:{rnd.randrange(60):02}",
            lambda: f"{plain()}/{plain()}-{plain()}", lambda: f"ISBN 978-{rnd.randrange(10)}-{some(digits, 4, 4)}-{some(digits, 4, 4)}-{rnd.randrange(10)}", lambda: f"{plain().upper()}_{plain().upper()}", lambda: f"{plain()}.{plain()}.{plain()}()", lambda: "".join(rnd.choices(parts[:20], k=rnd.randint(6, 10))),
        ])()

    def human() -> str:
        w = list(some(lower, 5, 9))
        for _ in range(rnd.randint(1, 4)):
            w[rnd.randrange(len(w))] = pick(digits)
        w[0] = pick([w[0], w[0].upper()])
        return "".join(w) + pick(["", "", some(digits, 1, 4), pick(upper), "!", "!" + some(digits, 1, 3), "_" + some(alnum, 2, 4), "#" + some(digits, 1, 2), "$" + some(lower, 1, 3)])

    def issued() -> str:
        prefix = pick(_PREFIXES)
        if prefix.startswith("xox"):
            return f"{prefix}{some(digits, 10, 12)}-{some(digits, 10, 13)}-{some(alnum, 16, 32)}"
        if prefix == "SG.":
            return f"SG.{some(alnum + '_-', 18, 24)}.{some(alnum + '_-', 32, 44)}"
        return prefix + some(alnum + pick(["", "_", "-"]), 20, 44)

    def jwt() -> str:
        url = alnum + "_-"
        return f"eyJ{some(url, 14, 36)}.eyJ{some(url, 18, 80)}.{some(url, 20, 43)}"

    def opaque() -> str:
        return pick([lambda: some(hexes, 16, 64), lambda: some(alnum, 16, 44), lambda: some(alnum + "+/", 24, 88) + pick(["", "=", "=="]), lambda: some(alnum + "_-", 18, 44), lambda: some(upper + digits, 16, 32), lambda: some(lower + digits, 16, 40)])()

    def secret() -> list[tuple[str, bool]]:
        value = pick([opaque, opaque, human, human, issued, jwt, uuid])()
        name = pick([pick(_NAMES), pick(_NAMES), f"{pick(_ISSUERS)}{pick(['_', '-', ''])}{pick(_NAMES)}", f"{pick(_ISSUERS)}_key", f"{pick(_ISSUERS)}{pick(_NAMES).capitalize()}"])
        name = pick([name, name, name.upper(), name.capitalize()])
        quote = pick(["", "", '"', "'", "`"])
        form = rnd.randrange(11)
        if form < 4:
            return [(f"{pick(['', '', quote])}{name}{pick(['=', ' = ', ': ', ':', ' => ', ' := ', '\": '])}{quote}", False), (value, True), (f"{quote}{pick(['', ',', ';', '.'])} ", False)]
        if form < 6:
            return [(pick(_PROSE).format(n=name) + " " + quote, False), (value, True), (quote + pick([" ", ". ", ", ", "\n"]), False)]
        if form == 6:
            end = pick([f"@{plain()}.{plain()}:{rnd.randrange(999, 9999)}/{plain()} ", f"@{plain()}/{plain()} ", f"@10.0.{rnd.randrange(255)}.1:{rnd.randrange(999, 9999)} "])
            return [(f"{pick(['postgres', 'mysql', 'mongodb', 'redis', 'amqp', 'https', 'ftp', 'postgresql', 'jdbc'])}://{plain()}:", False), (pick([human, human, opaque, lambda: some(alnum, 8, 16)])(), True), (end, False)]
        if form == 7:
            return [(pick(["Authorization: Bearer ", "Authorization: Basic ", "X-Api-Key: ", "-H 'Authorization: token ", "Bearer ", "AccountKey=", "SharedAccessKey="]), False), (pick([opaque, issued, jwt])(), True), (" ", False)]
        if form == 8:
            return [(f"<{name}>", False), (value, True), (f"</{name}> ", False)] if rnd.random() < 0.4 else [("AKIA" + some(upper + digits, 16, 16), True), (" ", False)]
        if form == 9:
            return [(pick([issued, jwt])(), True), (pick([" ", ". ", "\n"]), False)]
        return [(pick([lambda: some(hexes, 32, 64), lambda: some(alnum, 28, 44), lambda: some(alnum + "+/", 36, 60) + "="])(), True), (" ", False)]

    out = []
    for _ in range(LINES):
        line: list[tuple[str, bool]] = []
        for _ in range(rnd.randint(1, 3)):
            line.append((" ".join(word() for _ in range(rnd.randint(1, 9))) + " ", False))
            line += secret() if rnd.random() < 0.3 else [(harmless() + " ", False), (harmless() + " ", False)]
        line.append((" ".join(word() for _ in range(rnd.randint(0, 6))), False))
        out.append(line)
    return out


@lru_cache(maxsize=1)
def trained() -> Crf:
    lines = _lines(random.Random(SEED))
    raw, marks = [], []
    for line in lines:
        raw.append("".join(x for x, _ in line).encode())
        marks.append(b"".join((b"\1" if y else b"\0") * len(x.encode()) for x, y in line))
    t = Tokens(raw)
    inside = np.frombuffer(b"\0".join(marks) + b"\0", np.uint8)[t.start] == 1
    before = np.append(False, inside[:-1] & (t.doc[1:] == t.doc[:-1]))
    often = lambda x, n: np.flatnonzero(np.bincount(x, minlength=n) >= LEAST_SEEN)
    crf = Crf(often(t.word, WORDS), often(t.head, HEADS))
    crf.fit(t, np.where(inside, np.where(before, INSIDE, BEGIN), OUT))
    return crf


def _merged(spans: list[tuple[str, int, int]]) -> tuple[list[int], list[int]]:
    """Starts and ends of the disjoint stretches that the spans cover, in order."""
    starts: list[int] = []
    ends: list[int] = []
    for a, b in sorted((a, b) for _, a, b in spans):
        if ends and a <= ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    return starts, ends


def _uncovered(s: int, e: int, covered: tuple[list[int], list[int]]) -> list[tuple[int, int]]:
    """s to e where nothing of it is covered, else the parts of LEAST_PART bytes that are not."""
    starts, ends = covered
    out, at, k = [], s, bisect_right(ends, s)
    if k == len(ends) or starts[k] >= e:
        return [(s, e)]
    while k < len(ends) and starts[k] < e:
        out.append((at, starts[k]))
        at = ends[k]
        k += 1
    return [(x, y) for x, y in [*out, (at, e)] if y - x >= LEAST_PART]


def scan(raw: list[bytes], crf: Crf) -> list[list[tuple[int, int, int]]]:
    """For each text its spans (start, kind number, end) in code points, in order."""
    t = Tokens(raw)
    tag = crf.tags(t)
    own: list[list[tuple[str, int, int]]] = [base_spans(x) for x in raw]
    hit = np.flatnonzero(tag)
    if len(hit):
        new = np.append(True, (np.diff(hit) != 1) | (tag[hit[1:]] == BEGIN) | (t.doc[hit[1:]] != t.doc[hit[:-1]]))
        a = np.flatnonzero(new)
        b = np.append(a[1:], len(hit)) - 1
        base = [_merged(x) for x in own]
        for d, s, e in zip(t.doc[hit[a]].tolist(), (t.start[hit[a]] - t.doc_start[t.doc[hit[a]]]).tolist(), (t.end[hit[b]] - t.doc_start[t.doc[hit[b]]]).tolist()):
            if e - s >= LEAST_BYTES:
                own[d] += [("crf", x, y) for x, y in _uncovered(s, e, base[d])]
    out = []
    for x, spans in zip(raw, own):
        points = (lambda k: k) if x.isascii() else (lambda k, x=x: len(x[:k].decode()))
        out.append(sorted((points(s), KINDS.index(k), points(e)) for k, s, e in spans))
    return out


def find(docs: DataFrame) -> DataFrame:
    """(doc_id, spans): spans are structs of kind, start and end, by start, then kind."""
    shared = docs.sparkSession.sparkContext.broadcast(trained())
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in common.slices(batches, limit=SLICE):
            found = scan(common.texts(part.column(1)), shared.value)
            yield common.record(doc_id=part.column(0), spans=pa.array([[{"kind": KINDS[k], "start": s, "end": e} for s, k, e in x] for x in found], kind))

    return common.map_arrow(docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.col("text")), run, "doc_id long, spans array<struct<kind:string,start:long,end:long>>")


def digest(docs: DataFrame) -> DataFrame:
    def joined(spans):
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")

    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return find(docs).select("doc_id", *map(count, KINDS), F.sha2(joined(F.filter("spans", lambda x: x["kind"] != "crf")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """docs with every span of the text replaced by ``mark``; a null text stays null."""
    shared = docs.sparkSession.sparkContext.broadcast(trained())

    @F.pandas_udf(T.StringType())
    def clean(texts: pd.Series) -> pd.Series:
        out: list[str | None] = []
        todo = [x.encode() if x is not None else None for x in texts]
        at = 0
        while at < len(todo):
            to, size = at, 0
            while to < len(todo) and (to == at or size + len(todo[to] or b"") <= SLICE):
                size += len(todo[to] or b"")
                to += 1
            for x, spans in zip(todo[at:to], scan([x or b"" for x in todo[at:to]], shared.value)):
                if x is None or not spans:
                    out.append(None if x is None else x.decode())
                    continue
                text, done, pieces = x.decode(), 0, []
                for s, _, e in spans:
                    if s >= done:
                        pieces += [text[done:s], mark]
                    done = max(done, e)
                out.append("".join([*pieces, text[done:]]))
            at = to
        return pd.Series(out, dtype=object)

    return docs.withColumn("text", clean(docs["text"]))
