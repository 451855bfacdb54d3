"""Media columns: FLAC streams of 8-bit mono PCM, written and read in numpy.

``encode`` turns payloads into FLAC streams: frames of 1024 samples, the best of
the fixed linear predictors 0 to 4 (or one explicit LPC filter), Rice-coded
residuals, CRC-8 and CRC-16, STREAMINFO with the MD5 of the samples, and a seek
table when there is more than one frame. ``decode`` reads mono 8-bit streams:
constant, verbatim, fixed and LPC subframes, both Rice partition methods and
escaped partitions; it verifies both checksums of every frame and the MD5.

All frames of a slice advance together: one numpy step handles sample t of every
frame, so cost is per sample, not per Python call. Streams with a seek table are
cut into frames at once; others are walked frame by frame.

Edge cases: null text is an empty payload; empty payloads become 192 spaces;
long texts are one stream of many frames; equal texts give equal streams, in any
slice; an empty table gives an empty table; only ``doc_id`` and ``text`` are
read, so extra columns of any name do no harm; null ids pass through. A stream
that fails a check raises ``FlacError``.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common

BLOCK = 1024
UNIT = 192
#: Bytes of payload in one numpy pass: enough frames to advance together, few enough for the caches.
SLICE = 768 << 10
RATE = 8000

#: Fixed predictors of the FLAC format (RFC 9639): coefficients of the preceding samples, newest first.
FIXED = [[], [1], [2, -1], [3, -3, 1], [4, -6, 4, -1]]


class FlacError(ValueError):
    pass


def _crc_table(poly: int, bits: int) -> np.ndarray:
    out = []
    for b in range(256):
        c = b << (bits - 8)
        for _ in range(8):
            c = (c << 1) ^ poly if c >> (bits - 1) & 1 else c << 1
        out.append(c & ((1 << bits) - 1))
    return np.array(out, np.uint32)


CRC8, CRC16 = _crc_table(0x07, 8), _crc_table(0x8005, 16)


def _crc(buf: np.ndarray, start: np.ndarray, length: np.ndarray, bits: int) -> np.ndarray:
    """The checksum of each byte range; all ranges advance by one byte a step."""
    table, out = (CRC8, np.zeros(len(start), np.uint32)) if bits == 8 else (CRC16, np.zeros(len(start), np.uint32))
    order = np.argsort(-length, kind="stable")
    at, left, c = start[order], length[order], np.zeros(len(start), np.uint32)
    active = np.searchsorted(-left, -np.arange(int(left[0]) if len(left) else 0), "left")
    for t, m in enumerate(active):
        x = buf[at[:m] + t]
        c[:m] = table[c[:m] ^ x] if bits == 8 else ((c[:m] << 8) & 0xFFFF) ^ table[(c[:m] >> 8) ^ x]
    out[order] = c
    return out


def _frame_number(n: int) -> bytes:
    """The UTF-8-like coding of a frame number."""
    if n < 0x80:
        return bytes([n])
    k = next(k for k in range(2, 8) if n < 1 << (5 * k + 1))
    tail = [0x80 | (n >> (6 * i)) & 0x3F for i in range(k - 2, -1, -1)]
    return bytes([(0xFF00 >> k) & 0xFF | n >> (6 * (k - 1)), *tail])


def encode(payloads: list[bytes], lpc: tuple[list[int], int] | None = None) -> list[bytes]:
    """FLAC streams of payloads (none may be empty). lpc: quantised coefficients and shift instead of the fixed predictors."""
    sizes = np.fromiter(map(len, payloads), np.int64, len(payloads))
    if not len(sizes):
        return []
    per = -(-sizes // BLOCK)
    f_doc = np.repeat(np.arange(len(sizes)), per)
    f_no = np.arange(len(f_doc)) - np.repeat(np.cumsum(per) - per, per)
    n = np.minimum(BLOCK, sizes[f_doc] - f_no * BLOCK)
    first = np.cumsum(n) - n
    small = np.int32 if lpc else np.int16  # the fixed predictors' residuals of 8-bit samples stay below 2**11
    x = np.frombuffer(b"".join(payloads), np.uint8).astype(small) - small(128)
    t = (np.arange(len(x)) - np.repeat(first, n)).astype(np.int16)

    # The residuals of every predictor; the one with the least sum wins.
    def zigzag(r: np.ndarray, order: int) -> np.ndarray:
        u = (r << 1) ^ (r >> (8 * r.itemsize - 1))
        u[t < order] = 0
        return u

    if lpc:
        coefs, shift = lpc
        pred = np.zeros(len(x), np.int64)
        for j, c in enumerate(coefs):
            pred[j + 1 :] += c * x[: len(x) - j - 1].astype(np.int64)
        kinds = [zigzag((x - (pred >> shift)).astype(np.int32), len(coefs))]
        orders = np.full(len(n), len(coefs))
        pick = np.zeros(len(n), np.int64)
    else:
        kinds, r = [zigzag(x, 0)], x
        for order in range(1, 5):
            r = np.concatenate((r[:1], r[1:] - r[:-1]))
            kinds.append(zigzag(r, order))
        sums = np.stack([np.add.reduceat(u, first, dtype=np.int32) for u in kinds])
        pick = np.where(n < 8, 0, np.argmin(sums, 0))
        orders = pick
    f_of = np.repeat(np.arange(len(n), dtype=np.int32), n)
    u = kinds[0] if len(kinds) == 1 else np.choose(pick.astype(np.int8)[f_of], kinds)
    coded = np.maximum(n - orders, 1)
    mean = np.add.reduceat(u, first, dtype=np.int64) / coded
    guess = np.clip(np.floor(np.log2(np.maximum(mean, 1))).astype(np.int64), 0, 14)
    best_k, best = guess, None
    for k in (np.maximum(guess - 1, 0), guess, np.minimum(guess + 1, 14)):
        cost = np.add.reduceat(u >> k.astype(small)[f_of], first, dtype=np.int32) + (n - orders) * (1 + k)
        best_k, best = (k, cost) if best is None else (np.where(cost < best, k, best_k), np.minimum(cost, best))
    side = 6 + 4 + orders * 8 + ((4 + 5 + 15 * orders) if lpc else 0)
    low = np.minimum.reduceat(x, first)
    constant = (low == np.maximum.reduceat(x, first)) & (lpc is None)
    verbatim = ~constant & ((best + side >= 8 * n) | (n <= orders))

    # Bit lengths, then the place of every code.
    k_of = best_k.astype(small)[f_of]
    warm = t < orders.astype(np.int16)[f_of]
    rice = ~(constant | verbatim)
    length = (u >> k_of).astype(np.int32) + (1 + k_of)
    length[warm | ~rice[f_of]] = 0
    body = np.add.reduceat(length, first, dtype=np.int64)
    bits = 8 + np.where(constant, 8, np.where(verbatim, 8 * n, side + body))
    heads = []
    for i, (number, size) in enumerate(zip(f_no.tolist(), n.tolist())):
        code, extra = (10, b"") if size == BLOCK else (6, bytes([size - 1])) if size <= 256 else (7, struct.pack(">H", size - 1))
        heads.append(bytes([0xFF, 0xF8, code << 4 | 4, 0x02]) + _frame_number(number) + extra)
    h_len = np.fromiter(map(len, heads), np.int64, len(heads)) + 1
    f_len = h_len + -(-bits // 8) + 2
    f_at = np.cumsum(f_len) - f_len
    total = int(f_len.sum())
    bit = np.zeros(total * 8, np.uint8)
    sub = (f_at + h_len) * 8  # the first bit of each subframe

    def put(at: np.ndarray, value: np.ndarray | int, width: int) -> None:
        for j in range(width):
            bit[at + j] = (value >> (width - 1 - j)) & 1

    kind = np.where(constant, 0, np.where(verbatim, 1, (32 + orders - 1) if lpc else (8 + orders)))
    put(sub, kind << 1, 8)
    if constant.any():
        put(sub[constant] + 8, x[first[constant]] & 255, 8)
    whole = verbatim[f_of]
    if whole.any():
        put((sub[f_of] + 8 + 8 * t)[whole], x[whole] & 255, 8)
    head_warm = warm & rice[f_of]
    if head_warm.any():
        put((sub[f_of] + 8 + 8 * t)[head_warm], x[head_warm] & 255, 8)
    after = sub + 8 + orders * 8
    if lpc and rice.any():
        a = after[rice]
        put(a, np.full(len(a), 14), 4)
        put(a + 4, np.full(len(a), lpc[1]), 5)
        for j, c in enumerate(lpc[0]):
            put(a + 9 + 15 * j, np.full(len(a), c & 0x7FFF), 15)
        after = np.where(rice, after + 9 + 15 * orders, after)
    if rice.any():
        put(after[rice] + 6, best_k[rice], 4)
    ends = np.cumsum(length, dtype=np.int64)
    base = ends[first] - length[first]
    at = (after + 10 - base)[f_of] + (ends - length)
    at, v, k_sel = (at, u, k_of) if length.all() else (a[length > 0] for a in (at, u, k_of))
    at = at + (v >> k_sel)
    bit[at] = 1
    for j in range(int(k_sel.max()) if len(k_sel) else 0):
        m = slice(None) if int(k_sel.min()) > j else np.flatnonzero(k_sel > j)
        bit[at[m] + 1 + j] = (v[m] >> (k_sel[m] - 1 - j)) & 1
    out = np.packbits(bit)
    h_flat = np.frombuffer(b"".join(heads), np.uint8)
    h_n = h_len - 1
    out[np.repeat(f_at - (np.cumsum(h_n) - h_n), h_n) + np.arange(len(h_flat))] = h_flat
    out[f_at + h_n] = _crc(out, f_at, h_n, 8)
    crc = _crc(out, f_at, f_len - 2, 16)
    out[f_at + f_len - 2], out[f_at + f_len - 1] = crc >> 8, crc & 255

    d_first = np.cumsum(per) - per
    d_at, d_len = f_at[d_first], np.add.reduceat(f_len, d_first)
    least, most = np.minimum.reduceat(f_len, d_first), np.maximum.reduceat(f_len, d_first)
    signed = x.astype(np.int8).tobytes()
    done, p_at = [], np.cumsum(sizes) - sizes
    raw = out.tobytes()
    for i, size in enumerate(sizes.tolist()):
        k = int(per[i])
        info = struct.pack(">HH", max(BLOCK, 16), max(BLOCK, 16)) + int(least[i]).to_bytes(3, "big") + int(most[i]).to_bytes(3, "big")
        info += (RATE << 44 | 0 << 41 | 7 << 36 | size).to_bytes(8, "big") + hashlib.md5(signed[p_at[i] : p_at[i] + size]).digest()
        seek = b""
        if k > 1:
            f = slice(int(d_first[i]), int(d_first[i]) + k)
            seek = b"".join(struct.pack(">QQH", s, o, c) for s, o, c in zip((f_no[f] * BLOCK).tolist(), (f_at[f] - d_at[i]).tolist(), n[f].tolist()))
            seek = b"\x83" + len(seek).to_bytes(3, "big") + seek
        done.append(b"fLaC" + (b"\x00" if k > 1 else b"\x80") + len(info).to_bytes(3, "big") + info + seek + raw[d_at[i] : d_at[i] + d_len[i]])
    return done


class _Frames:
    """Decodes the frames at ``start``, all together; buf ends with at least 16 spare bytes."""

    def __init__(self, buf: np.ndarray, start: np.ndarray, default_block: np.ndarray):
        self.buf, self.start = buf, start
        self.load = np.ndarray((len(buf) - 7,), ">u8", buf.data, strides=(1,))
        h = buf[np.minimum(start[:, None] + np.arange(17), len(buf) - 1)].astype(np.int64)
        if ((h[:, 0] != 0xFF) | (h[:, 1] & 0xFE != 0xF8) | (h[:, 3] & 0xF1 != 0x00) | (h[:, 3] >> 1 & 7 != 1) & (h[:, 3] >> 1 & 7 != 0)).any():
            raise FlacError("no mono 8-bit frame where one should begin")
        lead = h[:, 4]
        coded = np.select([lead < 0x80, lead < 0xE0, lead < 0xF0, lead < 0xF8, lead < 0xFC, lead < 0xFE], [1, 2, 3, 4, 5, 6], 7)
        at, rows = 4 + coded, np.arange(len(start))
        code = h[:, 2] >> 4
        one, two = h[rows, at] + 1, (h[rows, at] << 8 | h[rows, np.minimum(at + 1, 16)]) + 1
        self.n = np.select([code == 1, (code >= 2) & (code <= 5), code == 6, code == 7, code >= 8], [192, 576 << np.maximum(code - 2, 0), one, two, 256 << np.maximum(code - 8, 0)], 0)
        at = at + (code == 6) + 2 * (code == 7)
        rate = h[:, 2] & 15
        at = at + (rate == 12) + 2 * ((rate == 13) | (rate == 14))
        if (self.n <= 0).any() or (_crc(buf, start, at, 8) != buf[start + at]).any():
            raise FlacError("a frame header fails its checksum")
        self.bit = (start + at + 1) * 8
        self.samples = self._subframes()
        self.end = -(-self.bit // 8) + 2
        got = buf[self.end - 2].astype(np.uint32) << 8 | buf[self.end - 1]
        if (_crc(buf, start, self.end - 2 - start, 16) != got).any():
            raise FlacError("a frame fails its checksum")

    def _read(self, who: np.ndarray, width: np.ndarray | int) -> np.ndarray:
        """Unsigned values of up to 32 bits at the lanes' places, which move on."""
        p = self.bit[who]
        w = self.load[np.minimum(p >> 3, len(self.load) - 1)].astype(np.uint64) << (p & 7).astype(np.uint64)
        width = np.broadcast_to(np.asarray(width, np.int64), p.shape)
        self.bit[who] = p + width
        return np.where(width > 0, w >> (64 - np.maximum(width, 1)).astype(np.uint64), 0).astype(np.int64)

    def _signed(self, who: np.ndarray, width: np.ndarray | int) -> np.ndarray:
        v, width = self._read(who, width), np.asarray(width, np.int64)
        return np.where((width > 0) & (v >> np.maximum(width - 1, 0) & 1 == 1), v - (1 << width), v)

    def _subframes(self) -> np.ndarray:
        """Samples as [frame, time]; beyond a frame's end they are zero."""
        every = np.arange(len(self.n))
        head = self._read(every, 8)
        if (head & 0x81).any():
            raise FlacError("wasted bits are not supported for 8-bit samples")
        kind = head >> 1
        longest = int(self.n.max())
        out = np.zeros((longest, len(self.n)), np.int32)
        if len(who := every[kind == 0]):
            out[:, who] = np.where(np.arange(longest)[:, None] < self.n[who], self._signed(who, 8), 0)
        if len(who := every[kind == 1]):
            for t in range(int(self.n[who].max())):
                go = who[self.n[who] > t]
                out[t, go] = self._signed(go, 8)
        predicted = (kind >= 8) & (kind <= 12) | (kind >= 32)
        if ((kind > 1) & ~predicted).any():
            raise FlacError("a reserved subframe type")
        if len(who := every[predicted]):
            who = who[np.argsort(-self.n[who], kind="stable")]
            out[:, who] = self._predicted(who, kind[who])
        return out.T

    def _predicted(self, who: np.ndarray, kind: np.ndarray) -> np.ndarray:
        n, lpc = self.n[who], kind >= 32
        order = np.where(lpc, kind - 31, kind - 8)
        deep = int(order.max())
        out = np.zeros((int(n[0]), len(who)), np.int64)
        for t in range(deep):
            m = np.flatnonzero(order > t)
            out[t, m] = self._signed(who[m], 8)
        coefs, shift = np.zeros((deep, len(who)), np.int64), np.zeros(len(who), np.int64)
        for o in range(1, min(deep, 4) + 1):
            coefs[:o, ~lpc & (order == o)] = np.array(FIXED[o])[:, None]
        if lpc.any():
            m = np.flatnonzero(lpc)
            precision = self._read(who[m], 4) + 1
            shift[m] = self._signed(who[m], 5)
            for j in range(int(order[m].max())):
                has = order[m] > j
                coefs[j, m[has]] = self._signed(who[m[has]], precision[has])
        method, split = self._read(who, 2), self._read(who, 4)
        if (method > 1).any() or (n % (1 << split)).any():
            raise FlacError("a reserved residual coding")
        size = n >> split
        width = 4 + method
        bit = self.bit[who]
        rice, raw = np.zeros(len(who), np.int64), np.full(len(who), -1)
        active = np.searchsorted(-n, -np.arange(int(n[0])), "left")
        starts = np.zeros(int(n[0]) + 1, bool)
        starts[order[order < n]] = True
        for s, m in {(int(a), int(b)) for a, b in zip(size, n)}:
            starts[0:m:s] = True
        load, last = self.load, len(self.load) - 1
        plain = not deep
        for t in range(int(n[0])):
            m = int(active[t])
            if starts[t]:
                new = np.flatnonzero((t >= order[:m]) & ((t % size[:m] == 0) | (t == order[:m])))
                if len(new):
                    self.bit[who[new]] = bit[new]
                    k = self._read(who[new], width[new])
                    esc = k == (1 << width[new]) - 1
                    raw[new] = -1
                    rice[new] = np.where(esc, 0, k)
                    if esc.any():
                        raw[new[esc]] = self._read(who[new[esc]], 5)
                    bit[new] = self.bit[who[new]]
            go = slice(0, m) if t >= deep else np.flatnonzero(order[:m] <= t)
            p, k = bit[go], rice[go]
            w = load[np.minimum(p >> 3, last)].astype(np.uint64) << (p & 7).astype(np.uint64)
            top = (w >> np.uint64(32)).astype(np.float64)
            q = 1054 - (top.view(np.int64) >> 52)
            far = np.flatnonzero(top == 0)
            fixed = raw[go] >= 0
            if len(far) or fixed.any():
                r, q2 = self._slow(p, k, raw[go])
                p_new = q2
            else:
                rest = w << (q + 1).astype(np.uint64)
                low = np.where(k > 0, rest >> (64 - np.maximum(k, 1)).astype(np.uint64), 0).astype(np.int64)
                v = (q << k) | low
                r = (v >> 1) ^ -(v & 1)
                p_new = p + q + 1 + k
            bit[go] = p_new
            if plain:
                out[t, go] = r
            else:
                acc = np.zeros(len(r), np.int64)
                for j in range(min(deep, t)):
                    acc += coefs[j, go] * out[t - 1 - j, go]
                out[t, go] = r + (acc >> shift[go])
        self.bit[who] = bit
        return out

    def _slow(self, p: np.ndarray, k: np.ndarray, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One residual a lane where some lane has an escaped partition or a long run of zeros."""
        r, to = np.zeros(len(p), np.int64), np.array(p)
        for i in range(len(p)):
            at = int(p[i])

            def take(width: int, at: int) -> int:
                lo, hi = at >> 3, (at + width + 7) >> 3
                return int.from_bytes(self.buf[lo:hi].tobytes(), "big") >> (hi * 8 - at - width) & ((1 << width) - 1) if width else 0

            if raw[i] >= 0:
                v = take(int(raw[i]), at)
                r[i] = v - (1 << int(raw[i])) if raw[i] and v >> (int(raw[i]) - 1) else v
                to[i] = at + int(raw[i])
                continue
            q = 0
            while not take(1, at + q):
                q += 1
                if at + q >= 8 * len(self.buf):
                    raise FlacError("a residual runs past the end")
            v = q << int(k[i]) | take(int(k[i]), at + q + 1)
            r[i], to[i] = (v >> 1) ^ -(v & 1), at + q + 1 + int(k[i])
        return r, to


def decode_blocks(streams: list[bytes]) -> list[list[tuple[int, bytes]]]:
    """Per stream its PCM blocks: (offset of the first sample, unsigned 8-bit samples)."""
    metas = []
    buf = np.frombuffer(b"".join(streams) + bytes(32), np.uint8)
    at = 0
    for s in streams:
        if s[:4] != b"fLaC" or len(s) < 42:
            raise FlacError("not a FLAC stream")
        p, last, info, seek = 4, False, b"", b""
        while not last:
            last, kind, size = bool(s[p] & 0x80), s[p] & 0x7F, int.from_bytes(s[p + 1 : p + 4], "big")
            info, seek = (s[p + 4 : p + 4 + size], seek) if kind == 0 else (info, s[p + 4 : p + 4 + size] if kind == 3 else seek)
            p += 4 + size
        packed = int.from_bytes(info[10:18], "big")
        points = sorted({(a, b) for a, b, _ in struct.iter_unpack(">QQH", seek[: len(seek) // 18 * 18]) if a != 2**64 - 1})
        metas.append({"total": packed & (2**36 - 1), "md5": info[18:34], "first": at + p, "end": at + len(s), "points": points or [(0, 0)]})
        at += len(s)
    blocks: list[list[tuple[int, bytes]]] = [[] for _ in streams]
    todo = [(i, a, m["first"] + b, m["points"][j + 1][0] if j + 1 < len(m["points"]) else m["total"]) for i, m in enumerate(metas) if m["total"] for j, (a, b) in enumerate(m["points"])]
    while todo:
        got = _Frames(buf, np.array([x[2] for x in todo], np.int64), np.zeros(0))
        pcm = (got.samples + 128).astype(np.uint8)
        more = []
        for (i, a, _, until), row, n, end in zip(todo, pcm, got.n.tolist(), got.end.tolist()):
            if end > metas[i]["end"]:
                raise FlacError("a frame runs past its stream")
            blocks[i].append((a, row[:n].tobytes()))
            if a + n < until:
                more.append((i, a + n, end, until))
        todo = more
    for b, m in zip(blocks, metas):
        b.sort()
        pcm = np.frombuffer(b"".join(x for _, x in b), np.uint8)
        if len(pcm) != m["total"] or any(m["md5"]) and hashlib.md5((pcm ^ 128).tobytes()).digest() != m["md5"]:
            raise FlacError("the samples do not match the stream's length or MD5")
    return blocks


def payload(raw: bytes) -> bytes:
    """Spaces up to a positive multiple of 192 bytes."""
    return raw + b" " * (max(UNIT, -(-len(raw) // UNIT) * UNIT) - len(raw))


def feature(pcm: np.ndarray) -> str:
    """Integer features of samples read back: peak, sum of magnitudes, sign changes, sum of steps."""
    s = pcm.astype(np.int64) - 128
    return f"peak={int(np.abs(s).max())};abs={int(np.abs(s).sum())};turns={int(np.count_nonzero((s[1:] < 0) != (s[:-1] < 0)))};steps={int(np.abs(np.diff(s)).sum())}"


def encode_column(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): each text's payload as one FLAC stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in common.slices(batches, limit=SLICE):
            raw = common.texts(part.column(1))
            yield common.record(doc_id=part.column(0), n_bytes=[len(x) for x in raw], media=pa.array(encode([payload(x) for x in raw]), pa.binary()))

    df = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    return common.map_arrow(df, run, "doc_id long, n_bytes long, media binary")


def decode_column(media: DataFrame) -> DataFrame:
    """(doc_id, sample_offset, pcm): blocks of PCM, each seekable by its sample offset."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in common.slices(batches, limit=SLICE):
            found = decode_blocks(part.column(1).to_pylist())
            ids = np.repeat(np.arange(len(found)), [len(b) for b in found])
            yield common.record(doc_id=part.column(0).take(pa.array(ids)), sample_offset=pa.array([a for b in found for a, _ in b], pa.int64()), pcm=pa.array([x for b in found for _, x in b], pa.binary()))

    return common.map_arrow(media.select("doc_id", "media"), run, "doc_id long, sample_offset long, pcm binary")


def media_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes the column, reads the stored streams back and describes both."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in common.slices(batches, 2, SLICE):
            stored = part.column(2).to_pylist()
            rows = []
            for m, b in zip(stored, decode_blocks(stored)):
                pcm = b"".join(x for _, x in b)
                rows.append((len(pcm), hashlib.sha256(pcm).hexdigest(), zlib.crc32(pcm[-16:]), len(m), hashlib.sha256(m).hexdigest(), feature(np.frombuffer(pcm, np.uint8)), len(b)))
            names = ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "n_blocks")
            yield common.record(doc_id=part.column(0), n_bytes=part.column(1), **dict(zip(names, map(list, zip(*rows)))))

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_blocks long"
    return common.map_arrow(encode_column(docs, id_col, text_col), run, schema)
