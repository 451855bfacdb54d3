import random
import zlib

import numpy as np
import pytest

from presswork.llm import media_flac as m


def joined(streams):
    return [b"".join(x for _, x in s) for s in m.decode_blocks(streams)]


def cases():
    rnd = random.Random(1)
    out = [bytes(rnd.choice([rnd.randrange(256), 97]) for _ in range(rnd.randrange(1, 3000))) for _ in range(40)]
    return out + [b"a" * 5000, bytes(range(256)) * 20, b"\x00", bytes([0, 255] * 700), b"the of and " * 400]


@pytest.mark.parametrize("lpc", [None, ([8, -3, 1], 3), ([3], 2), ([-5, 9], 4)])
def test_round_trip(lpc):
    data = cases()
    assert joined(m.encode(data, lpc)) == data


def test_streams_do_not_depend_on_their_neighbours():
    data = cases()
    assert [m.encode([x])[0] for x in data] == m.encode(data)


def test_a_stream_without_seek_table_is_walked_and_offsets_are_given():
    data = bytes(random.Random(4).randrange(90, 122) for _ in range(5000))
    s = m.encode([data])[0]
    size = int.from_bytes(s[43:46], "big")
    bare = s[:4] + bytes([0x80]) + s[5:42] + s[46 + size :]
    blocks = m.decode_blocks([bare])[0]
    assert [a for a, _ in blocks] == [0, 1024, 2048, 3072, 4096]
    assert all(data[a : a + len(x)] == x for a, x in blocks)


def bits_of(*fields):
    text = "".join(f"{v & (1 << w) - 1:0{w}b}" for v, w in fields if w)
    text += "0" * (-len(text) % 8)
    return int(text, 2).to_bytes(len(text) // 8, "big")


def test_partitions_escapes_and_five_bit_parameters():
    """A frame written by hand: fixed order 1, two partitions, one Rice and one escaped."""
    x = [3, 5, 4, 4, -100, 100, 0, 7]
    r = [b - a for a, b in zip(x, x[1:])]
    fields = [(9 << 1, 8), (x[0], 8), (1, 2), (1, 4), (2, 5)]
    for v in r[:3]:
        u = 2 * v if v >= 0 else -2 * v - 1
        fields += [(0, u >> 2), (1, 1), (u & 3, 2)]
    fields += [(31, 5), (9, 5)] + [(v, 9) for v in r[3:]]
    head = bytes([0xFF, 0xF8, 0x64, 0x02, 0x00, 7])
    head += bytes([int(m._crc(np.frombuffer(head, np.uint8), np.array([0]), np.array([6]), 8)[0])])
    frame = head + bits_of(*fields)
    frame += int(m._crc(np.frombuffer(frame, np.uint8), np.array([0]), np.array([len(frame)]), 16)[0]).to_bytes(2, "big")
    info = bytes(10) + (8000 << 44 | 7 << 36 | 8).to_bytes(8, "big") + bytes(16)
    assert joined([b"fLaC\x80\x00\x00\x22" + info + frame]) == [bytes(v + 128 for v in x)]


def test_damage_is_found():
    s = bytearray(m.encode([b"some text " * 300])[0])
    for at in (len(s) - 5, len(s) - 1, len(s) // 2, 30):
        bad = bytearray(s)
        bad[at] ^= 4
        with pytest.raises(m.FlacError):
            m.decode_blocks([bytes(bad)])


def test_query_rows(spark):
    rows = [(1, "abc", "q"), (2, None, "q"), (None, "", None), (2, "é" * 4000, "q"), (3, "abc", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, media string")
    got = m.media_digest(df).collect()
    assert len(got) == 5
    for r, (i, text, _) in zip(sorted(got, key=lambda r: (r.doc_id or 0, r.n_bytes)), sorted(rows, key=lambda r: (r[0] or 0, len(r[1] or "")))):
        p = m.payload((text or "").encode())
        assert (r.doc_id, r.n_bytes, r.payload_bytes, r.tail_crc32) == (i, len((text or "").encode()), len(p), zlib.crc32(p[-16:]))
    assert len({r.media_sha256 for r in got}) == 3
    assert {x.pcm for x in m.decode_column(m.encode_column(df.where("doc_id = 1"))).collect()} == {m.payload(b"abc")}
    assert m.media_digest(df.limit(0)).count() == 0
