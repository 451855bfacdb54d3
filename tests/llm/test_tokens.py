import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from presswork.llm import bpe_rounds, packing, token_files
from presswork.llm.pretoken import PieceCache, library_cache

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
ODD = ["", "ΑΣ σΣ İx ǅ", "<|endoftext|>a <|startoftext|>B", "á é  \x85\x1c x²½", "aaaaaaa aaaa !!!''s don't I'LL 12345 ٣٤", "日本語 テスト 한국어 \U0001f600‍",
       "a\n\n  b \t\n", "   x　", " <|endoftext|> x", "xy" * 3000, "fi ﬁ ß ẞ K å", "\n", " ", "𝒳𝒴 é"]
SCHEMA = "doc_id long, text string, ids string, length long"


def docs(spark, sf_dir):
    rows = [(i, t, "clash", 3) for i, t in enumerate(ODD)] + [(None, None, None, None), (2, None, "x", 1), (2, ODD[2], "x", 1), (None, "a b", "x", 1)]
    more = spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("doc_id + 100 AS doc_id", "text", "lang AS ids", "n_chars AS length")
    return spark.createDataFrame(rows, SCHEMA).unionByName(more)


def library(path):
    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    return lambda text: tok.encode(text or "", add_special_tokens=False).ids, tok


@pytest.mark.parametrize("kind,path", [("word", WORD), ("byte", BYTE)])
def test_cached_ids_equal_the_library(kind, path):
    encode, _ = library(path)
    rnd = random.Random(2)
    letters = "aAbZé Σ'’12²\n\t .,!?-_<|>日😀́"
    texts = ODD + ["".join(rnd.choices(letters, k=rnd.randrange(60))) for _ in range(400)]
    ids, n = library_cache(path, kind)(texts)
    cut = np.cumsum(n)
    for t, a, b in zip(texts, cut - n, cut):
        assert ids[a:b].tolist() == encode(t), t


def test_merge_rounds_equal_the_library_and_survive_a_small_cache():
    encode, tok = library(WORD)
    bpe = bpe_rounds.RoundsBpe(WORD)
    cache = PieceCache("word", bpe.words, bpe.special, limit=3)
    rnd = random.Random(4)
    for _ in range(5):
        texts = ODD + ["".join(rnd.choices("thequickaeio nst'1é", k=rnd.randrange(80))) for _ in range(100)]
        ids, n = cache(texts)
        cut = np.cumsum(n)
        for t, a, b in zip(texts, cut - n, cut):
            assert ids[a:b].tolist() == encode(t)
            assert bpe.decode(ids[a:b]) == tok.decode(encode(t), skip_special_tokens=False)


def test_bpe_query(spark, sf_dir):
    df = docs(spark, sf_dir)
    encode, tok = library(WORD)
    want = sorted((str(r.doc_id), len(i), hashlib.sha256(" ".join(map(str, i)).encode()).hexdigest(), hashlib.sha256(tok.decode(i, skip_special_tokens=False).encode()).hexdigest()) for r in df.collect() for i in [encode(r.text)])
    assert sorted((str(r.doc_id), *r[1:]) for r in bpe_rounds.digest(df, WORD).collect()) == want
    small = df.where("doc_id < 20")
    assert {r.text for r in bpe_rounds.decode_column(bpe_rounds.encode_column(small, WORD), WORD).collect()} == {tok.decode(encode(r.text), skip_special_tokens=False) for r in small.collect()}
    assert bpe_rounds.digest(df.limit(0), WORD).count() == 0


def test_token_files(spark, sf_dir):
    df = docs(spark, sf_dir)
    encode, _ = library(WORD)
    crc = lambda i: zlib.crc32(np.array(i, "<u4").tobytes())
    got = sorted(token_files.digest(df, WORD).collect(), key=lambda r: r.start)
    ids = [(-1 if r.doc_id is None else r.doc_id) for r in got]
    assert ids == sorted(ids)
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_crc32) for r in got) == sorted((str(r.doc_id), len(i), crc(i)) for r in df.collect() for i in [[*encode(r.text), 1]])
    assert token_files.digest(df.limit(0), WORD).count() == 0


def test_widths_follow_the_vocabulary(tmp_path):
    assert [token_files.width_of(x) for x in (0, 65535, 65536)] == [2, 2, 4]
    one = np.array([1], np.int64)
    for width, top in ((2, 65535), (4, 1 << 31)):
        w = token_files.Writer(str(tmp_path / str(width)), 0, width)
        w.add(np.array([top, 1], np.uint32), one * 2, one, one * 0)
        w.close()
        assert token_files.Reader(str(tmp_path / str(width) / "ids-00000")).document(0).tolist() == [top, 1]
    with pytest.raises(ValueError, match="does not fit"):
        token_files.Writer(str(tmp_path / "small"), 0, 2).add(np.array([65536], np.uint32), one, one, one * 0)


def test_packing_query(spark, sf_dir):
    df = docs(spark, sf_dir)
    encode, _ = library(BYTE)
    rows = packing.packed(df, BYTE).collect()
    total = sum(len(encode(r.text)) + 1 for r in df.collect())
    assert sum(r.length for r in rows) == total
    by_doc = {r.doc_id: [*encode(r.text), 1] for r in df.collect() if r.doc_id not in (None, 2)}
    seqs = defaultdict(list)
    for r in rows:
        seqs[r.sequence_id].append((r.offset, r.length))
        if r.doc_id in by_doc:
            ids = by_doc[r.doc_id]
            assert r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())
    for s in seqs.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(seqs) * 2048 <= 1.1 * total + 2048
    assert packing.packed(df.limit(0), BYTE).count() == 0


def test_every_histogram_is_placed_exactly():
    rnd = random.Random(6)
    for size in (7, 64, 2048):
        for _ in range(30):
            hist = {rnd.randrange(1, size + 1): rnd.choice([1, 2, 50, 9999]) for _ in range(rnd.randrange(1, 60))}
            placed = defaultdict(int)
            for count, pattern in packing.shortest_pack_first(hist, size):
                assert sum(a * k for a, k in pattern) <= size
                for a, k in pattern:
                    placed[a] += count * k
            assert dict(placed) == hist


def test_word_hashes_do_not_depend_on_the_way(monkeypatch):
    from presswork.llm import common

    rnd = random.Random(4)
    raw = [" ".join("".join(rnd.choices("abé𝒳z", k=rnd.randrange(1, 30))) for _ in range(rnd.randrange(40))).encode() for _ in range(30)] + [b"", b" ", b"abc"]
    w = common.Words(raw)
    fast = [common.word_hashes(w, second) for second in (False, True)]
    alone = [common.word_hashes(common.Words([x]), False) for x in raw]
    assert np.concatenate(alone).tolist() == fast[0].tolist()
    monkeypatch.setattr(common, "PREFIX_BYTES", 0)
    assert all((common.word_hashes(w, k == 1) == x).all() for k, x in enumerate(fast)) and (fast[0] != fast[1]).all()
