"""BPE and token files against the tokenizers library; the wavelet matrix against plain arrays."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from curvemill.llm import wavelet
from curvemill.llm.bpe import BytePairs, encode_decode
from curvemill.llm.wavelet import WaveletMatrix, pack, token_files, unpack

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = ["", None, " ", "Hello, World! it's naïve <|endoftext|>x 123 45 ßü", "DON'T 's'S <|startoftext|><|ENDOFTEXT|>", "a\x1cb\x85c​d﻿", "İstanbul ΑΣ. ΟΔΟΣ ǅ ẞ", "한국 你好 😀 é H̱", "&&&% don't.,; «q» ½ ²x x² ١٢", "a" * 3000, "ab" * 2000, "l'été, d'or:it'll"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def texts():
    r = random.Random(3)
    letters = "abcdeghilnorstABC'’ \t\n\r\x0bèüßŁİΣς0123456789!?.,-_$%&|<>́ͅ가中😀\x1f "
    return ODD + ["".join(r.choice(letters) for _ in range(r.randrange(40))) for _ in range(3000)]


def test_encoder_is_the_library(library):
    pairs = BytePairs(open(PATH).read())
    for t, want in zip(texts(), library.encode_batch([t or "" for t in texts()], add_special_tokens=False), strict=True):
        ids = pairs.encode(t or "")
        assert ids.tolist() == want.ids, t
        assert pairs.decode(ids).decode() == library.decode(want.ids, skip_special_tokens=False)


def test_letters_of_newer_unicode_versions(library):
    pairs = BytePairs(open(PATH).read())
    for c in map(chr, [0x558, 0x88F, 0x1C89, 0x208F, 0x209D, 0xA7CB, 0xA7DC, 0x10940, 0x10D50, 0x323B0, 0xE000, 0x10FFFF]):
        for t in (c, f"h{c}e", f"<|endoftext|>{c}x", f"{c}1 {c}!{c}", f"é{c}{c}ß"):
            assert pairs.encode(t).tolist() == library.encode(t, add_special_tokens=False).ids, t


def test_digests(spark, library):
    rows = [(i, t, "x") for i, t in enumerate(texts()[:60])]
    got = {r[0]: tuple(r)[1:] for r in encode_decode(spark.createDataFrame(rows, "doc_id long, text string, n_tokens string"), PATH).collect()}
    for i, t, _ in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        assert got[i] == (len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False)))
    assert encode_decode(spark.createDataFrame([], "doc_id long, text string"), PATH).collect() == []


@pytest.mark.parametrize("shard", [1, 7, 1_000_000])
def test_token_files(spark, library, monkeypatch, shard):
    rows = [(i * 3 % 101, t, i) for i, t in enumerate(texts()[:101])] + [(5, "again", 0), (5, "again", 0)]
    monkeypatch.setattr(wavelet.write_shards, "__defaults__", (1, shard))
    got = sorted((tuple(r) for r in token_files(spark.createDataFrame(rows, "doc_id long, text string, start long"), PATH).collect()), key=lambda r: r[1])
    at = 0
    want = sorted((d, tuple([*library.encode(t or "", add_special_tokens=False).ids, 1])) for d, t, _ in rows)
    for (doc_id, start, n, crc), (d, ids) in zip(got, sorted(want, key=lambda w: w[0]), strict=True):
        assert (doc_id, start) == (d, at)
        if d != 5:
            assert (n, crc) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += n
    assert token_files(spark.createDataFrame([], "doc_id long, text string"), PATH).collect() == []


#: Each letter below U+0300 alone, before letters, after letters and before a mark; three of them have a lower case beyond U+0300.
LATIN = [t for c in map(chr, range(128, 0x300)) for t in (c, c + "bc", "Ab" + c, c + c + "!")]


def test_letters_with_a_far_lower_case(spark, library):
    pairs, own = BytePairs(open(PATH).read()), wavelet._Library(open(PATH).read())
    for t in LATIN:
        want = library.encode(t, add_special_tokens=False).ids
        assert pairs.encode(t).tolist() == want, t
        assert np.frombuffer(own.ids(t), own.kind).tolist() == want, t
    rows = list(enumerate(["\u023abc", "\u023e", "x \u0130stanbul, \u023e\u023a."]))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = {i: library.encode(t, add_special_tokens=False).ids for i, t in rows}
    digests = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"]) for r in encode_decode(docs, PATH).collect()}
    assert digests == {i: (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()) for i, ids in want.items()}
    files = {r["doc_id"]: (r["n_tokens"], r["ids_crc32"]) for r in token_files(docs, PATH).collect()}
    assert files == {i: (len(ids) + 1, zlib.crc32(np.array([*ids, 1], "<u4").tobytes())) for i, ids in want.items()}


def test_the_word_path_of_token_files_is_the_library(library):
    own = wavelet._Library(open(PATH).read())
    for t, want in zip(texts(), library.encode_batch([t or "" for t in texts()], add_special_tokens=False), strict=True):
        assert np.frombuffer(own.ids(t or ""), own.kind).tolist() == want.ids, t


def test_queries_read_only_the_blocks_they_need(tmp_path, monkeypatch):
    monkeypatch.setattr(wavelet, "BLOCK", 512)
    a = np.random.default_rng(0).integers(0, 49_000, 60_000).astype("<u2")
    wavelet.save(f"{tmp_path}/a.wm", pack([1], [len(a)], a, 16))
    shard = wavelet.Shard.open(f"{tmp_path}/a.wm")
    seen, read = [], shard.read
    shard.read = lambda begin, n: seen.append(n) or read(begin, n)
    assert shard.matrix.access(31_234) == a[31_234] and len(seen) <= 16
    assert shard.matrix.count(int(a[7])) == (a == a[7]).sum() and len(seen) <= 16 + 32
    assert shard.matrix.select(int(a[7]), 0) == np.flatnonzero(a == a[7])[0] and sum(seen) < len(a) / 4
    broken = bytearray(pack([1], [3], np.array([5, 6, 5], "<u2"), 16))
    with pytest.raises(ValueError):
        unpack(bytes(broken[:-1]))


def test_rows_without_ids(spark, library):
    rows = [(None, "no id"), (3, None), (None, "again"), (2, "z " * 50_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(tuple(r) for r in encode_decode(df, PATH).select("n_tokens").collect())
    assert got == sorted((len(library.encode(t or "", add_special_tokens=False).ids),) for _, t in rows)
    files = sorted(tuple(r) for r in token_files(df, PATH).select("start", "doc_id", "n_tokens").collect())
    assert [r[1] for r in files] == [None, None, 2, 3] and [r[0] for r in files] == np.cumsum([0, *(r[2] for r in files[:-1])]).tolist()


@pytest.mark.parametrize("block", [8, 512, 1 << 16])
@pytest.mark.parametrize("n", [0, 1, 511, 512, 513, 4000])
def test_wavelet_matrix(n, block, monkeypatch):
    monkeypatch.setattr(wavelet, "BLOCK", block)
    a = np.random.default_rng(n).zipf(1.3, n).clip(0, 49_000).astype("<u2")
    ids, lengths, m = unpack(pack([None, 4], [n, 0], a, 16))
    assert ids == [None, 4] and lengths.tolist() == [n, 0] and (m.all() == a).all()
    assert [m.access(i) for i in range(0, n, 37)] == a[::37].tolist()
    for c in (1, 2, 48_000):
        assert m.count(c) == (a == c).sum() and m.occurrences(c) == np.flatnonzero(a == c).tolist()
        assert m.count(c, n // 3, n // 2) == (a[n // 3 : n // 2] == c).sum()
    with pytest.raises(IndexError):
        m.select(3, n + 1)
    with pytest.raises(ValueError):
        unpack(b"nothing of the kind")


def test_wide_ids_take_more_planes():
    a = np.array([70_000, 3, 70_000], "<u4")
    assert WaveletMatrix.of(a, 17).all().tolist() == a.tolist()


def test_words_in_any_case_are_known_once(library):
    own = wavelet._Library(open(PATH).read())
    own.ids("The the THE Été été")
    assert sorted(own.known) == ["the", "été"]
    # a letter beyond U+00FF or a special token's sign anywhere, and the text stays: h and U+0331 compose, H and U+0331 don't
    for t in ["H̱ The", "ẖ The", "<|endoftext|> The", "<|ENDOFTEXT|> The", "İ THE", "Á á", "ÀÞß µ×Ø ÿ \xaaZ\xba ¼É", *LATIN]:
        assert np.frombuffer(own.ids(t), own.kind).tolist() == library.encode(t, add_special_tokens=False).ids, t
