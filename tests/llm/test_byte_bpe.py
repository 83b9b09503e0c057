import base64
import hashlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import byte_bpe as B

PATH = B.ranks_file()
with open(PATH, "rb") as f:
    RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
LIBRARY = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
BPE, DECODER = B.ByteBpe(PATH), B.Decoder(PATH)
PARTS = ["a", " ", "  ", "\n", "\t", "é", "word", "'s", "'", "'re", "'ll", "'l", "re", "12", "!!", "\x85", "\x1c", "x.\ny", "<|endoftext|>", "漢", "́", "　", "🙂", "'S", "''s", " 's", "3's", "²", "Ⅷ", "zqxj", "thlyth"]


def split_up(ids, counts):
    return np.split(ids, np.cumsum(counts)[:-1])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PARTS), max_size=14).map("".join), min_size=1, max_size=6))
def test_ids_are_the_librarys(texts):
    for text, ids in zip(texts, split_up(*BPE.encode(texts)), strict=True):
        assert ids.tolist() == LIBRARY.encode_ordinary(text)
        assert DECODER.decode(ids.tolist()) == text.encode()


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(max_size=30), min_size=1, max_size=4))
def test_any_text(texts):
    for text, ids in zip(texts, split_up(*BPE.encode(texts)), strict=True):
        assert ids.tolist() == LIBRARY.encode_ordinary(text)


def test_every_character_of_the_planes_in_use():
    own = BPE
    texts = ["".join(f"a{chr(c)}1{chr(c)} {chr(c)}{chr(c)}'s" for c in range(lo, lo + 512) if not 0xD800 <= c < 0xE000) for lo in [*range(0, 0x33480, 512), *range(0xE0000, 0xE0200, 512)]]
    for text, ids in zip(texts, split_up(*own.encode(texts)), strict=True):
        assert ids.tolist() == LIBRARY.encode_ordinary(text)


def test_perfect_hash():
    own = BPE.table
    assert sorted(own.keys.tolist()) == list(range(len(RANKS)))  # minimal: every slot holds one key
    keys = [*list(RANKS)[::7], b"zqxjv", b"\xff\xfe\xfd", b" nottherewhole"]
    blob = np.frombuffer(b"".join(keys), np.uint8)
    lengths = np.array([len(k) for k in keys])
    starts = np.cumsum(lengths) - lengths
    found = own.find(blob, starts, lengths, own.hashes(blob, starts, lengths)).tolist()
    names = list(RANKS)
    assert [names[k] if k >= 0 else None for k in found] == [k if k in RANKS else None for k in keys]
    with pytest.raises(ValueError):
        B.PerfectHash([b"a", b"b", b"a"])


def test_equal_hashes_of_different_pieces(monkeypatch):
    own = B.ByteBpe(PATH)
    real = own.table.hashes
    # misses with a hash that they share are told apart by their bytes; the vocabulary's hashes stay
    monkeypatch.setattr(own.table, "hashes", lambda *a: np.where(np.isin(h := real(*a), own.table.hashed), h, np.uint64(7)))
    texts = ["qzxw zqxjv qzxw", "zqxjv qqqz zqxjvv qzxw"]
    for text, ids in zip(texts, split_up(*own.encode(texts)), strict=True):
        assert ids.tolist() == LIBRARY.encode_ordinary(text)


@pytest.mark.parametrize("piece", ["x" * 3000, "ab" * 999, "aaaaab" * 300, "é" * 501])
def test_ties_and_long_pieces(piece):
    assert BPE.merge(piece.encode()) == LIBRARY.encode_ordinary(piece)


def test_segments_are_cut_where_the_pattern_splits():
    text = "Don't 'll we're 12² x\n\n  y" * 50 + "漢字、" * 60
    for most in (1, 2, 3, 7, 20):
        parts = list(B.segments(text, most))
        assert "".join(parts) == text and len(parts) > 20
        assert sum((LIBRARY.encode_ordinary(p) for p in parts), []) == LIBRARY.encode_ordinary(text)


def test_nulls_repeats_and_other_columns(spark):
    rows = [(1, "Hello wörld. " * 70, 1), (2, None, 2), (3, "", 3), (4, "a  b", 4), (4, "a  b", 4), (None, "x <|endoftext|> y", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, Decoded int")
    got = B.encode(docs).collect()
    assert sorted(((r.doc_id, list(r.ids)) for r in got), key=str) == sorted(((i, LIBRARY.encode_ordinary(t or "")) for i, t, _ in rows), key=str)
    assert all(r.n_tokens == len(r.ids) for r in got)
    back = B.decode(B.encode(docs)).collect()
    assert sorted(bytes(r.decoded).decode() for r in back) == sorted(t or "" for _, t, _ in rows)
    assert B.encode(docs.limit(0)).collect() == []


def test_decode_keeps_columns_and_refuses_unknown_ids(spark):
    rows = spark.createDataFrame([(1, [64, 65], b"mine"), (2, None, None), (3, [], None)], "k int, ids array<int>, DECODED binary")
    got = {r.k: r.decoded for r in B.decode(rows).collect()}
    assert {k: v if v is None else bytes(v) for k, v in got.items()} == {1: DECODER.decode([64, 65]), 2: None, 3: b""}
    for unknown in (60_000, -1):
        with pytest.raises(ValueError):
            DECODER.decode([unknown])


def test_remembered_pieces_are_bounded(monkeypatch):
    monkeypatch.setattr(B, "CACHE", 20)
    own, words = B.ByteBpe(PATH), [f"zq{k:x}xj" for k in range(200)]
    for _ in range(2):
        for w in words:
            ids, _ = own.encode([w])
            assert ids.tolist() == LIBRARY.encode_ordinary(w)
            assert len(own.known) + len(own.older) <= 20


def test_very_long_text(spark):
    text = "word thlyth' don't " * 300_000 + "x" * 100_000
    got = B.decode(B.encode(spark.createDataFrame([(1, text)], "doc_id long, text string"))).first()
    assert bytes(got.decoded).decode() == text and got.n_tokens == len(LIBRARY.encode_ordinary(text))


def test_query_over_all_rows_matches_the_library(spark):
    sf = "/root/testdata/sf0.001"
    want = []
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        ids = LIBRARY.encode_ordinary(r.text or "")
        want.append((r.doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()))
    got = B.op11_byte_bpe(spark, sf).collect()
    assert sorted(map(tuple, got)) == sorted(want)
