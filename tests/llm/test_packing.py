import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidemark.llm import packing

SLOW = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
FAST = packing.encoder(*packing.tokenizer_files())


def slow(text):
    return SLOW.encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["a", " ", "  ", "\n", "\t", "é", "word", "'s", "12", "!!", " ", "\x85", "x.\ny", "<|endoftext|>", "漢", "́", " ", "🙂"]), max_size=14).map("".join))
def test_ids_are_the_tokenizers(text):
    assert np.frombuffer(FAST(text), "<u4").tolist() == slow(text)


@pytest.mark.parametrize("n", [0, 1, 2, 1023, 1024, 1025, 5000])
def test_lengths(n):
    parts = packing.piece_lengths(n, 1024)
    assert sum(parts) == n and all(p & (p - 1) == 0 and p <= 1024 for p in parts)
    assert sorted(parts, reverse=True) == parts and len(set(parts) - {1024}) == len([p for p in parts if p < 1024])


def test_round_trip(spark):
    rows = [(1, "Hello wörld. " * 700), (2, None), (3, ""), (4, "a  b"), (4, "a  b"), (None, "x <|endoftext|> y"), (5, "tail")]
    docs = spark.createDataFrame([(i, t, 9) for i, t in rows], "doc_id long, text string, length int")
    got = packing.pack(docs).collect()
    assert len({r.sequence_id for r in got}) == len(got) and {r.offset for r in got} == {0}
    want = sorted(((i, slow(t or "") + [0]) for i, t in rows), key=str)
    whole = {}
    for r in sorted(got, key=lambda r: (r.sequence_id)):
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert len(ids) == r.length == 1 << r.bucket <= 1024
        if r.start == 0:
            whole[r.sequence_id] = (r.doc_id, current := [])
        assert r.start == len(current)
        current += ids
        assert r.doc_tokens >= len(current)
    assert sorted(whole.values(), key=str) == want
    assert sorted(len(t) for t in (s.tokens for s in packing.sequences(packing.pack(docs)).collect())) == sorted(r.length for r in got)


def test_query_columns(spark, tmp_path):
    spark.createDataFrame([(7, "one two three")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    rows = packing.op3_packing(spark, str(tmp_path)).collect()
    ids = np.array(slow("one two three") + [0], "<u4")
    assert [(r.start, r.length, r.ids_crc32) for r in rows] == [(0, 4, zlib.crc32(ids.tobytes()))]


def test_empty_table(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_equal_lengths_come_together(spark, tmp_path):
    docs = spark.createDataFrame([(k, f"word{k} and more " * (k % 90)) for k in range(200)], "doc_id long, text string")
    pieces = packing.pack(docs, longest=64).cache()
    want = sorted((r.sequence_id, r.bucket, bytes(r.ids)) for r in pieces.collect())
    got = packing.batches(pieces, 256).collect()
    rows = []
    for r in got:
        size = 4 << r.bucket
        assert len(r.ids) == r.n * size and len(r.sequence_ids) == r.n <= max(1, 256 >> r.bucket)
        rows += [(s, r.bucket, bytes(r.ids[k * size : (k + 1) * size])) for k, s in enumerate(r.sequence_ids)]
    assert sorted(rows) == want
    packing.write_buckets(pieces, str(tmp_path / "b"))
    back = spark.read.parquet(str(tmp_path / "b"))
    assert sorted((r.sequence_id, r.bucket, bytes(r.ids)) for r in back.collect()) == want


def test_query_over_all_rows_matches_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    want = []
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        ids, at = slow(r.text or "") + [0], 0
        for n in packing.piece_lengths(len(ids), 1024):
            want.append((r.doc_id, at, n, zlib.crc32(np.array(ids[at : at + n], "<u4").tobytes()), len(ids), n.bit_length() - 1))
            at += n
    got = packing.op3_packing(spark, sf).collect()
    assert sorted((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens, r.bucket) for r in got) == sorted(want)
    assert len({r.sequence_id for r in got}) == len(got) and {r.offset for r in got} == {0}


def test_very_long_text(spark):
    got = packing.pack(spark.createDataFrame([(1, "word " * 2_000_000 + "x" * 300_000)], "doc_id long, text string")).agg({"length": "sum", "doc_tokens": "max"}).first()
    assert got[0] == got[1] > 2_000_000
