"""Packing by power-of-two decomposition.

A document's tokens are cut into pieces whose lengths are powers of two, the longest
first: as many full sequences as fit, then one piece for each bit of what is left.
Each piece is a sequence of its own in the bucket of its length, so no sequence
crosses documents, and none is padded.

Token ids are those of a byte-level BPE file of the tokenizers library. A space
between two characters that aren't white space always begins a new pre-token, so
words are encoded on their own and common ones are remembered (`CACHE` words of at
most `CACHE_CHARS`); the same vocabulary as ranks encodes the others.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm._spark import table

CACHE, CACHE_CHARS = 300_000, 40
_TWO_SPACES = re.compile(r"\s\s")

_PIECE = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64())])
_PIECE_SQL = "doc_id long, start long, length long, ids binary, doc_tokens long"


def piece_lengths(n: int, longest: int) -> list[int]:
    """n as full sequences and falling powers of two."""
    rest = n % longest
    return [longest] * (n // longest) + [1 << k for k in range(longest.bit_length() - 2, -1, -1) if rest >> k & 1]


def encoder(tokenizer: str, ranks: str, pattern: str) -> Callable[[str], bytes]:
    """Text to little-endian 32-bit ids, as the tokenizer file's own encode(add_special_tokens=False) gives them."""
    import tiktoken
    from tokenizers import Tokenizer

    with open(ranks, "rb") as f:
        vocabulary = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    encode = tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=vocabulary, special_tokens={}).encode_ordinary
    slow = Tokenizer.from_file(tokenizer)
    special = [t.content for t in slow.get_added_tokens_decoder().values()]
    known: dict[str, bytes] = {}

    def ids(piece: str) -> bytes:
        out = np.array(encode(piece), "<u4").tobytes()
        if len(known) < CACHE and len(piece) <= CACHE_CHARS:
            known[piece] = out
        return out

    def run(text: str) -> bytes:
        if any(s in text for s in special):  # the tokenizer reads these as single tokens
            return np.array(slow.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        if _TWO_SPACES.search(text):
            return np.array(encode(text), "<u4").tobytes()
        first, *rest = text.split(" ")
        out = [known.get(first) or ids(first)] if first else []
        get = known.get
        for word in rest:
            word = " " + word
            out.append(get(word) or ids(word))
        return b"".join(out)

    return run


_encoders: dict[tuple, Callable[[str], bytes]] = {}


def _cut(files: tuple[str, str, str], end: int, longest: int):
    tail = np.array([end], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if files not in _encoders:
            _encoders[files] = encoder(*files)
        encode = _encoders[files]
        rows: list[list] = [[] for _ in _PIECE]
        size = 0
        for batch in batches:
            for lo in range(0, len(batch), 64):  # few texts at once as Python strings
                part = batch.slice(lo, 64)
                for doc, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                    ids = encode(text or "") + tail
                    at, n = 0, len(ids) // 4
                    for length in piece_lengths(n, longest):
                        for column, value in zip(rows, (doc, at, length, ids[4 * at : 4 * (at + length)], n), strict=True):
                            column.append(value)
                        at += length
                    size += n
                if size > 2_000_000:
                    yield pa.record_batch([pa.array(c, f.type) for c, f in zip(rows, _PIECE, strict=True)], schema=_PIECE)
                    rows, size = [[] for _ in _PIECE], 0
        if rows[0]:
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(rows, _PIECE, strict=True)], schema=_PIECE)

    return run


def tokenizer_files(name: str = "byte_bpe_50k") -> tuple[str, str, str]:
    """(tokenizer file, ranks file, split pattern) of a public byte-level BPE."""
    import public_tokenizers

    return public_tokenizers.path(f"{name}.json"), public_tokenizers.path(f"{name}.tiktoken"), public_tokenizers.PATTERN


def pack(docs: DataFrame, longest: int = 1024, end: int = 0, files: tuple[str, str, str] | None = None) -> DataFrame:
    """doc_id, start, length, ids (little-endian 32-bit), doc_tokens, bucket, sequence_id and offset for each piece.

    Every row of docs is packed on its own, repeated rows and null ids too; a null or
    empty text is its end token alone, and an empty table gives no pieces. A very long
    text is encoded whole, in one task. A sequence holds one piece, from offset 0, and
    `bucket` is the logarithm of its length: `batches` and `write_buckets` bring equal
    lengths together. Sequence numbers grow in the order of the table's partitions.
    Nothing is shuffled. Other columns are not read.
    """
    if longest < 1 or longest & (longest - 1):
        raise ValueError("longest must be a power of two")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    pieces = texts.mapInArrow(_cut(files or tokenizer_files(), end, longest), _PIECE_SQL)
    return pieces.withColumns({"bucket": F.log2("length").cast("int"), "sequence_id": F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})


def sequences(pieces: DataFrame) -> DataFrame:
    """sequence_id, bucket and tokens (array of int) of each sequence."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens = [np.frombuffer(x, "<u4").astype(np.int32) for x in batch.column("ids").to_pylist()]
            yield pa.record_batch([batch.column("sequence_id"), batch.column("bucket"), pa.array(tokens, pa.list_(pa.int32()))], ["sequence_id", "bucket", "tokens"])

    return pieces.select("sequence_id", "bucket", "ids").mapInArrow(unpack, "sequence_id long, bucket int, tokens array<int>")


def batches(pieces: DataFrame, tokens: int = 65_536) -> DataFrame:
    """bucket, n, sequence_ids and ids (little-endian 32-bit) of training batches of equal lengths, of about `tokens` ids each.

    Each task fills a batch for each bucket and hands it on when it is full, so it holds
    less than `tokens` ids a bucket; what is left at its end are smaller batches. Nothing
    is shuffled and nothing is padded.
    """

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[list[int], list[bytes]]] = {}

        def out(buckets: list[int]) -> pa.RecordBatch:
            parts = [(b, *held.pop(b)) for b in buckets]
            return pa.record_batch([pa.array([b for b, _, _ in parts], pa.int32()), pa.array([len(s) for _, s, _ in parts], pa.int64()), pa.array([s for _, s, _ in parts], pa.list_(pa.int64())), pa.array([b"".join(x) for _, _, x in parts], pa.binary())], ["bucket", "n", "sequence_ids", "ids"])

        for batch in rows:
            for b, sequence, ids in zip(*(batch.column(c).to_pylist() for c in ("bucket", "sequence_id", "ids")), strict=True):
                numbers, texts = held.setdefault(b, ([], []))
                numbers.append(sequence)
                texts.append(ids)
                if len(numbers) << b >= tokens:
                    yield out([b])
        if held:
            yield out(sorted(held))

    return pieces.select("bucket", "sequence_id", "ids").mapInArrow(run, "bucket int, n long, sequence_ids array<long>, ids binary")


def write_buckets(pieces: DataFrame, path: str) -> None:
    """Pieces as Parquet, one folder for each bucket of equal lengths."""
    pieces.write.mode("overwrite").partitionBy("bucket").parquet(path)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pack(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "bucket")
