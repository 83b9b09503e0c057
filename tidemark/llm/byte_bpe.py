"""Byte-level BPE encoding and decoding by a vocabulary of ranks.

A text is split into pre-tokens by array operations on its code points, then two
tiers give their ids. A minimal perfect hash over the vocabulary answers for all
pre-tokens at once which are tokens as they stand: one displacement, one slot, and a
comparison of the bytes. Each different pre-token that isn't one is merged on its
own: its bytes are a linked list, and a heap of (rank, place) yields the next pair to
merge. Short ones are remembered by a worker, `CACHE` of them at most.

Which characters are letters, numbers or white space is asked of the library whose
results are to be equalled, so that no version of Unicode is fixed here.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from tidemark.llm._spark import table

#: Characters that are split at once, about; pre-tokens that a worker remembers, and their bytes at most.
CHUNK, CACHE, CACHE_BYTES = 1 << 19, 500_000, 48
#: The classes of the split pattern, and its contractions after the apostrophe.
OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3
SHORT, LONG = "stmd", ("re", "ve", "ll")

_U = np.uint64
_ROOT, _GOLD = 0x9E3779B97F4A7C15, _U(0xBF58476D1CE4E5B9)
#: Between a letter or number and a character that is neither, the pattern always splits.
_SAFE = re.compile(r"(?<=[^\W_])[^\w]")

_ENCODED = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.list_(pa.int32()))])
_ENCODED_SQL = "doc_id long, n_tokens long, ids array<int>"


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> _U(29))) * _U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> _U(32))


def _scaled(h: np.ndarray, n: int) -> np.ndarray:
    """From 32 bits of h to 0 .. n - 1."""
    return (((h >> _U(32)) * _U(n)) >> _U(32)).astype(np.int64)


def _ramp(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each of the lengths."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)


class PerfectHash:
    """Byte strings to their numbers, by hash and displace: n slots for n keys, all of them filled."""

    def __init__(self, keys: list[bytes]):
        self.n, self.lengths = len(keys), np.array([len(k) for k in keys], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.blob = np.frombuffer(b"".join(keys), np.uint8)
        self.powers, self.inverse = np.ones(1, np.uint64), np.ones(1, np.uint64)
        hashes = self.hashes(self.blob, self.starts, self.lengths)
        if len(np.unique(hashes)) < self.n:
            raise ValueError("two keys are equal or share a hash")
        self.buckets = max(1, self.n // 4)
        at = _scaled(hashes << _U(7), self.buckets)
        order = np.argsort(at, kind="stable")
        sizes = np.bincount(at, minlength=self.buckets)
        ends = np.cumsum(sizes)
        self.displace, self.keys = np.zeros(self.buckets, np.int64), np.full(self.n, -1, np.int64)
        for b in np.argsort(-sizes, kind="stable"):
            mine = order[ends[b] - sizes[b] : ends[b]]
            if len(mine) < 2:
                break
            first = 1
            while True:  # 256 displacements at once, the first that finds free places is taken
                tried = np.arange(first, first + 256, dtype=np.uint64)
                slots = _scaled(_mixed(hashes[mine][None, :] ^ (tried[:, None] * _GOLD)), self.n)
                row = np.sort(slots, axis=1)
                good = (self.keys[slots] < 0).all(axis=1) & (np.diff(row, axis=1) > 0).all(axis=1)
                if good.any():
                    k = int(np.argmax(good))
                    self.displace[b], self.keys[slots[k]] = first + k, mine
                    break
                first += 256
        free = np.flatnonzero(self.keys < 0)
        alone = np.flatnonzero(sizes == 1)
        self.displace[alone], self.keys[free] = -1 - free, order[ends[alone] - 1]
        self.hashed = hashes

    def hashes(self, blob: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """64 bits of each stretch of a blob, from one running sum over all of it."""
        while (n := len(self.powers)) <= len(blob):
            self.powers = np.concatenate([self.powers, self.powers * _U(pow(_ROOT, n, 1 << 64))])
            self.inverse = np.concatenate([self.inverse, self.inverse * _U(pow(_ROOT, -n, 1 << 64))])
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((blob.astype(np.uint64) + _U(1)) * self.powers[: len(blob)])])
        return _mixed((sums[starts + lengths] - sums[starts]) * self.inverse[starts] + lengths.astype(np.uint64))

    def find(self, blob: np.ndarray, starts: np.ndarray, lengths: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """The number of each stretch of a blob among the keys, -1 if it is none of them."""
        step = self.displace[_scaled(hashes << _U(7), self.buckets)]
        slots = np.where(step < 0, -1 - step, _scaled(_mixed(hashes ^ (step.astype(np.uint64) * _GOLD)), self.n))
        key = self.keys[slots]
        likely = np.flatnonzero((self.hashed[key] == hashes) & (self.lengths[key] == lengths))
        out = np.full(len(starts), -1, np.int64)
        sure = likely[same(blob, starts[likely], self.blob, self.starts[key[likely]], lengths[likely])]
        out[sure] = key[sure]
        return out


def same(a: np.ndarray, a_starts: np.ndarray, b: np.ndarray, b_starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Whether stretches of two blobs, none of them empty, hold the same bytes."""
    if not len(lengths):
        return np.zeros(0, bool)
    equal = a[_ramp(a_starts, lengths)] == b[_ramp(b_starts, lengths)]
    return np.logical_and.reduceat(equal, np.cumsum(lengths) - lengths)


def classes() -> np.ndarray:
    """The class of each code point, as the library's own engine for patterns sees it."""
    import tiktoken

    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    out = np.zeros(0x110000, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (SPACE, r"\s")):
        found = tiktoken.Encoding("class", pat_str=pattern, mergeable_ranks={bytes([b]): b for b in range(256)}, special_tokens={}).encode_ordinary(every)
        out[np.frombuffer(bytes(found).decode().encode("utf-32-le"), np.uint32)] = kind
    return out


def split(points: np.ndarray, kinds: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Where the pre-tokens of texts begin, which stand one after the other from `firsts`.

    Runs of one class are pre-tokens, with these exceptions: the last of several white
    spaces before anything else stands apart, and joins what follows if it is a plain
    space; a contraction ends a pre-token inside a run of letters.
    """
    n = len(points)
    kind = kinds[points]
    begins = np.ones(n + 1, bool)
    begins[1:n] = kind[1:] != kind[:-1]
    begins[firsts] = True
    is_first = np.zeros(n + 1, bool)
    is_first[firsts] = is_first[n] = True
    # the last white space of a run that something else of the same text follows
    last = np.flatnonzero((kind == SPACE) & begins[1:] & ~is_first[1:])
    begins[last] = True
    begins[last[points[last] == 0x20] + 1] = False
    # an apostrophe that begins a pre-token, before one of the endings
    quote = np.flatnonzero((points == 0x27) & begins[:n])
    padded = np.concatenate([points, np.zeros(2, points.dtype)])
    one, two = padded[quote + 1], padded[quote + 2]
    inside = ~is_first[quote + 1]
    short = inside & np.isin(one, [ord(c) for c in SHORT])
    long = np.zeros(len(quote), bool)
    for a, b in LONG:
        long |= (one == ord(a)) & (two == ord(b))
    long &= inside & ~is_first[np.minimum(quote + 2, n)]
    begins[quote[short | long] + 1] = False
    begins[quote[short] + 2] = True
    begins[quote[long] + 3] = True
    return np.flatnonzero(begins[:n])


def read_ranks(path: str) -> dict[bytes, int]:
    """Tokens and their ranks from lines of a token in base 64 and its rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class ByteBpe:
    """Encoder by the ranks of a file."""

    def __init__(self, path: str):
        ranks = read_ranks(path)
        self.tokens = list(ranks)
        self.table = PerfectHash(self.tokens)
        self.rank = np.array([ranks[t] for t in self.tokens], np.int64)
        self.kinds = classes()
        self.bytes = [ranks[bytes([b])] for b in range(256)]
        #: (left id, right id) -> id of both together, for every way to cut a token in two tokens
        self.pairs = {ranks[t[:k]] << 32 | ranks[t[k:]]: r for t, r in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks}
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def merge(self, piece: bytes) -> list[int]:
        """The ids of one pre-token: always the pair of the least rank is merged, the first of equal ones."""
        ids, pairs = [self.bytes[b] for b in piece], self.pairs
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        best = [pairs.get(ids[k] << 32 | ids[k + 1], -1) for k in range(n - 1)]
        best.append(-1)
        heap = [r << 32 | k for k, r in enumerate(best) if r >= 0]
        heapify(heap)
        while heap:
            top = heappop(heap)
            k, r = top & 0xFFFFFFFF, top >> 32
            if best[k] != r:  # merged away, or its pair has changed
                continue
            gone = after[k]
            ids[k], ids[gone], best[gone] = r, -1, -1
            nxt = after[k] = after[gone]
            best[k] = -1
            if nxt < n:
                before[nxt] = k
                best[k] = x = pairs.get(r << 32 | ids[nxt], -1)
                if x >= 0:
                    heappush(heap, x << 32 | k)
            prev = before[k]
            if prev >= 0:
                best[prev] = x = pairs.get(ids[prev] << 32 | r, -1)
                if x >= 0:
                    heappush(heap, x << 32 | prev)
        return [i for i in ids if i >= 0]

    def missed(self, piece: bytes) -> bytes:
        """The ids of a pre-token that isn't a token, as 32-bit numbers; what was asked for lately is remembered."""
        out = self.known.get(piece)
        if out is None:
            out = self.older.get(piece)
            if out is None:
                out = np.array(self.merge(piece), np.int32).tobytes()
            if len(piece) <= CACHE_BYTES:
                if len(self.known) >= CACHE // 2:
                    self.known, self.older = {}, self.known
                self.known[piece] = out
        return out

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of some texts, and how many each has."""
        whole = "".join(texts)
        if not whole:
            return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
        points = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
        sizes = np.array([len(t) for t in texts], np.int64)
        firsts = np.cumsum(sizes) - sizes
        begins = split(points, self.kinds, firsts[sizes > 0])
        blob = np.frombuffer(whole.encode(), np.uint8)
        if len(blob) == len(points):
            edges = np.append(begins, len(blob))
        else:
            width = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
            edges = np.append((np.cumsum(width) - width)[begins], len(blob))
        starts, lengths = edges[:-1], np.diff(edges)
        hashes = self.table.hashes(blob, starts, lengths)
        found = self.table.find(blob, starts, lengths, hashes)
        out_of = np.searchsorted(begins, np.append(firsts, len(points)))

        lost = np.flatnonzero(found < 0)
        _, example, which = np.unique(hashes[lost], return_index=True, return_inverse=True)
        example = lost[example]
        differ = np.flatnonzero((lengths[lost] != lengths[example[which]]) | ~same(blob, starts[lost], blob, starts[example[which]], np.minimum(lengths[lost], lengths[example[which]])))
        # equal hashes of different bytes are pieces of their own
        which[differ] = len(example) + np.arange(len(differ))
        example = np.append(example, lost[differ])
        raw = blob.tobytes()
        pieces = [self.missed(raw[a:b]) for a, b in zip(starts[example].tolist(), (starts + lengths)[example].tolist(), strict=True)]

        counts = np.ones(len(starts), np.int64)
        if len(lost):
            each = np.array([len(p) for p in pieces], np.int64) // 4
            counts[lost] = each[which]
        ends = np.cumsum(counts)
        ids = np.empty(int(ends[-1]), np.int32)
        hit = np.flatnonzero(found >= 0)
        ids[(ends - 1)[hit]] = self.rank[found[hit]]
        if len(lost):
            flat, begin = np.frombuffer(b"".join(pieces), np.int32), np.cumsum(each) - each
            ids[_ramp((ends - counts)[lost], counts[lost])] = flat[_ramp(begin[which], each[which])]
        return ids, np.diff(np.concatenate([[0], ends])[out_of])


class Decoder:
    """Ids to bytes by the ranks of a file."""

    def __init__(self, path: str):
        ranks = read_ranks(path)
        self.tokens: list[bytes | None] = [None] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token

    def decode(self, ids: list[int]) -> bytes:
        """The bytes of ids; an id without a token is an error."""
        try:
            if ids and min(ids) < 0:
                raise IndexError
            return b"".join(map(self.tokens.__getitem__, ids))
        except (IndexError, TypeError) as error:
            raise ValueError("an id has no token") from error


_loaded: dict[tuple[type, str], ByteBpe | Decoder] = {}


def loaded(kind: type, path: str) -> ByteBpe | Decoder:
    """The encoder or decoder of a file, made once in a process."""
    if (kind, path) not in _loaded:
        _loaded[kind, path] = kind(path)
    return _loaded[kind, path]


def segments(text: str, most: int) -> Iterator[str]:
    """A text cut into parts of about `most` characters, where the pattern splits in any case."""
    at = 0
    while len(text) - at > most and (cut := _SAFE.search(text, at + most)):
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


def _encoded(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = loaded(ByteBpe, path)

        def out(docs: list, texts: list[str]) -> pa.RecordBatch:
            parts = [list(segments(t, CHUNK)) for t in texts]
            if len(texts) == 1:
                rows = [own.encode([p]) for p in parts[0]]
                ids, counts = np.concatenate([r[0] for r in rows]), np.array([sum(int(r[1][0]) for r in rows)])
            else:
                ids, counts = own.encode(texts)
            ids = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(ids, pa.int32()))
            return pa.record_batch([pa.array(docs, pa.int64()), pa.array(counts, pa.int64()), ids], schema=_ENCODED)

        docs: list = []
        texts: list[str] = []
        size = 0
        for batch in batches:
            for lo in range(0, len(batch), 64):  # few texts at once as Python strings
                part = batch.slice(lo, 64)
                for doc, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                    text = text or ""
                    if docs and size + len(text) > CHUNK:
                        yield out(docs, texts)
                        docs, texts, size = [], [], 0
                    docs.append(doc)
                    texts.append(text)
                    size += len(text)
        if docs:
            yield out(docs, texts)

    return run


def ranks_file(name: str = "byte_bpe_50k") -> str:
    """The ranks of a public vocabulary."""
    import public_tokenizers

    return public_tokenizers.path(f"{name}.tiktoken")


def encode(docs: DataFrame, ranks: str | None = None) -> DataFrame:
    """doc_id, n_tokens and ids (array of int) of each row of docs, without special tokens.

    Every row is encoded on its own, repeated rows and null ids too; a null or empty text
    has no ids, an empty table no rows. A very long text is encoded in parts, cut where
    the pattern splits in any case, and is one row again. Ties in rank go to the first
    pair. Nothing is shuffled. Other columns are not read.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(_encoded(ranks or ranks_file()), _ENCODED_SQL)


def decode(rows: DataFrame, ranks: str | None = None, ids: str = "ids") -> DataFrame:
    """rows with `decoded`, the bytes of the ids; null without ids. An id that the vocabulary lacks is an error.

    Bytes needn't be UTF-8: ids may end within a character. All columns stay, but for
    one called decoded, which is replaced.
    """
    path, kept = ranks or ranks_file(), [c for c in rows.columns if c.lower() != "decoded"]
    lists = rows.select(*kept)
    schema = StructType([*lists.schema.fields, StructField("decoded", BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = loaded(Decoder, path)
        for batch in batches:
            for lo in range(0, len(batch), 256):
                part = batch.slice(lo, 256)
                lists = part.column(part.schema.get_field_index(ids))
                out = [None if not x.is_valid else own.decode(x.values.to_pylist()) for x in lists]
                yield pa.record_batch([*part.columns, pa.array(out, pa.binary())], [*part.schema.names, "decoded"])

    return lists.mapInArrow(run, schema)


_DIGEST_SQL = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def _digests(path: str):
    """Digests of the ids in decimal and of the bytes that they decode to, of some thousand ids at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = loaded(Decoder, path)
        decimal = list(map(str, range(len(own.tokens))))
        for batch in batches:
            written, decoded = [], []
            for ids in batch.column("ids"):
                text, back, values = hashlib.sha256(), hashlib.sha256(), ids.values
                for lo in range(0, len(values), 65_536):
                    part = values.slice(lo, 65_536).to_numpy(zero_copy_only=False).tolist()
                    text.update(((" " if lo else "") + " ".join(map(decimal.__getitem__, part))).encode())
                    back.update(own.decode(part))
                written.append(text.hexdigest())
                decoded.append(back.hexdigest())
            yield pa.record_batch([batch.column("doc_id"), batch.column("n_tokens"), pa.array(written, pa.string()), pa.array(decoded, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents")).mapInArrow(_digests(ranks_file()), _DIGEST_SQL)
