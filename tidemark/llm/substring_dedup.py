"""Substring dedup: windows of words that already started earlier are cut out of the texts.

Level-wise doubling. For windows of n words the levels are ..., n/4, n/2, n. At a
level under n, each window still in play is represented by the least of the hashes
of its level-long parts (its anchor: equal windows have equal anchors, and
neighbouring windows mostly share one, so at five words of twenty about one part in
eight is looked up). Only
windows whose anchor occurs twice go on to twice the length, until the full windows
that are left are looked up themselves, or none is left. No level loses a repeat.
Levels under n go by one hash of 64 bits, as a chance collision there only keeps a
window in play; full windows agree in two, 128 bits, before a word goes.

A lookup never gathers the occurrences of a hash. Each map task sorts the hashes of
a bounded chunk, settles what repeats inside the chunk, and sends one entry for each
distinct hash to the hash's bucket, packed in binary columns. A window that occurs in
a third of all documents thus costs its bucket one entry a chunk. The answers
(document, position) return packed by document bucket and meet the texts in a
cogroup; each level stops there if no candidate is left. The texts are dealt once, as a
table in buckets, which all levels read without another shuffle. The buckets' number follows
the bytes of the texts themselves, so that a task holds about `BUCKET_BYTES` of them
whatever their sum and however well the table is compressed.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import _words
from tidemark.llm._spark import cut, partitions, shared_folder, spread, spread_array, table

#: Entries that a map task gathers before it settles and sends them.
CHUNK = 4_000_000
#: Texts of a document bucket, about.
BUCKET_BYTES = 64 << 20
#: Rows without an id get ids of their own from here on, by a hash of their text; other ids are above.
NAMELESS, NAMELESS_IDS = -(1 << 63), 1 << 48

_ENTRY = pa.schema([("bucket", pa.int32()), ("hashes", pa.binary()), ("more", pa.binary()), ("ids", pa.binary()), ("places", pa.binary()), ("many", pa.binary())])
_ENTRY_SQL = "bucket int, hashes binary, more binary, ids binary, places binary, many binary"
_FLAG = pa.schema([("_db", pa.int32()), ("ids", pa.binary()), ("places", pa.binary())])
_FLAG_SQL = "_db int, ids binary, places binary"


def levels(n: int, least: int = 5) -> list[int]:
    """The window lengths that are looked up: n, and its halves while they have `least` words."""
    out = [n]
    while out[0] % 2 == 0 and out[0] // 2 >= least:
        out.insert(0, out[0] // 2)
    return out


# ---- packing


def _pack(values: np.ndarray) -> bytes:
    """Integers as their least and differences from it, in as few bytes each as hold them all."""
    least = int(values.min()) if len(values) else 0
    rest = values.astype(np.int64).view(np.uint64) - np.int64(least).view(np.uint64)
    most = int(rest.max()) if len(values) else 0
    size = 1 if most < 1 << 8 else 2 if most < 1 << 16 else 4 if most < 1 << 32 else 8
    return bytes([size]) + np.int64(least).tobytes() + rest.astype(f"<u{size}").tobytes()


def _unpack(blob: bytes) -> np.ndarray:
    size, least = blob[0], np.frombuffer(blob, np.int64, 1, 1)[0]
    return (np.frombuffer(blob, f"<u{size}", -1, 9).astype(np.uint64) + least.view(np.uint64)).view(np.int64)


def _by_bucket(bucket: np.ndarray, *columns: np.ndarray) -> Iterator[tuple[int, list[np.ndarray]]]:
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    columns = [c[order] for c in columns]
    cuts = np.flatnonzero(np.diff(bucket)) + 1
    for lo, hi in zip([0, *cuts], [*cuts, len(bucket)], strict=True):
        if hi > lo:
            yield int(bucket[lo]), [c[lo:hi] for c in columns]


def _groups(h: np.ndarray, more: np.ndarray | None, ids: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order by hash, id and place; first of its hash, in that order; group number, in that order); more: the hashes' second halves, if any."""
    order = np.lexsort((places, ids, h) if more is None else (places, ids, more, h))
    h = h[order]
    first = np.ones(len(h), bool)
    first[1:] = h[1:] != h[:-1]
    if more is not None:
        more = more[order]
        first[1:] |= more[1:] != more[:-1]
    return order, first, np.cumsum(first) - 1


# ---- map side


class _Sender:
    """Gathers (hash, id, place) and yields what a chunk settles and what it must ask."""

    def __init__(self, n_buckets: int, n_doc_buckets: int, final: bool):
        self.n_buckets, self.n_doc_buckets, self.final = n_buckets, n_doc_buckets, final
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, h: np.ndarray, more: np.ndarray | None, ids: np.ndarray, places: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(h):
            self.parts.append((h, ids, places) if more is None else (h, ids, places, more))
            self.size += len(h)
        if self.size >= CHUNK:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.parts:
            return
        h, ids, places, *more = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        self.parts, self.size = [], 0
        order, first, group = _groups(h, more[0] if more else None, ids, places)
        h, ids, places, *more = (x[order] for x in (h, ids, places, *more))
        sizes = np.bincount(group)
        if self.final:
            start = np.flatnonzero(first)[group]
            known = (ids != ids[start]) | (places != places[start])
        else:
            known = sizes[group] > 1
        rows: list[list] = [[] for _ in _ENTRY]
        bucket = (h[first] >> np.uint64(20)) % np.uint64(self.n_buckets)
        for b, (x, i, p, m, *y) in _by_bucket(bucket.astype(np.int64), h[first], ids[first], places[first], (sizes > 1).astype(np.uint8), *(z[first] for z in more)):
            by_id = np.lexsort((p, i))
            for column, value in zip(rows, (b, x[by_id].tobytes(), y[0][by_id].tobytes() if y else None, _pack(i[by_id]), _pack(p[by_id]), m[by_id].tobytes() if m.any() else b""), strict=True):
                column.append(value)
        for b, (i, p) in _by_bucket(spread_array(ids[known], self.n_doc_buckets), ids[known], places[known]):
            by_id = np.lexsort((p, i))
            for column, value in zip(rows, (b, None, None, _pack(i[by_id]), _pack(p[by_id]), None), strict=True):
                column.append(value)
        for lo in range(0, len(rows[0]), 2000):
            yield pa.record_batch([pa.array(c[lo : lo + 2000], f.type) for c, f in zip(rows, _ENTRY, strict=True)], schema=_ENTRY)


def _candidates(w: _words.Words, n: int, level: int, survives: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """(word, hash) to look up at a level; survives: windows still in play by first word, None for all."""
    alive = w.room() >= n if len(w.doc) else np.zeros(0, bool)
    if survives is not None:
        alive &= survives
    if not alive.any():
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    parts = _words.rolling(w.hash, level)
    if level == n:
        at = np.flatnonzero(alive)
        return at, parts[at]
    least = _least_parts(parts, n, level)
    best = np.where(alive, least, np.uint64(0))
    reach = n - level
    wanted = _words.sliding(np.maximum, np.append(np.zeros(reach, np.uint64), best), reach + 1, 0)[: len(parts)]
    at = np.flatnonzero((wanted == parts) & (w.room() >= level))
    return at, parts[at]


def _second_halves(w: _words.Words, at: np.ndarray, n: int, level: int) -> np.ndarray | None:
    return _words.rolling(w.hashes(1), n, 1)[at] if level == n else None


def _least_parts(parts: np.ndarray, n: int, level: int) -> np.ndarray:
    return _words.sliding(np.minimum, parts, n - level + 1, np.iinfo(np.uint64).max)


def _survivors(w: _words.Words, n: int, level: int, flagged: np.ndarray) -> np.ndarray:
    """Windows, by first word, whose anchor at this level occurs elsewhere too; flagged: the anchors' words."""
    parts = _words.rolling(w.hash, level)
    known = np.full(len(parts), np.iinfo(np.uint64).max, np.uint64)
    known[flagged] = parts[flagged]
    return (_least_parts(parts, n, level) == _words.sliding(np.minimum, known, n - level + 1, np.iinfo(np.uint64).max)) & (w.room() >= n)


def _flagged_words(flags: pa.Table, ids: np.ndarray, w: _words.Words, lo: int, hi: int, cache: dict) -> np.ndarray:
    """Positions in w of the flagged places of documents lo to hi."""
    if "ids" not in cache:
        i = [np.zeros(0, np.int64), *(_unpack(x.as_py()) for x in flags["ids"])]
        p = [np.zeros(0, np.int64), *(_unpack(x.as_py()) for x in flags["places"])]
        i, p = np.concatenate(i), np.concatenate(p)
        order = np.argsort(i, kind="stable")
        cache["ids"], cache["places"] = i[order], p[order]
    a, b = (np.searchsorted(cache["ids"], ids[lo:hi], side) for side in ("left", "right"))
    n = b - a
    at = np.repeat(a - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(n.sum())
    place = cache["places"][at]
    doc = np.repeat(np.arange(hi - lo), n)
    ok = place < w.count[doc]
    return w.first[doc[ok]] + place[ok]


def _first_lookup(n: int, level: int, n_buckets: int, n_doc_buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sender = _Sender(n_buckets, n_doc_buckets, level == n)
        for batch in batches:
            ids = batch.column("_id").to_numpy()
            for lo, _hi, w in _words.words_of(batch.column("text"), _words.NOT_SPACE, _words.SAME):
                at, h = _candidates(w, n, level, None)
                yield from sender.add(h, _second_halves(w, at, n, level), ids[lo + w.doc[at]], at - w.first[w.doc[at]])
        yield from sender.flush()

    return run


def _next_lookup(n: int, before: int, level: int, n_buckets: int, n_doc_buckets: int):
    def run(docs: pa.Table, flags: pa.Table) -> pa.Table:
        sender, out, cache = _Sender(n_buckets, n_doc_buckets, level == n), [], {}
        ids = docs["_id"].to_numpy()
        if len(flags):
            for lo, hi, w in _words.words_of(docs["text"], _words.NOT_SPACE, _words.SAME):
                flagged = _flagged_words(flags, ids, w, lo, hi, cache)
                if len(flagged):
                    at, h = _candidates(w, n, level, _survivors(w, n, before, flagged))
                    out += sender.add(h, _second_halves(w, at, n, level), ids[lo + w.doc[at]], at - w.first[w.doc[at]])
            out += sender.flush()
        return pa.Table.from_batches(out, _ENTRY)

    return run


# ---- answers


def _answers(final: bool, n_doc_buckets: int):
    def settle(rows: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
        h = np.concatenate([np.frombuffer(r[1], np.uint64) for r in rows])
        more = np.concatenate([np.frombuffer(r[2], np.uint64) for r in rows]) if final else None
        ids, places = (np.concatenate([_unpack(r[k]) for r in rows]) for k in (3, 4))
        many = np.concatenate([np.frombuffer(r[5], np.uint8) if r[5] else np.zeros(len(r[1]) // 8, np.uint8) for r in rows])
        order, first, group = _groups(h, more, ids, places)
        ids, places = ids[order], places[order]
        if final:
            start = np.flatnonzero(first)[group]
            hit = (ids != ids[start]) | (places != places[start])
        else:
            hit = (np.bincount(group)[group] > 1) & (many[order] == 0)
        return ids[hit], places[hit]

    def send(found: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        """One row for each document bucket, however many hash buckets the task has."""
        ids, places = (np.concatenate(x) for x in zip(*found, strict=True))
        out: list[list] = [[], [], []]
        for b, (i, p) in _by_bucket(spread_array(ids, n_doc_buckets), ids, places):
            by_id = np.lexsort((p, i))
            for column, value in zip(out, (b, _pack(i[by_id]), _pack(p[by_id])), strict=True):
                column.append(value)
        if out[0]:
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(out, _FLAG, strict=True)], schema=_FLAG)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        found: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[1] is None:
                    found.append((_unpack(row[3]), _unpack(row[4])))
                    continue
                if rows and rows[0][0] != row[0]:
                    found.append(settle(rows))
                    rows = []
                rows.append(row)
            if sum(len(i) for i, _ in found) >= CHUNK:
                yield from send(found)
                found = []
        if rows:
            found.append(settle(rows))
        if found:
            yield from send(found)

    return run


# ---- the texts that are left


def _cover(starts: np.ndarray, n: int, size: int) -> np.ndarray:
    steps = np.zeros(size + n + 1, np.int64)
    np.add.at(steps, starts, 1)
    np.add.at(steps, starts + n, -1)
    return np.cumsum(steps)[:size] > 0


_RESULT_SQL = "_id long, n_words long, n_removed long, kept_text string, removed array<struct<start:long,end:long>>"
_RESULT = pa.schema([("_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_text", pa.string()), ("removed", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])


def _join_words(w: _words.Words, keep: np.ndarray) -> pa.Array:
    """Each document's kept words, joined by one space."""
    at = np.flatnonzero(keep)
    doc = w.doc[at]
    last = np.ones(len(at), bool)
    last[:-1] = doc[1:] != doc[:-1]
    size = w.end[at] - w.begin[at] + ~last
    to = np.cumsum(size)
    data = w.data[np.minimum(np.repeat(w.begin[at] - (to - size), size) + np.arange(to[-1] if len(to) else 0), max(len(w.data) - 1, 0))]
    data[to[~last] - 1] = 0x20
    ends = np.zeros(len(w.starts) + 1, np.int64)
    np.add.at(ends, doc + 1, size)
    return pa.Array.from_buffers(pa.string(), len(w.starts), [None, pa.py_buffer(np.cumsum(ends).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def _finish(n: int):
    def run(docs: pa.Table, flags: pa.Table) -> pa.Table:
        out, cache = [], {}
        ids = docs["_id"].to_numpy()
        for lo, hi, w in _words.words_of(docs["text"], _words.NOT_SPACE, _words.SAME):
            gone = _cover(_flagged_words(flags, ids, w, lo, hi, cache), n, len(w.hash))
            edge = np.diff(np.concatenate([[0], gone.astype(np.int8), [0]]))
            change = np.zeros(len(gone) + 1, bool)
            change[w.first] = True  # a span ends with its document
            begin = np.flatnonzero((edge == 1) | (change & np.append(gone, False)))
            end = np.flatnonzero((edge == -1) | (change & np.append(False, gone)))
            doc = w.doc[begin] if len(begin) else begin
            spans = pa.StructArray.from_arrays([pa.array(begin - w.first[doc]), pa.array(end - w.first[doc])], ["start", "end"])
            offsets = np.append(0, np.cumsum(np.bincount(doc, minlength=hi - lo))).astype(np.int32)
            removed = np.bincount(w.doc[gone], minlength=hi - lo)
            out.append(pa.record_batch([pa.array(ids[lo:hi]), pa.array(w.count.astype(np.int64)), pa.array(removed.astype(np.int64)), _join_words(w, ~gone), pa.ListArray.from_arrays(pa.array(offsets), spans).cast(_RESULT.field(4).type)], schema=_RESULT))
        return pa.Table.from_batches(out, _RESULT)

    return run


def _dealt(texts: DataFrame, buckets: int) -> DataFrame:
    """texts as a table in buckets of _db in the shared folder, so that no level shuffles them again. Its name is gone from the catalog, its files are the run's."""
    spark, name = texts.sparkSession, f"substring_dedup_{uuid.uuid4().hex}"
    texts.repartition(buckets, "_db").write.bucketBy(buckets, "_db").option("path", f"{shared_folder(spark)}/{name}").saveAsTable(name)
    out = spark.table(name)
    assert out.columns == texts.columns  # it is resolved now, and no longer needs the name
    spark.sql(f"DROP TABLE {name}")
    return out


def remove_repeated_windows(docs: DataFrame, window: int = 20) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text and removed (spans of word positions) for each row of docs.

    A word goes if a window of `window` words that covers it also starts earlier, in
    a smaller doc_id or further up in the same document; windows are judged on the
    input. Null and empty texts have no words and keep an empty text. An id names one
    text: rows that repeat it are one occurrence, none of them earlier than the other.
    Rows without a doc_id come before all others, by a hash of their texts, and equal
    ones are one occurrence; ids of others are above -(2 ** 63) + 2 ** 48. A very long text
    is worked on whole, in one task, at some hundred bytes for each of its words. An
    empty table gives no rows. Other columns are not read.
    """
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
    buckets = max(partitions(spark), size // BUCKET_BYTES + 1)
    n_buckets, n_doc_buckets = buckets + 1, 2 * buckets + 1
    text = F.col("text").cast("string")
    own = F.lit(NAMELESS) + F.pmod(F.xxhash64(text), F.lit(NAMELESS_IDS))
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), own).alias("_id"), text.alias("text"))
    dealt = _dealt(texts.withColumn("_db", spread(F.col("_id"), n_doc_buckets)), buckets)
    flags = None
    steps = levels(window)
    for k, level in enumerate(steps):
        if flags is None:
            asked = texts.mapInArrow(_first_lookup(window, level, n_buckets, n_doc_buckets), _ENTRY_SQL)
        else:
            asked = dealt.groupBy("_db").cogroup(flags.groupBy("_db")).applyInArrow(_next_lookup(window, steps[k - 1], level, n_buckets, n_doc_buckets), _ENTRY_SQL)
        flags = asked.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(_answers(level == window, n_doc_buckets), _FLAG_SQL)
        if level < window:
            flags = cut(flags)
            if flags.isEmpty():  # no candidate is left
                break
    left = dealt.groupBy("_db").cogroup(flags.groupBy("_db")).applyInArrow(_finish(window), _RESULT_SQL)
    return left.select(F.when(F.col("_id") >= NAMELESS + NAMELESS_IDS, F.col("_id")).alias("doc_id"), "n_words", "n_removed", "kept_text", "removed")


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeated_windows(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text"), 256).alias("kept_sha256"))


OP4_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS n, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), windows AS (
  SELECT n, coalesce(doc_id, -9223372036854775808) AS i, s, md5_number(array_to_string(w[s + 1 : s + 20], ' ')) AS h FROM docs, LATERAL (SELECT unnest(range(0, len(w) - 19)) AS s)
), firsts AS (
  SELECT h, min((i, s)) AS f FROM windows GROUP BY h HAVING count(*) > 1
), gone AS (
  SELECT DISTINCT n, p FROM windows JOIN firsts USING (h), LATERAL (SELECT unnest(range(s, s + 20)) AS p) WHERE (i, s) <> f
), counts AS (
  SELECT n, count(*) AS n_removed FROM gone GROUP BY n
), kept AS (
  SELECT n, string_agg(word, ' ' ORDER BY p) AS kept FROM (SELECT n, unnest(w) AS word, unnest(range(0, len(w))) AS p FROM docs) ANTI JOIN gone USING (n, p) GROUP BY n
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM docs LEFT JOIN counts USING (n) LEFT JOIN kept USING (n)
"""
