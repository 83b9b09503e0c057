"""Benchmark decontamination: windows of test items that occur in documents.

All windows of the normalised items go into one Aho-Corasick automaton over words: each
word of the items is a number of as many digits as they all need, the digits of each
place having characters of their own, and any other word is the character 0. So a node
has at most `BASE` children, which the automaton looks through one by one, and no match
begins inside a word. It reads each normalised text once, as a string of such digits;
hits are mapped back to the original's code points. The items are broadcast and a worker
process builds the automaton once: a window takes at most as many nodes as it has words.

Items of more than `MOST_WORDS` words are dealt to as many automata as they need, and
the documents pass one after the other, so a worker and the driver hold one at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import _automaton
from tidemark.llm._spark import column_index, cut, table

BASE = 64
#: Words of an automaton, about (some two kilobytes each in a worker), and of a piece of an item.
MOST_WORDS, PIECE = 200_000, 10_000

_SPAN = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_FOUND = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("items", pa.list_(pa.string())), ("hits", _SPAN), ("spans", _SPAN)])
_FOUND_SQL = "doc_id long, n_words long, items array<string>, hits array<struct<start:long,end:long>>, spans array<struct<start:long,end:long>>"


class Windows:
    """The windows of (item, words) pairs as one automaton over the digits of word numbers."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], size: int):
        number: dict[bytes, int] = {}
        found: dict[tuple[bytes, ...], set[str]] = {}
        for item, words in items:
            for x in words:
                number.setdefault(x, len(number))
            for k in range(max(1, len(words) - size + 1) if words else 0):
                found.setdefault(tuple(words[k : k + size]), set()).update([item] if item is not None else [])
        places = 1
        while BASE**places < len(number):
            places += 1
        self.digits = {x: "".join([chr(1 + BASE * p + k // BASE**p % BASE) for p in range(places)]) for x, k in number.items()}
        self.items = list(found.values())
        self.length = np.array([len(w) for w in found], np.int64)
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for k, w in enumerate(found):
            self.automaton.add_word(self._line(w), k)
        if found:
            self.automaton.make_automaton()

    def _parts(self, words: Sequence[bytes]) -> list[str]:
        get = self.digits.get
        return [get(x, "\0") for x in words]

    def _line(self, words: Sequence[bytes]) -> str:
        return "".join(self._parts(words))

    def places(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(window, last word) of each occurrence in a text's words."""
        parts = self._parts(words) if self.items else []
        hits = list(self.automaton.iter("".join(parts))) if parts else []
        end, window = np.array(hits, np.int64).reshape(-1, 2).T
        return window, np.searchsorted(np.cumsum([len(x) for x in parts]) - 1, end) if hits else end

    def any_place(self, words: list[bytes]) -> bool:
        return bool(self.items and words) and next(self.automaton.iter(self._line(words)), None) is not None


_built: dict[str, Windows] = {}


def _windows(key: str, items: list[tuple[str | None, list[bytes]]], size: int) -> Windows:
    """A worker process keeps the last automaton that it built."""
    if key not in _built:
        _built.clear()
        _built[key] = Windows(items, size)
    return _built[key]


def _pieces(benchmark: DataFrame, window: int) -> DataFrame:
    """item, words (one space between them) and n of each item, in pieces that share window - 1 words with the next."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch.column("item"), batch.column("text"), strict=True):
                w = _automaton.words((text.as_py() or "").encode())
                parts = [w[k : k + PIECE + window - 1] for k in range(0, max(1, len(w) - window + 1), PIECE)] if w else []
                yield pa.record_batch([pa.array([item.as_py()] * len(parts), pa.string()), pa.array([b" ".join(x).decode() for x in parts], pa.string()), pa.array([len(x) for x in parts], pa.int64())], ["item", "words", "n"])

    items = benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("string").alias("text"))
    return items.mapInArrow(run, "item string, words string, n long")


def _sent(benchmark: DataFrame, window: int) -> Iterator[tuple]:
    """(broadcast items, a key for them) of each automaton; one if the items fit into it, even without any."""
    pieces = cut(_pieces(benchmark, window))
    total = pieces.agg(F.sum("n")).first()[0] or 0
    parts = 1 if total <= MOST_WORDS else -(-2 * total // MOST_WORDS)
    part = F.pmod(F.xxhash64("item", "words"), F.lit(parts).cast("long"))
    for k in range(parts):
        held = sorted(((r.item, r.words.encode().split(b" ")) for r in pieces.where(part == k).collect()), key=repr)
        if held or parts == 1:
            yield benchmark.sparkSession.sparkContext.broadcast(held), hashlib.sha256(repr((window, held)).encode()).hexdigest()


_TEXT = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("items", pa.list_(pa.string())), ("hits", _SPAN)])
_TEXT_SQL = "doc_id long, text string, items array<string>, hits array<struct<start:long,end:long>>"


def _scan(sent, key: str, size: int, last: bool):
    """Adds an automaton's items and hits to those of each text; the last one gives words and spans in the text's place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = _windows(key, sent.value, size)
        for batch in batches:
            n_words, items, hits, spans = [], [], [], []
            for x, old, had in zip(*(batch.column(c) for c in ("text", "items", "hits")), strict=True):
                text = x.as_py() or ""
                w = _automaton.words(text.encode())
                which, end = windows.places(w)
                mask = np.zeros(len(w) + 1, np.int64)
                np.add.at(mask, end - windows.length[which] + 1, 1)
                np.add.at(mask, end + 1, -1)
                for r in had.as_py():
                    mask[r["start"]] += 1
                    mask[r["end"]] -= 1
                runs = _automaton.runs(np.cumsum(mask)[: len(w)] > 0)
                n_words.append(len(w))
                items.append(sorted(set(old.as_py()).union(*(windows.items[k] for k in set(which.tolist())))))
                hits.append([{"start": a, "end": b} for a, b in runs])
                if last:
                    at = _automaton.spans(text) if runs else []
                    spans.append([{"start": at[a][0], "end": at[b - 1][1]} for a, b in runs])
            found = [pa.array(items, pa.list_(pa.string())), pa.array(hits, _SPAN)]
            if last:
                yield pa.record_batch([batch.column("doc_id"), pa.array(n_words, pa.int64()), *found, pa.array(spans, _SPAN)], schema=_FOUND)
            else:
                yield pa.record_batch([batch.column("doc_id"), batch.column("text"), *found], schema=_TEXT)

    return run


def keep_clean(docs: DataFrame, benchmark: DataFrame, window: int = 10, text: str = "text") -> DataFrame:
    """The rows of docs without any window of an item, with all their columns.

    Null and empty texts and null ids stay; repeated rows are judged each; an empty table
    of either kind removes nothing. A very long text is scanned whole, in one task. The
    text's column may be spelled in any case.
    """
    at = column_index(docs, text)

    def of(sent, key: str):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            windows = _windows(key, sent.value, window)
            for batch in batches:
                hit = [windows.any_place(_automaton.words((x.as_py() or "").encode())) for x in batch.column(at)]
                yield batch.filter(pa.array([not x for x in hit], pa.bool_()))

        return run

    out = None
    for sent, key in _sent(benchmark, window):
        out = (docs if out is None else cut(out)).mapInArrow(of(sent, key), docs.schema)
    return out


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """doc_id, n_words, n_hit, items, hits (runs of words) and spans (code points) for each row of docs.

    A window is `window` consecutive words of an item, or all of a shorter item. Null
    and empty texts have no words, and such items no window. Null ids stay; repeated rows
    are judged each; an empty table gives no rows. Items that share an id count once; an
    item without an id marks words but isn't listed. A very long text is scanned whole,
    in one task. Other columns are not read.
    """
    nothing = [F.array().cast(t).alias(c) for c, t in (("items", "array<string>"), ("hits", "array<struct<start:long,end:long>>"))]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *nothing)
    parts = list(_sent(benchmark, window))
    for sent, key in parts[:-1]:
        rows = cut(rows.mapInArrow(_scan(sent, key, window, False), _TEXT_SQL))
    found = rows.mapInArrow(_scan(*parts[-1], window, True), _FOUND_SQL)
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), "items", "hits", "spans")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


OP7_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS n, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), items AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS b FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, least(10, len(b)) AS size, array_to_string(b[k + 1 : k + least(10, len(b))], ' ') AS win
  FROM items, LATERAL (SELECT unnest(range(0, len(b) - least(10, len(b)) + 1)) AS k) WHERE len(b) > 0
), sizes AS (SELECT DISTINCT size FROM windows), starts AS (
  SELECT n, size, s, array_to_string(w[s + 1 : s + size], ' ') AS win
  FROM docs, sizes, LATERAL (SELECT unnest(range(0, len(w) - size + 1)) AS s)
), hits AS (
  SELECT n, s, starts.size, item_id FROM starts JOIN windows USING (size, win)
), words_hit AS (
  SELECT n, count(DISTINCT p) AS n_hit FROM hits, LATERAL (SELECT unnest(range(s, s + size)) AS p) GROUP BY n
), found AS (
  SELECT n, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM hits GROUP BY n
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN words_hit USING (n) LEFT JOIN found USING (n)
"""
