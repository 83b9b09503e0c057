"""Secret scan: fixed patterns, and a token-efficiency test for what has no pattern.

Text that a tokenizer has learned takes few tokens: four or more characters each in
English prose, still above two in words that nobody has seen. Random strings fall
apart into one to two characters a token. A run of letters, digits and +/_=- of at
least `LEAST` characters is a secret (kind `random`) if its characters per token
under a tiktoken vocabulary stay below `RATIO`, unless it is a known digest (hex of
the length of a common hash, or a UUID), or an identifier: mostly numbers that stand
alone and camel-case words that the vocabulary itself encodes in few tokens. Of a run
that base patterns have found in part, each rest of `LEAST` characters is tested.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm._spark import column_index, table

LEAST, RATIO = 20, 2.2

# The base patterns, in the order in which they are listed.
KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 6, 20, 24
KEYS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")

# The same matches without the failing ones in between: a run of a class matches as a whole or not at all.
_LONG_ACCESS = re.compile(rf"AKIA[A-Z0-9]{{{ACCESS_LEAST - 4},}}")
_LONG_HEX = re.compile(rf"[0-9a-f]{{{HEX_LEAST},}}")
_ANY_LONG = re.compile(rb"[A-Za-z0-9+/_=-]{20,}")
_RUN = re.compile(rf"[A-Za-z0-9+/_=-]{{{LEAST},}}")
_DIGEST = re.compile(r"(?:[0-9a-fA-F]{32}|[0-9a-fA-F]{40}|[0-9a-fA-F]{56}|[0-9a-fA-F]{64}|[0-9a-fA-F]{96}|[0-9a-fA-F]{128}|[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12})\Z")
_CHUNK = re.compile(r"[A-Za-z0-9]+")
_WORD = re.compile(r"[A-Z]?[a-z]{2,}|[A-Z]{3,}(?![a-z])")
#: Share of an identifier's letters and digits that are in known words and numbers.
KNOWN = 0.75

_SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
_SPAN_SQL = "array<struct<kind:string,start:long,end:long>>"
_FOUND = pa.schema([("doc_id", pa.int64()), ("spans", _SPAN)])


def identifier(s: str, count: Callable[[str], int]) -> bool:
    """Mostly numbers between marks, and camel-case words of three characters and more that take few tokens each."""
    chunks = _CHUNK.findall(s)
    known = 0
    for chunk in chunks:
        known += len(chunk) if chunk.isdigit() else sum(len(w) for w in _WORD.findall(chunk) if len(w) >= 3 and len(w) >= RATIO * count(w))
    return known >= KNOWN * sum(map(len, chunks))


def token_counter(ranks: str, pattern: str) -> Callable[[str], int]:
    import tiktoken

    with open(ranks, "rb") as f:
        vocabulary = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    encode = tiktoken.Encoding("secrets", pat_str=pattern, mergeable_ranks=vocabulary, special_tokens={}).encode_ordinary
    return lambda s: len(encode(s))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by start, then by kind as listed."""
    out = [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    out += [("access", *m.span()) for m in _LONG_ACCESS.finditer(text)]
    out += [("hex", *m.span()) for m in _LONG_HEX.finditer(text)]
    return sorted(out, key=lambda x: (x[1], KINDS.index(x[0])))


def _rests(a: int, b: int, base: list[tuple[str, int, int]]) -> Iterator[tuple[int, int]]:
    """What of [a, b) lies outside the spans of base, which come by start."""
    for _, lo, hi in base:
        if lo < b and a < hi:
            if lo > a:
                yield a, lo
            a = hi
    if a < b:
        yield a, b


def random_spans(text: str, base: list[tuple[str, int, int]], count: Callable[[str], int]) -> list[tuple[str, int, int]]:
    out = []
    for m in _RUN.finditer(text):
        for a, b in _rests(*m.span(), base):
            s = text[a:b]
            if len(s) >= LEAST and not _DIGEST.match(s) and len(s) < RATIO * count(s) and not identifier(s, count):
                out.append(("random", a, b))
    return out


def scanner(files: tuple[str, str]) -> Callable[[str], list[tuple[str, int, int]]]:
    """All spans of a text, by start, then by kind as listed."""
    count = token_counter(*files)

    def run(text: str) -> list[tuple[str, int, int]]:
        raw = text.encode("utf-8", "surrogatepass")
        long = _ANY_LONG.search(raw)
        if not long:
            low = raw.lower()
            if not any(k in low for k in KEYS):
                return []
        found = base_spans(text)
        if long:
            found += random_spans(text, found, count)
        return sorted(found, key=lambda x: (x[1], KINDS.index(x[0])))

    return run


_scanners: dict[tuple[str, str], Callable] = {}


def _scanner(files: tuple[str, str]) -> Callable[[str], list[tuple[str, int, int]]]:
    if files not in _scanners:
        _scanners[files] = scanner(files)
    return _scanners[files]


def vocabulary_files(name: str = "byte_bpe_50k") -> tuple[str, str]:
    """(ranks file, split pattern) of a public tiktoken vocabulary."""
    import public_tokenizers

    return public_tokenizers.path(f"{name}.tiktoken"), public_tokenizers.PATTERN


def find_secrets(docs: DataFrame, files: tuple[str, str] | None = None) -> DataFrame:
    """doc_id and spans (kind, start, end in code points) for each row of docs.

    Null and empty texts have no spans; null ids stay; repeated rows are judged each; an
    empty table gives no rows. A very long text is scanned whole, in one task. Other
    columns are not read.
    """
    files = files or vocabulary_files()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = _scanner(files)
        for batch in batches:
            spans = [[{"kind": k, "start": a, "end": b} for k, a, b in scan(x.as_py() or "")] for x in batch.column("text")]
            yield pa.record_batch([batch.column("doc_id"), pa.array(spans, _SPAN)], schema=_FOUND)

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(run, f"doc_id long, spans {_SPAN_SQL}")


def redact(docs: DataFrame, files: tuple[str, str] | None = None, mark: str = "[secret]") -> DataFrame:
    """docs with each secret of `text` replaced by a mark, and n_chars, if there is one, counted anew.

    Touching and overlapping spans become one mark. All columns and rows stay, null and
    repeated ones too; an empty table stays empty; a very long text is one string in one task. The columns may be
    spelled in any case.
    """
    files, k = files or vocabulary_files(), column_index(docs, "text")
    text = docs.columns[k]

    def hide(scan: Callable, text: str | None) -> str | None:
        if not text:
            return text
        out, done = [], 0
        for _, a, b in scan(text):
            if a > done or not out:
                out += [text[done:a], mark]
            done = max(done, b)
        return "".join([*out, text[done:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = _scanner(files)
        for batch in batches:
            yield batch.set_column(k, batch.schema.field(k), pa.array([hide(scan, x.as_py()) for x in batch.column(k)], batch.schema.field(k).type))

    out = docs.mapInArrow(run, docs.schema)
    if "n_chars" not in (c.lower() for c in docs.columns):
        return out
    counted = docs.schema[column_index(docs, "n_chars")]
    return out.withColumn(counted.name, F.char_length(text).cast(counted.dataType))


def _line(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents"))
    of = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = _line(F.filter("spans", lambda x: x["kind"] != "random"))
    return found.select("doc_id", of("assign"), of("access"), of("hex"), F.sha2(base, 256).alias("base_sha256"), _line(F.col("spans")).alias("spans"))
