"""Document fingerprints: a homomorphic multiset hash over paragraphs, in Spark expressions.

Each paragraph (line) is hashed to a wide vector, and a document's fingerprint is the
sum of its paragraphs' vectors modulo 2 ** 32: EXACT lanes of uniform bits, which tell
texts apart, and NEAR lanes, in which each pair of neighbouring words of the paragraph
counts +1 or -1, so that they don't wrap below 2 ** 31 pairs. Sums don't depend on the order, so documents
with the same paragraphs in any order have equal fingerprints, and `insert` and
`delete` change a fingerprint by the vectors of what comes or goes. Differences of the
near lanes estimate how many word pairs two documents don't share, whence `likeness`;
with 64 lanes its standard error is about 0.18 times one less the likeness.

Neighbours in doc_id order come from one shuffle. A bounded hash sample of the ids cuts
them into ranges; a document goes to its range, the first of a range also to the range
before, and a window of each range, which sorts and spills, sees every document's
successor. Exploded words are summed within the same partitioning, without a shuffle
of their own.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm._spark import table

EXACT, NEAR = 16, 64
#: Documents in a range, the most ranges (longs in the plan), and the ids that are sampled for each.
RANGE_ROWS, RANGES, RANGE_SAMPLE = 128, 50_000, 20
#: Rows without an id get ids of their own from here on, by a hash of their text; other ids are above.
NAMELESS, NAMELESS_IDS = -(1 << 63), 1 << 48

_MASK32 = 0xFFFFFFFF


# ---- vectors and fingerprints


def paragraphs(text: Column) -> Column:
    return F.split(text, "\n")


def exact_vector(paragraph: Column) -> Column:
    """EXACT lanes of 32 bits, two from each of EXACT / 2 hashes."""
    lanes = []
    for seed in range(EXACT // 2):
        h = F.xxhash64(F.lit(seed), paragraph)  # the seed first, so that each is a hash of the paragraph itself
        lanes += [h.bitwiseAND(F.lit(_MASK32)), F.shiftrightunsigned(h, 32)]
    return F.array(*lanes)


def exact_sum(text: Column) -> Column:
    """The sum of a text's paragraphs' exact vectors, modulo 2 ** 32."""
    add = lambda a, b: (a + b).bitwiseAND(F.lit(_MASK32))
    return F.aggregate(paragraphs(text), F.array_repeat(F.lit(0).cast("long"), EXACT), lambda acc, p: F.zip_with(acc, exact_vector(p), add))


def words_of(paragraph: Column) -> Column:
    return F.split(paragraph, " ")


def pair_hashes(words: str) -> Column:
    """A hash for each word of a paragraph and its successor there; words is a column, so that the split isn't done again inside."""
    return F.zip_with(F.col(words), F.slice(words, F.lit(2), F.size(words)), lambda a, b: F.xxhash64(a, b))


def near_sums(h: Column) -> list[Column]:
    """Aggregates over pair hashes: for each of 32 places the bits there and 32 further on, counted in the halves of a long."""
    return [F.sum(F.shiftrightunsigned(h, k).bitwiseAND(F.lit(0x0000000100000001))).alias(f"_s{k}") for k in range(NEAR // 2)]


def near_lanes(count: Column) -> Column:
    """NEAR signed lanes from near_sums and the number of hashes."""
    lanes = []
    for k in range(NEAR // 2):
        s = F.coalesce(F.col(f"_s{k}"), F.lit(0).cast("long"))
        lanes += [s.bitwiseAND(F.lit(_MASK32)) * 2 - count, F.shiftrightunsigned(s, 32) * 2 - count]
    return F.array(*lanes)


def _hex(lanes: Column, digits: int) -> Column:
    mask = (1 << 4 * digits) - 1
    return F.array_join(F.transform(lanes, lambda x: F.lower(F.lpad(F.hex(x.bitwiseAND(F.lit(mask))), digits, "0"))), "")


def to_fingerprint(exact: Column, near: Column) -> Column:
    return F.concat(_hex(exact, 8), _hex(near, 8))


def _lanes(fingerprint: Column) -> tuple[Column, Column]:
    at = lambda k, n: F.conv(F.substring(fingerprint, k, n), 16, 10).cast("long")
    near = [at((EXACT + k) * 8 + 1, 8) for k in range(NEAR)]
    return F.array(*(at(k * 8 + 1, 8) for k in range(EXACT))), F.array(*(F.when(x >= 1 << 31, x - (1 << 32)).otherwise(x) for x in near))


def _combine(a: Column, b: Column, sign: int) -> Column:
    (a_exact, a_near), (b_exact, b_near) = _lanes(a), _lanes(b)
    add = lambda x, y: x + y * F.lit(sign)
    return to_fingerprint(F.zip_with(a_exact, b_exact, add), F.zip_with(a_near, b_near, add))


def insert(fingerprint: Column, other: Column) -> Column:
    """The fingerprint of both documents' paragraphs together."""
    return _combine(fingerprint, other, 1)


def delete(fingerprint: Column, other: Column) -> Column:
    """The fingerprint without the other's paragraphs."""
    return _combine(fingerprint, other, -1)


def near_likeness(a: Column, b: Column) -> Column:
    """2 a.b / (a.a + b.b) of two near vectors, from 0 to 1; 1 if both are zero."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    both = dot(a, a) + dot(b, b)
    ratio = F.lit(2.0) * dot(a, b) / F.when(both > 0, both)
    return F.when(both == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), ratio)))


def likeness(a: Column, b: Column) -> Column:
    """Likeness of two fingerprints."""
    return near_likeness(_lanes(a)[1], _lanes(b)[1])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint of each row of docs; equal texts have equal fingerprints, null is an empty text.

    Null ids stay, repeated rows are fingerprinted each, other columns are not read.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.monotonically_increasing_id().alias("_row"))
    rows = rows.withColumn("_exact", exact_sum(F.col("text")))  # before the explode, else it is worked out for each paragraph
    rows = rows.select("doc_id", "_row", "_exact", F.explode(paragraphs(F.col("text"))).alias("_p"))
    rows = rows.select("doc_id", "_row", "_exact", words_of(F.col("_p")).alias("_w")).select("doc_id", "_row", "_exact", F.explode(pair_hashes("_w")).alias("_h"))
    out = rows.groupBy("_row", "doc_id", "_exact").agg(F.count("_h").alias("_n"), *near_sums(F.col("_h")))
    return out.select("doc_id", to_fingerprint(F.col("_exact"), near_lanes(F.col("_n"))).alias("fingerprint"))


# ---- neighbours and edits


def _range_bounds(ids: DataFrame) -> list[int]:
    """The least ids of the ranges, ascending; the first is the least of all.

    They come from about RANGE_SAMPLE ids for each range, drawn by a hash of the id and
    sorted at the driver as one array: a million longs or two, however many documents
    there are.
    """
    n, least = ids.agg(F.count("*"), F.min("_id")).first()
    if not n:
        return []
    parts = min(RANGES, -(-n // RANGE_ROWS))
    if parts == 1:
        return [least]
    one_in = max(1, n // (parts * RANGE_SAMPLE))
    drawn = ids.where(F.pmod(F.xxhash64("_id"), F.lit(one_in)) == 0).distinct()
    found = sorted(drawn.toArrow()["_id"].to_pylist())
    return sorted({least, *(found[k * len(found) // parts] for k in range(1, parts) if found)})


def _range_of(x: Column, bounds: list[int]) -> tuple[Column, Column]:
    """(range of an id by binary search, the range's least id)."""
    steps = max(1, (len(bounds) - 1).bit_length())
    padded = bounds + [(1 << 63) - 1] * ((1 << steps) - len(bounds))
    values = F.from_json(F.lit(json.dumps(padded)), "array<bigint>")
    walk = F.array(*(F.lit(1 << k) for k in reversed(range(steps))))
    at = F.aggregate(walk, F.lit(0), lambda lo, step: F.when(F.element_at(values, lo + step + 1) <= x, lo + step).otherwise(lo))
    return F.least(at, F.lit(len(bounds) - 1)), values


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next.

    A document's edited text has its last n_chars / 4 code points replaced by the first
    as many (or all) of the next document in ascending doc_id, after the last of the
    first. Rows that share a doc_id follow each other by text, in one range; rows without
    one come first, by a hash of their texts, and their ids stay null; other ids are above
    -(2 ** 63) + 2 ** 48. Null texts are empty. An empty table has no rows, in a table of
    one row the document is its own successor. A very long text is one row and is split
    in one task. Other columns are not read.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    own = F.lit(NAMELESS) + F.pmod(F.xxhash64(text), F.lit(NAMELESS_IDS))
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), own).alias("_id"), text.alias("text"))
    bounds = _range_bounds(rows.select("_id")) or [0]
    at, values = _range_of(F.col("_id"), bounds)
    rows = rows.withColumn("_b", at).withColumn("_first", F.element_at(values, F.col("_b") + 1) == F.col("_id"))
    seat = lambda b, wrap, guest: F.struct(b.alias("b"), wrap.alias("wrap"), F.lit(guest).alias("guest"))
    own = seat(F.col("_b"), F.lit(0), False)
    before = seat(F.when(F.col("_b") > 0, F.col("_b") - 1).otherwise(F.lit(len(bounds) - 1)), F.when(F.col("_b") > 0, 0).otherwise(1), True)
    seats = F.when(F.col("_first"), F.array(own, before)).otherwise(F.array(own))
    rows = rows.select("_id", "text", F.explode(seats).alias("_s")).select("_id", "text", "_s.b", "_s.wrap", "_s.guest")

    by_id = Window.partitionBy("b").orderBy("wrap", "_id", "guest", "text")
    rows = rows.select("_id", "text", "b", "guest", F.row_number().over(by_id).alias("rn"), F.lead("text").over(by_id).alias("_next"))
    n = F.char_length("text")
    quarter = F.floor(n / 4).cast("int")
    edited = F.concat(F.left(F.col("text"), n - quarter), F.left(F.coalesce("_next", F.lit("")), quarter))
    rows = rows.select("_id", "b", "guest", "rn", "text", n.cast("long").alias("n_chars"), F.when(~F.col("guest"), edited).alias("_edited"))
    version = lambda k, text, sha: F.struct(F.lit(k).alias("which"), text.alias("text"), sha.alias("sha"))
    versions = F.array(version(0, F.col("text"), F.sha2("_edited", 256)), version(1, F.col("_edited"), F.lit("")))
    rows = rows.select("_id", "b", "guest", "rn", "n_chars", F.explode(versions).alias("v")).where("v.which = 0 or not guest")
    keys = ["b", "rn", "which", "_id", "guest", "n_chars", "sha", "exact"]
    # the exact lanes before the explode, else they are worked out for each paragraph
    rows = rows.select("b", "rn", "v.which", "_id", "guest", "n_chars", "v.sha", "v.text", to_exact_hex(F.col("v.text")).alias("exact"))
    rows = rows.select(*keys, F.explode(paragraphs(F.col("text"))).alias("_p"))
    rows = rows.select(*keys, words_of(F.col("_p")).alias("_w")).select(*keys, F.explode(pair_hashes("_w")).alias("_h"))
    sums = rows.groupBy(*keys).agg(F.count("_h").alias("_n"), *near_sums(F.col("_h")))
    sums = sums.select(*keys, near_lanes(F.col("_n")).alias("near"))

    in_turn = Window.partitionBy("b").orderBy("rn", "which")
    ahead = lambda c, k: F.lead(c, k).over(in_turn)
    out = sums.select("*", ahead("exact", 1).alias("_exact1"), ahead("near", 1).alias("_near1"), ahead("near", 2).alias("_near2")).where("which = 0 and not guest")
    return out.select(
        F.when(F.col("_id") >= NAMELESS + NAMELESS_IDS, F.col("_id")).alias("doc_id"),
        "n_chars",
        F.col("sha").alias("edited_sha256"),
        F.concat("exact", _hex(F.col("near"), 8)).alias("fingerprint"),
        F.concat("_exact1", _hex(F.col("_near1"), 8)).alias("edited_fingerprint"),
        near_likeness(F.col("near"), F.col("_near1")).alias("near_edited"),
        near_likeness(F.col("near"), F.col("_near2")).alias("near_next"),
    )


def to_exact_hex(text: Column) -> Column:
    return _hex(exact_sum(text), 8)


def op1_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(table(spark, sf_dir, "documents"))
