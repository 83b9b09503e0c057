"""A trie of conversations by their turns.

A turn is a unit of 20 bytes: the digest of its role and text, and the text's code
points. A conversation is its units in a row, so the trie is built from short bytes
while texts stay where they are. Equal conversations are one class with a weight.

Classes are dealt to buckets by the digest of their first turn, and each bucket's
tries are dictionaries of pointers inside applyInPandas, summed up by an iterative
postorder. A first turn whose classes hold more turns than an even share of a bucket
isn't dealt as it stands: the path of one of its classes becomes a spine, and what
leaves the spine is dealt again by its next turn, until no part is too large. Sums of
subtrees are hung on their spines at the end, the deepest first.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm._spark import cut, partitions, table

UNIT, DIGEST = 20, 16
#: Turns of a bucket, about; ids of a class that are joined at once, as a power of two; rows and bytes of paths that are broadcast, at most.
BUCKET_TURNS, RANGE_BITS, MOST_SENT, MOST_SENT_BYTES = 100_000, 12, 200_000, 16 << 20
#: Digest of the ids of a node at which no conversation ends.
NONE = hashlib.sha256(b"").hexdigest()
ROOT = b""

_CLASS = pa.schema([("path", pa.binary()), ("n", pa.int64()), ("conv", pa.int64()), ("ends", pa.string())])
_CLASS_SQL = "path binary, n long, conv long, ends string"
NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
_NODE_SQL = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
_SPINE_SQL = "key binary, depth long, conv_id long, parent_conv_id long, n_convs long, chars long, ends_sha256 string, last boolean, chain binary"


def unit(role: Column, text: Column) -> Column:
    """Digest and length of a turn in UNIT bytes."""
    digest = F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * DIGEST)
    return F.unhex(F.concat(digest, F.lpad(F.hex(F.char_length(text)), 8, "0")))


def turn_lists(conversations: DataFrame, group: Column) -> DataFrame:
    """_group, conv_id and _units (array of binary) of each conversation, its turns in order; rows of a group stand together."""
    text_of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn").cast("long").alias("turn"), unit(text_of("role"), text_of("text")).alias("unit")).alias("_t"))
    rows = rows.filter(F.col("conv_id").isNotNull()).withColumn("_group", group).repartition("_group")
    turns = F.array_sort(F.collect_list("_t"))
    return rows.groupBy("_group", "conv_id").agg(F.transform(turns, lambda t: t["unit"]).alias("_units"))


def joined(units: Column) -> Column:
    return F.unhex(F.array_join(F.transform(units, lambda u: F.hex(u)), ""))


def paths(conversations: DataFrame) -> DataFrame:
    """conv_id and path (its units in a row) of each conversation."""
    return turn_lists(conversations, F.col("conv_id")).select("conv_id", joined(F.col("_units")).alias("path"))


# Fixed values of the query: conversations of a hundred ids share a head, of fewer turns than this.
BLOCK, HEADS = 100, 6


def rebuilt_paths(conversations: DataFrame) -> DataFrame:
    """conv_id and path, the first turns replaced by those of the conversation that the id's hundred begins with."""
    rows = turn_lists(conversations, F.col("conv_id") - F.col("conv_id") % BLOCK)
    none = F.array().cast("array<binary>")
    first = F.when(F.col("conv_id") == F.col("_group"), F.slice("_units", 1, HEADS - 1))
    rows = rows.withColumn("_head", F.coalesce(F.max(first).over(Window.partitionBy("_group")), none))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS).cast("int")
    own = F.slice("_units", h + 1, F.greatest(F.size("_units"), F.lit(1)))
    return rows.select("conv_id", joined(F.concat(F.slice("_head", F.lit(1), h), own)).alias("path"))


def _closed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each run of equal paths: its ids, which come in ascending ranges, go through one digest."""
    path, n, conv, digest = None, 0, 0, None
    for batch in batches:
        out = []
        for p, k, first, ids in zip(*(batch.column(c).to_pylist() for c in ("path", "n", "conv", "ids")), strict=True):
            if p != path:
                if digest is not None:
                    out.append((path, n, conv, digest.hexdigest()))
                path, n, conv, digest = p, 0, first, hashlib.sha256()
            else:
                digest.update(b",")
            digest.update(ids.encode())
            n += k
        yield pa.RecordBatch.from_pylist([dict(zip(_CLASS.names, r, strict=True)) for r in out], _CLASS)
    if digest is not None:
        yield pa.RecordBatch.from_pylist([dict(zip(_CLASS.names, (path, n, conv, digest.hexdigest()), strict=True))], _CLASS)


def classes(convs: DataFrame) -> DataFrame:
    """path, n, conv (least id) and ends (digest of the ascending ids) of equal conversations.

    A class of any size is first joined in ranges of at most 2 ** RANGE_BITS ids, so one
    task reads a text for each range and streams it.
    """
    ranges = convs.groupBy("path", F.shiftright("conv_id", RANGE_BITS).alias("_range")).agg(F.sort_array(F.collect_list("conv_id")).alias("_ids"))
    ranges = ranges.select("path", "_range", F.size("_ids").cast("long").alias("n"), F.get("_ids", F.lit(0)).alias("conv"), F.array_join("_ids", ",").alias("ids"))
    return ranges.repartition("path").sortWithinPartitions("path", "_range").select("path", "n", "conv", "ids").mapInArrow(_closed, _CLASS_SQL)


def chars_of(path: bytes) -> np.ndarray:
    """Code points of each unit's text."""
    units = np.frombuffer(path, np.uint8).reshape(-1, UNIT)[:, DIGEST:]
    return np.ascontiguousarray(units).view(">u4").ravel().astype(np.int64)


def build(rows: pd.DataFrame) -> pd.DataFrame:
    """The nodes of a bucket's subtries. `chain` is set at the top of each, and names what stands above it."""
    tops: dict[bytes, int] = {}
    kids: list[dict[bytes, int]] = []
    n: list[int] = []
    conv: list[int] = []
    depth: list[int] = []
    parent: list[int] = []
    chars: list[int] = []
    ends: list[str] = []
    above: dict[int, tuple[int, bytes]] = {}
    for path, weight, least, closed, at, key, chain, top_parent in zip(*(rows[c] for c in ("path", "n", "conv", "ends", "at", "key", "chain", "parent")), strict=True):
        among, name, node = tops, key, -1
        lengths = chars_of(path)
        for k in range(at, len(path) // UNIT):
            found = among.get(name)
            if found is None:
                found = among[name] = len(n)
                kids.append({})
                n.append(0)
                conv.append(least)
                depth.append(k + 1)
                parent.append(node)
                chars.append(int(lengths[k]))
                ends.append(NONE)
                if node < 0:
                    above[found] = (top_parent, chain)
            n[found] += weight
            if least < conv[found]:
                conv[found] = least
            node, among, name = found, kids[found], path[(k + 1) * UNIT : (k + 2) * UNIT]
        ends[node] = closed
    leaves = [0] * len(n)
    saved = [(w - 1) * c for w, c in zip(n, chars, strict=True)]
    for top in tops.values():
        order, stack = [], [top]
        while stack:
            order.append(node := stack.pop())
            stack.extend(kids[node].values())
        for node in reversed(order):  # children before their parent
            leaves[node] = leaves[node] or 1
            if parent[node] >= 0:
                leaves[parent[node]] += leaves[node]
                saved[parent[node]] += saved[node]
    of = [above[k][0] if p < 0 else conv[p] for k, p in enumerate(parent)]
    chain = [above[k][1] if p < 0 else None for k, p in enumerate(parent)]
    return pd.DataFrame(dict(zip([*NODE, "chain"], (conv, depth, of, n, [len(x) for x in kids], leaves, saved, ends, chain), strict=True)))


def _spines(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The nodes along each spine from its top down: members are those of all marks at their depth and below."""
    for part in parts:
        for r in part.itertuples(index=False):
            m = len(r.path) // UNIT - r.at
            n, conv, ends = np.zeros(m, np.int64), np.full(m, np.iinfo(np.int64).max), [NONE] * m
            for x in r.marks:
                k = x["shared"] - r.at - 1
                n[k] += x["n"]
                conv[k] = min(conv[k], x["conv"])
                ends[k] = x["ends"] or ends[k]
            n, conv = np.cumsum(n[::-1])[::-1], np.minimum.accumulate(conv[::-1])[::-1]
            yield pd.DataFrame(
                {
                    "key": [r.key] * m,
                    "depth": np.arange(r.at + 1, r.at + m + 1),
                    "conv_id": conv,
                    "parent_conv_id": np.concatenate([[r.parent], conv[:-1]]),
                    "n_convs": n,
                    "chars": chars_of(r.path)[r.at :],
                    "ends_sha256": ends,
                    "last": np.arange(m) == m - 1,
                    "chain": [r.chain] + [None] * (m - 1),
                }
            )


def _key(turns: Column) -> Column:
    """Digest of the first turns of a path."""
    return F.substring(F.unhex(F.sha2(F.substring(F.col("path"), F.lit(1), turns * UNIT), 256)), 1, DIGEST)


def _sent(df: DataFrame) -> DataFrame:
    """df (key, and maybe path) written out, with a hint to broadcast it if its rows and bytes are few."""
    df = cut(df)
    size = F.sum(F.length("path")) if "path" in df.columns else F.lit(0)
    found = df.agg(F.count("*").alias("n"), size.alias("size")).first()
    return F.broadcast(df) if found.n <= MOST_SENT and (found.size or 0) <= MOST_SENT_BYTES else df


def prefix_trie(convs: DataFrame, bucket_turns: int = BUCKET_TURNS, buckets: int | None = None) -> DataFrame:
    """The nodes of the trie of convs (conv_id, path), see `paths`: conv_id (least member), depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens and ends_sha256.

    A conversation is one row, whatever its length; each conv_id stands once. Equal
    conversations are weighed, not repeated. Without conversations there is no node, and
    one without turns belongs to the root alone. No bucket gets a part of more turns than
    its even share unless that is a single class. A part that is too large loses the path
    of one class, drawn by its turns, and falls apart along it, so parts shrink by a
    constant factor at each level, whether they are broad, deep or nested.
    """
    spark = convs.sparkSession
    all_classes = cut(classes(convs))
    turns = (F.length("path") / UNIT).cast("long")
    whole = all_classes.agg(F.count("*").alias("classes"), F.sum("n").alias("n"), F.min("conv").alias("conv"), F.sum(turns).alias("turns"), F.max(F.when(F.length("path") == 0, F.col("ends"))).alias("ends")).first()
    if not whole.classes:
        return spark.createDataFrame([], _NODE_SQL)
    buckets = buckets or max(partitions(spark), -(-whole.turns // bucket_turns))
    share = -(-whole.turns // buckets)

    start = {"at": F.lit(0), "key": _key(F.lit(1)), "chain": F.lit(ROOT), "parent": F.lit(whole.conv).cast("long")}
    rows, ready, spines = all_classes.filter(F.length("path") > 0).withColumns(start), [], []
    while True:
        sizes = rows.groupBy("key").agg(F.sum(turns - F.col("at")).alias("turns"), F.count("*").alias("classes"))
        large = _sent(sizes.filter((F.col("turns") > share) & (F.col("classes") > 1)).select("key"))
        if large.isEmpty():
            ready.append(rows)
            break
        ready.append(rows.join(large, "key", "left_anti"))
        heads = rows.join(large, "key", "left_semi")
        # of each large part one path is drawn, in proportion to its turns, by a hash of it
        u = (F.pmod(F.xxhash64("path"), F.lit(1 << 40)) + 1) / float((1 << 40) + 1)
        drawn = F.min_by("path", -F.log(u) / (turns - F.col("at")))
        spine = _sent(heads.groupBy("key").agg(drawn.alias("path"), F.first("at").alias("at"), F.first("chain").alias("chain"), F.first("parent").alias("parent")))
        piece = lambda c, k: F.substring(c, k * UNIT + 1, F.lit(UNIT))
        shorter = (F.least(F.length("path"), F.length("_spine")) / UNIT).cast("int")
        differs = F.filter(F.sequence(F.col("at"), shorter - 1), lambda k: piece("path", k) != piece("_spine", k))
        heads = heads.join(spine.select("key", F.col("path").alias("_spine")), "key").withColumn("shared", F.coalesce(F.array_min(differs), shorter))
        heads = cut(heads.drop("_spine"))
        closed = F.max(F.when(F.length("path") == F.col("shared") * UNIT, F.col("ends")))
        marks = heads.groupBy("key", "shared").agg(F.sum("n").alias("n"), F.min("conv").alias("conv"), closed.alias("ends"))
        marks = marks.groupBy("key").agg(F.collect_list(F.struct("shared", "n", "conv", "ends")).alias("marks"))
        spines.append(cut(marks.join(spine, "key").mapInPandas(_spines, _SPINE_SQL)))
        stems = _sent(spines[-1].select("key", F.col("depth").cast("int").alias("shared"), F.col("conv_id").alias("_parent")))
        off = heads.filter(F.length("path") > F.col("shared") * UNIT).join(stems, ["key", "shared"])
        off = off.select("path", "n", "conv", "ends", F.col("shared").alias("at"), _key(F.col("shared") + 1).alias("_key"), F.col("key").alias("chain"), F.col("_parent").alias("parent"))
        rows = cut(off.withColumnRenamed("_key", "key").select(*rows.columns))

    dealt = ready[0]
    for more in ready[1:]:
        dealt = dealt.unionByName(more)
    bucket = F.pmod(F.xxhash64("key"), F.lit(buckets).cast("long"))
    done = [cut(dealt.groupBy(bucket.alias("_bucket")).applyInPandas(build, f"{_NODE_SQL}, chain binary"))]

    # subtries are hung on their spines, the deepest first
    hung = lambda: [d.filter(F.col("chain").isNotNull()).select("chain", (F.col("depth") - 1).alias("depth"), "n_leaves", "saved_tokens") for d in done]
    for s in reversed(spines):
        tops = hung()
        under = (tops[0].unionByName(tops[-1]) if len(tops) > 1 else tops[0]).groupBy(F.col("chain").alias("key"), "depth").agg(F.sum("n_leaves").alias("_leaves"), F.sum("saved_tokens").alias("_saved"), F.count("*").alias("_kids"))
        up = Window.partitionBy("key").orderBy(F.col("depth").desc()).rowsBetween(Window.unboundedPreceding, 0)
        zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long"))
        leaf = (F.col("last") & F.col("_kids").isNull()).cast("long")
        nodes = s.join(under, ["key", "depth"], "left").select(
            "conv_id", "depth", "parent_conv_id", "n_convs", (zero("_kids") + (~F.col("last")).cast("long")).alias("n_children"),
            F.sum(zero("_leaves") + leaf).over(up).alias("n_leaves"), F.sum(zero("_saved") + (F.col("n_convs") - 1) * F.col("chars")).over(up).alias("saved_tokens"), "ends_sha256", "chain",
        )
        done.append(cut(nodes))
    # what hangs on the root are tries and the first spines
    tops = hung()
    under = (tops[0].unionByName(tops[-1]) if len(tops) > 1 else tops[0]).filter(F.col("chain") == ROOT)
    root = under.agg(F.coalesce(F.sum("n_leaves"), F.lit(1)).alias("leaves"), F.coalesce(F.sum("saved_tokens"), F.lit(0)).alias("saved"), F.count("*").alias("kids")).first()
    out = spark.createDataFrame([(whole.conv, 0, None, whole.n, root.kids, root.leaves, root.saved, whole.ends or NONE)], _NODE_SQL)
    for d in done:
        out = out.unionByName(d.select(*NODE))
    return out


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered by turn, null first; rows that share a turn stand in the order of their digests. Rows without a conv_id belong
    to no conversation; a null role or text is an empty one; repeated rows are turns each."""
    return prefix_trie(rebuilt_paths(table(spark, sf_dir, "conversations")))


OP12_SQL = r"""
WITH crcs AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_concat([i], range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t
), own AS (
  SELECT conv_id, list({'role': coalesce(role, ''), 'text': coalesce(text, '')}
                       ORDER BY turn NULLS FIRST, left(sha256(CAST(octet_length(encode(coalesce(role, ''))) AS VARCHAR) || ':' || coalesce(role, '') || coalesce(text, '')), 32)) AS turns
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
), headed AS (
  SELECT conv_id, turns,
         xor(list_reduce(list_concat([4294967295], list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda a, b: xor(a >> 8, t[1 + (xor(a, b) & 255)])), 4294967295) % 6 AS h
  FROM own, crcs
), rebuilt AS (
  SELECT c.conv_id, list_concat(coalesce(b.turns[1:c.h], []), c.turns[c.h + 1:]) AS turns
  FROM headed c LEFT JOIN own b ON b.conv_id = c.conv_id - c.conv_id % 100
), nodes AS (
  SELECT turns[1:d] AS path, d, min(conv_id) AS conv_id, count(*) AS n,
         sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (len(turns) = d), '')) AS ends
  FROM (SELECT conv_id, turns, unnest(range(len(turns) + 1)) AS d FROM rebuilt) GROUP BY ALL
), held AS (
  SELECT path[1:a] AS path, count(*) FILTER (d = a + 1) AS kids, sum(CASE WHEN d > 0 THEN (n - 1) * length(path[d].text) ELSE 0 END) AS saved
  FROM (SELECT path, d, n, unnest(range(d + 1)) AS a FROM nodes) GROUP BY ALL
), leaves AS (
  SELECT path[1:a] AS path, count(*) AS leaves
  FROM (SELECT path, len(path) AS d, unnest(range(len(path) + 1)) AS a FROM held WHERE kids = 0) GROUP BY ALL
)
SELECT n.conv_id, n.d AS depth, p.conv_id AS parent_conv_id, n.n AS n_convs, h.kids AS n_children, l.leaves AS n_leaves,
       CAST(h.saved AS BIGINT) AS saved_tokens, n.ends AS ends_sha256
FROM nodes n JOIN held h ON h.path = n.path JOIN leaves l ON l.path = n.path
LEFT JOIN nodes p ON n.d > 0 AND p.d = n.d - 1 AND p.path = n.path[1:n.d - 1]
"""
