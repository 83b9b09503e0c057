"""Near-duplicate documents by a chosen-path set similarity join.

Documents are sets of distinct word shingles. Equal sets are one class from the
start, so exact copies cost nothing further on. Each class carries the least hashes
of its set under `COORDINATES` hash functions, one byte of each. In each of `TREES`
independent trees the root chooses `BRANCHES` coordinates; a class goes to one child
for each of them, the one named by its least hash there. A node of at most `LIMIT`
classes is compared exhaustively on sketches. Every larger node chooses coordinates
that its path hasn't used and branches again, until no large node is left: documents
that only share boilerplate part on the way, half of them at a coordinate if they
share half.

Similar classes wouldn't part, so a large node is first held against a pivot. Classes
whose sketches agree with it take its label, and pairs of one label need not meet
again: both are candidates of one pivot. A child with one label alone is dropped. Once
few classes of a large node are without its main label, `OPEN` or a sixteenth of its
own, these are compared with all of it and the node is done.

Recall: a pair at the threshold of 0.85 agrees at a coordinate with probability 0.85.
Branching twice at each level it stays together down to any depth with a probability
of at least 0.969, so it misses all eight root children with one of about a
millionth; its sketches fall short of `agree` with one of three millionths.

Candidates are spanning forests, never all pairs. The candidates' components hold
every link, and are settled on the full sets of 128-bit shingles, exactly: those of up
to `BLOCK` classes and `BLOCK_SHINGLES` shingles in one task with one sparse-to-dense
product, larger ones in blocks which share pivots; classes that aren't linked with the
component's main part are then compared with those of its classes that share one of
their rarest shingles, by prefix filtering, which is exact too and spares the pages of a
template that have enough of their own. All counts, components and links stay
distributed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import _words
from tidemark.llm._spark import checked_broadcast, cut, partitions, table

COORDINATES = 64
TREES, BRANCHES = 4, 2
LIMIT = 128
#: Classes outside its main label that are held against all of a large node: as many in one go (80 bytes each), or its size by OPEN_SHARE in several.
OPEN, OPEN_SHARE = 4096, 16
#: Rows of a large node that meet these few in one task, about.
SALT_ROWS = 20_000
#: Large nodes up to this number (some 100 bytes each) are sent to all tasks; beyond it they are joined.
BROADCAST_NODES = 200_000
BLOCK, BLOCK_SHINGLES, PIVOTS = 1500, 4_000_000, 32
#: Shingles that are listed as common in their clusters, at most (16 bytes each); the rest count as rare.
COMMON = 500_000
#: Ends of links with more others than this are joined by a broadcast, as long as it has at most BROADCAST_NODES of them.
HUB = 1000
#: Links whose components one task settles, at most (8 megabytes).
ONE_TASK_EDGES = 500_000
#: Classes whose texts are fetched by a broadcast of their ids, at most (32 bytes each); beyond, texts are shuffled.
BROADCAST_SEATS = 200_000
#: Standard deviations by which the agreeing sketch coordinates of a link may fall short of the threshold.
SHORT = 4.5
#: Ids from here on stand for sets whose documents have none.
NAMELESS = 1 << 62

_rng = np.random.default_rng(85)
_FACTORS = _rng.integers(1, 1 << 63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SALTS = _rng.integers(1, 1 << 63, COORDINATES, dtype=np.uint64)

_META = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("sketch", pa.binary()), ("nodes", pa.list_(pa.int64()))])
_META_SQL = "doc_id long, n long, h1 long, h2 long, sketch binary, nodes array<long>"
_ROW = pa.schema([("node", pa.int64()), ("id", pa.int64()), ("n", pa.int64()), ("sketch", pa.binary()), ("used", pa.int64()), ("label", pa.int64())])
_ROW_SQL = "node long, id long, n long, sketch binary, used long, label long"
_EDGE = pa.schema([("u", pa.int64()), ("v", pa.int64())])
_EDGE_SQL = "u long, v long"


def shingle_sets(w: _words.Words, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(two hashes of each distinct shingle, sorted; offsets by document) of each document's set of word shingles."""
    at = np.flatnonzero(w.room() >= size)
    doc, both = w.doc[at], [_words.rolling(w.hashes(k), size, k)[at] for k in (0, 1)]
    for few in range(1, size):
        short = np.flatnonzero(w.count == few)
        if len(short):
            doc = np.append(doc, short)
            both = [np.append(h, _words.mix(_words.rolling(w.hashes(k), few, k)[w.first[short]] + np.uint64(few))) for k, h in enumerate(both)]
    order = np.lexsort((both[0], doc))
    a, b, d = both[0][order], both[1][order], doc[order]
    same = (a[1:] == a[:-1]) & (d[1:] == d[:-1])
    if (same & (b[1:] != b[:-1])).any():
        order = np.lexsort((both[1], both[0], doc))
        a, b, d = both[0][order], both[1][order], doc[order]
        same = (a[1:] == a[:-1]) & (d[1:] == d[:-1])
    new = np.append(np.ones(min(len(a), 1), bool), ~(same & (b[1:] == b[:-1])))
    return a[new], b[new], np.append(0, np.cumsum(np.bincount(d[new], minlength=len(w.count))))


def set_ids(a: np.ndarray, b: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each set, as two longs."""
    full = np.flatnonzero(np.diff(offsets))
    out = np.zeros((2, len(offsets) - 1), np.uint64)
    if len(full):
        for k, (h, salt) in enumerate(((a, 0x243F6A8885A308D3), (b, 0x13198A2E03707344))):
            out[k, full] = np.add.reduceat(_words.mix(h ^ np.uint64(salt)), offsets[full])
    return out[0].view(np.int64), out[1].view(np.int64)


#: The coordinates that the trees' roots choose.
_ROOTS = np.random.default_rng(11).permutation(COORDINATES)[: TREES * BRANCHES]


def _describe(size: int):
    chosen = _ROOTS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id")
            for lo, hi, w in _words.words_of(batch.column("text"), _words.NOT_SPACE, _words.LOWER):
                h, more, offsets = shingle_sets(w, size)
                n = np.diff(offsets)
                full = np.flatnonzero(n)
                least = np.zeros((hi - lo, COORDINATES), np.uint64)
                if len(full):
                    for k in range(COORDINATES):
                        least[full, k] = np.minimum.reduceat((h ^ _SALTS[k]) * _FACTORS[k], offsets[full])
                least = _words.mix(least)
                sketch = np.ascontiguousarray((least & np.uint64(255)).astype(np.uint8))
                nodes = _words.mix(least[:, chosen] + np.arange(1, len(chosen) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)
                h1, h2 = set_ids(h, more, offsets)
                every = np.arange(hi - lo + 1, dtype=np.int32)
                yield pa.record_batch(
                    [ids.slice(lo, hi - lo), pa.array(n.astype(np.int64)), pa.array(h1), pa.array(h2), _blobs(sketch), pa.ListArray.from_arrays(pa.array(every * len(chosen)), pa.array(nodes.ravel()))],
                    schema=_META,
                )

    return run


def _blobs(rows: np.ndarray) -> pa.Array:
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(rows))])


def _sketches(column: pa.Array) -> np.ndarray:
    data, starts, _ = _words.text_buffer(column)
    return data.reshape(len(starts), COORDINATES)


def _branch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row of a large node goes to the children that the node's own coordinates name, none of them used on its path."""
    for batch in batches:
        node = batch.column("node").to_numpy().view(np.uint64)
        used = batch.column("used").to_numpy().view(np.uint64)
        sketch = _sketches(batch.column("sketch"))
        every = np.arange(len(node))
        start = _words.mix(node ^ np.uint64(0x452821E638D01377))
        stride = (start >> np.uint64(32)) | np.uint64(1)  # odd, so that all coordinates come once
        taken = used.copy()
        for _ in range(BRANCHES):
            at, open_ = np.zeros(len(node), np.uint64), np.ones(len(node), bool)
            for k in range(COORDINATES):
                next_ = (start + np.uint64(k) * stride) % np.uint64(COORDINATES)
                free = open_ & ((taken >> next_) & np.uint64(1) == 0)
                at[free] = next_[free]
                open_ &= ~free
                if not open_.any():
                    break
            bit = np.uint64(1) << at
            taken |= bit
            child = _words.mix(node + _words.mix(at * np.uint64(256) + sketch[every, at.astype(np.int64)] + np.uint64(1)))
            rows = [pa.array(child.view(np.int64)), batch.column("id"), batch.column("n"), batch.column("sketch"), pa.array((used | bit).view(np.int64)), batch.column("label")]
            yield pa.record_batch(rows, schema=_ROW).filter(pa.array(~open_))


def agree(threshold: int) -> int:
    """Sketch coordinates that must agree for a candidate at `threshold` percent: 41 of 64 at 85, 36 at 80."""
    share = threshold / 100
    return max(1, int(COORDINATES * share - SHORT * (COORDINATES * share * (1 - share)) ** 0.5))


def _labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least member of each place's connected component."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        before = label.copy()
        for ends in (a, b):
            np.minimum.at(label, label[ends], low)
            np.minimum.at(label, ends, low)
        label = label[label]
        if (label == before).all():
            break
    return label


def _compare(least_size: int, threshold: int):
    """Candidate links among the classes of each node, as a spanning forest; rows come sorted by node."""

    def some(node: np.ndarray, ids: np.ndarray, n: np.ndarray, sketch: np.ndarray) -> Iterator[pa.RecordBatch]:
        edge = np.flatnonzero(np.append(True, node[1:] != node[:-1]))
        size = np.diff(np.append(edge, len(node)))
        later = np.repeat(edge + size, size) - np.arange(len(node)) - 1
        lo = 0
        total = np.cumsum(later)
        while lo < len(node):  # whole nodes, a bounded number of pairs at once
            hi = int(np.searchsorted(total, (total[lo - 1] if lo else 0) + 400_000, side="right"))
            hi = int((edge + size)[np.searchsorted(edge + size, max(hi, lo + 1))]) if hi < len(node) else len(node)
            a = np.repeat(np.arange(lo, hi), later[lo:hi])
            b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(later[lo:hi]) - later[lo:hi], later[lo:hi])
            ok = threshold * np.maximum(n[a], n[b]) <= 100 * np.minimum(n[a], n[b])
            a, b = a[ok], b[ok]
            ok = np.zeros(len(a), bool)
            for k in range(0, len(a), 100_000):
                ok[k : k + 100_000] = (sketch[a[k : k + 100_000]] == sketch[b[k : k + 100_000]]).sum(1) >= least_size
            label = _labels(hi - lo, a[ok] - lo, b[ok] - lo)
            tied = np.flatnonzero(label != np.arange(hi - lo))
            if len(tied):
                yield pa.record_batch([pa.array(ids[lo + tied]), pa.array(ids[lo + label[tied]])], schema=_EDGE)
            lo = hi

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None
        for batch in batches:
            if not len(batch):
                continue
            new = [batch.column(k).to_numpy() for k in range(3)] + [_sketches(batch.column(3))]
            held = new if held is None else [np.concatenate(x) for x in zip(held, new, strict=True)]
            cut_at = int(np.searchsorted(held[0], held[0][-1]))
            if cut_at:
                yield from some(*(x[:cut_at] for x in held))
                held = [x[cut_at:] for x in held]
        if held is not None:
            yield from some(*held)

    return run


_TIED = pa.schema([*_ROW, ("pivot", pa.int64()), ("tie", pa.bool_())])
_TIED_SQL = f"{_ROW_SQL}, pivot long, tie boolean"


def _tie(least_size: int, threshold: int):
    """Whether each row's sketch agrees with its node's pivot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, pivot_n = batch.column("n").to_numpy(), batch.column("pivot_n").to_numpy()
            same = (_sketches(batch.column("sketch")) == _sketches(batch.column("pivot_sketch"))).sum(1)
            tie = (same >= least_size) & (threshold * np.maximum(n, pivot_n) <= 100 * np.minimum(n, pivot_n))
            yield pa.record_batch([*(batch.column(c) for c in _ROW.names), batch.column("pivot"), pa.array(tie)], schema=_TIED)

    return run


_SEAT = pa.schema([("node", pa.int64()), ("salt", pa.int64()), ("few", pa.bool_()), ("id", pa.int64()), ("n", pa.int64()), ("sketch", pa.binary())])


def _few_against_all(least_size: int, threshold: int):
    """Candidate links between the few rows that open a (node, salt) and all that follow there, as a forest for each batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, few = None, None
        for batch in batches:
            node, salt, is_few, ids, n = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(5))
            sketch = _sketches(batch.column("sketch"))
            edge = np.flatnonzero((node[1:] != node[:-1]) | (salt[1:] != salt[:-1])) + 1
            for lo, hi in zip([0, *edge.tolist()], [*edge.tolist(), len(node)], strict=True):
                if hi == lo:
                    continue
                if (node[lo], salt[lo]) != at:
                    at, few = (node[lo], salt[lo]), None
                mid = lo + int(is_few[lo:hi].sum())
                new = (ids[lo:mid], n[lo:mid], sketch[lo:mid])
                few = new if few is None else tuple(np.concatenate(x) for x in zip(few, new, strict=True))
                ends = np.append(ids[mid:hi], few[0])
                left, right, pairs = [], [], 0
                for k in range(len(few[0])):
                    if pairs > 500_000:  # a forest says the same
                        label = _labels(len(ends), np.concatenate(left), np.concatenate(right))
                        tied = np.flatnonzero(label != np.arange(len(ends)))
                        left, right, pairs = [tied], [label[tied]], len(tied)
                    same = (sketch[mid:hi] == few[2][k]).sum(1)
                    near = (same >= least_size) & (threshold * np.maximum(n[mid:hi], few[1][k]) <= 100 * np.minimum(n[mid:hi], few[1][k])) & (ids[mid:hi] != few[0][k])
                    left.append(np.flatnonzero(near))
                    right.append(np.full(len(left[-1]), hi - mid + k))
                    pairs += len(left[-1])
                label = _labels(len(ends), np.concatenate(left), np.concatenate(right)) if left else np.arange(len(ends))
                tied = np.flatnonzero(label != np.arange(len(ends)))
                if len(tied):
                    yield pa.record_batch([pa.array(ends[tied]), pa.array(ends[label[tied]])], schema=_EDGE)

    return run


def _candidates(classes: DataFrame, threshold: int) -> DataFrame:
    """(u, v): candidate links whose components hold every real link."""
    width, least_size = partitions(classes.sparkSession), agree(threshold)
    bits = F.array(*(F.lit(int(np.uint64(1 << int(k)).view(np.int64))) for k in _ROOTS))
    rows = classes.select(F.posexplode("nodes").alias("_k", "node"), "id", "n", "sketch").select("node", "id", "n", "sketch", F.get(bits, F.col("_k")).alias("used"), F.lit(None).cast("long").alias("label"))
    own = F.coalesce("label", "id")
    # a node's pivot has the least of these: rows without a label first, then by a hash whose order the shift keeps
    place = F.shiftright(F.xxhash64("node", "id"), 2) + F.when(F.col("label").isNotNull(), F.lit(1 << 62)).otherwise(F.lit(0))
    found, depth = None, 0
    while True:
        sizes = rows.groupBy("node").agg(F.count("*").alias("_c"), (F.min(own) == F.max(own)).alias("_one"), F.min(place).alias("_place"))
        large = cut(sizes.where(F.col("_c") > LIMIT).select("node", "_one", "_place"))
        number = large.count()
        sent = F.broadcast if number <= BROADCAST_NODES else lambda df: df
        small = rows.join(sent(large.select("node")), "node", "left_anti") if number else rows
        links = small.select("node", "id", "n", "sketch").repartition(width, "node").sortWithinPartitions("node").mapInArrow(_compare(least_size, threshold), _EDGE_SQL)
        found = links if found is None else found.unionByName(links)
        if not number:
            return found.distinct()
        first = F.struct(F.xxhash64("node", "id").alias("h"), "id", "n", "sketch")
        firsts = rows.withColumn("_place", place).join(sent(large.where(~F.col("_one")).select("node", "_place")), ["node", "_place"])
        pivots = firsts.groupBy("node").agg(F.min(first).alias("p")).select("node", F.col("p.id").alias("pivot"), F.col("p.n").alias("pivot_n"), F.col("p.sketch").alias("pivot_sketch"))
        tied = cut(rows.join(sent(pivots), "node").mapInArrow(_tie(least_size, threshold), _TIED_SQL))
        found = found.unionByName(tied.where("tie and id != pivot").select(F.col("id").alias("u"), F.col("pivot").alias("v")))
        # labels that the pivot ties together; a path has at most one for each of its levels
        same = F.col("tie")
        labelled = tied
        if depth:  # there are no labels yet at the roots
            merged = tied.groupBy("node").agg(F.collect_set(F.when(F.col("tie"), F.col("label"))).alias("_merged"))
            labelled, same = tied.join(sent(merged), "node"), same | F.coalesce(F.array_contains("_merged", F.col("label")), F.lit(False))
        labelled = labelled.select("node", "id", "n", "sketch", "used", F.when(same, F.col("pivot")).otherwise(F.col("label")).alias("label"))
        # all but the classes of a node's main label must meet the others yet
        counts = labelled.groupBy("node", "label").agg(F.count("*").alias("_k"))
        state = counts.groupBy("node").agg(F.sum("_k").alias("_c"), F.max(F.when(F.col("label").isNotNull(), F.struct("_k", "label"))).alias("_main"))
        others = F.col("_c") - F.col("_main._k")
        state = state.select("node", F.col("_main.label").alias("_label"), others.alias("_others"), F.ceil(F.col("_c") / SALT_ROWS).alias("_salts"), F.ceil(others / OPEN).alias("_chunks"), (others <= F.greatest(F.lit(OPEN), F.col("_c") / OPEN_SHARE)).alias("_done"))
        # a node whose classes all have its main label is settled; the others' rows are read three times from here
        labelled, depth = cut(labelled.join(sent(state.where("not _done or _others > 0")), "node")), depth + 1
        ends = labelled.where("_done and _others > 0")
        few = ends.where("label is null or label != _label").withColumn("_s", F.explode(F.expr("sequence(0L, _salts - 1)"))).withColumn("_k", F.expr("pmod(xxhash64(id, 3), _chunks)")).withColumn("few", F.lit(True))
        all_of = ends.withColumn("_s", F.expr("pmod(xxhash64(id), _salts)")).withColumn("_k", F.explode(F.expr("sequence(0L, _chunks - 1)"))).withColumn("few", F.lit(False))
        few, all_of = (x.withColumn("salt", F.expr("_s * _chunks + _k")) for x in (few, all_of))
        seats = few.select(_SEAT.names).unionByName(all_of.select(_SEAT.names)).repartition(width, "node", "salt").sortWithinPartitions("node", "salt", F.desc("few"))
        found = found.unionByName(seats.mapInArrow(_few_against_all(least_size, threshold), _EDGE_SQL))
        rows = cut(labelled.where("not _done").select("node", "id", "n", "sketch", "used", "label").mapInArrow(_branch, _ROW_SQL))


def _components_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, root) from all edges at once."""
    held = [(batch.column("u").to_numpy(), batch.column("v").to_numpy()) for batch in batches if len(batch)]
    if held:
        u, v = (np.concatenate(x) for x in zip(*held, strict=True))
        ids, place = np.unique(np.concatenate([u, v]), return_inverse=True)
        yield pa.record_batch([pa.array(ids), pa.array(ids[_labels(len(ids), place[: len(u)], place[len(u) :])])], ["id", "root"])


def components(edges: DataFrame) -> DataFrame:
    """(id, root) for each end of the edges (u, v), root being the least id of its component.

    Up to ONE_TASK_EDGES edges (16 bytes each) are settled in one task. More take
    alternating large and small stars: each round costs two shuffles of the edges, and the
    rounds grow with the logarithm of the longest path. Hubs, the ends of many edges, meet
    their edges in a broadcast, so that none is gathered in one task.
    """
    edges = cut(edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    if edges.limit(ONE_TASK_EDGES + 1).count() <= ONE_TASK_EDGES:
        return edges.repartition(1).mapInArrow(_components_of, "id long, root long")
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("_m"), F.count("*").alias("_c")).select("u", F.least("u", "_m").alias("_m"), "_c")
        hubs = cut(least.where(F.col("_c") > HUB).select("u", "_m"))
        number = hubs.limit(BROADCAST_NODES + 1).count()
        up = both.where("v > u")
        if 0 < number <= BROADCAST_NODES:
            known = up.join(F.broadcast(hubs), "u", "left").select("u", "v", "_m")
            large = known.where("_m is not null").select("v", "_m").unionByName(known.where("_m is null").select("u", "v").join(least.where(F.col("_c") <= HUB), "u").select("v", "_m"))
        else:
            large = up.join(least, "u").select("v", "_m")
        large = large.select(F.col("v").alias("u"), F.col("_m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("_m"))
        tied = large.join(low, "u")
        edges = cut(tied.where("v != _m").select(F.col("v").alias("u"), F.col("_m").alias("v")).unionByName(low.withColumnRenamed("_m", "v")).distinct())
        now = edges.agg(F.count("*").alias("n"), F.expr("bit_xor(xxhash64(u, v))").alias("x")).first()
        if (now.n, now.x) == state or not now.n:
            break
        state = (now.n, now.x)
    return edges.select(F.col("u").alias("id"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct())


# ---- links on full sets


_SET = pa.schema([("group", pa.int64()), ("id", pa.int64()), ("hashes", pa.binary())])
_SET_SQL = "group long, id long, hashes binary"


def _full_sets(size: int):
    """(group, id, hashes: the first hashes of all shingles, then the second); a row whose text isn't that of the class drops out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h1, h2 = batch.column("h1").to_numpy(), batch.column("h2").to_numpy()
            for lo, hi, w in _words.words_of(batch.column("text"), _words.NOT_SPACE, _words.LOWER):
                h, more, offsets = shingle_sets(w, size)
                a, b = set_ids(h, more, offsets)
                n = np.diff(offsets)
                to = np.arange(len(h)) + np.repeat(offsets[:-1], n)
                both = np.zeros(2 * len(h), np.uint64)
                both[to], both[to + np.repeat(n, n)] = h, more
                blobs = pa.Array.from_buffers(pa.large_binary(), hi - lo, [None, pa.py_buffer((offsets * 16).astype(np.int64)), pa.py_buffer(both)]).cast(pa.binary())
                kept = pa.array((a == h1[lo:hi]) & (b == h2[lo:hi]))
                yield pa.record_batch([batch.column("group").slice(lo, hi - lo).filter(kept), batch.column("id").slice(lo, hi - lo).filter(kept), blobs.filter(kept)], schema=_SET)

    return run


def linked(sets: list[np.ndarray], threshold: int, ids: np.ndarray) -> np.ndarray:
    """Component of each set, as its least place, over all pairs of one id or with 100 * common >= threshold * union.

    A set is its shingles' hashes, two rows; ids ascend.
    """
    n = np.array([s.shape[1] for s in sets], np.int64)
    values = np.concatenate(sets, 1)
    order = np.lexsort((values[1], values[0]))
    values = values[:, order]
    new = np.append(True, (values[:, 1:] != values[:, :-1]).any(0))
    column = np.cumsum(new) - 1
    owner = np.repeat(np.arange(len(sets)), n)[order]
    shared = np.bincount(column) > 1
    number = np.cumsum(shared) - 1
    keep = shared[column]
    column, owner = number[column[keep]], owner[keep]
    width = max(64, 4_000_000 // len(sets))
    common = np.zeros((len(sets), len(sets)), np.float32)
    for lo in range(0, int(shared.sum()), width):
        a, b = np.searchsorted(column, [lo, lo + width])
        block = np.zeros((len(sets), width), np.float32)
        block[owner[a:b], column[a:b] - lo] = 1
        common += block @ block.T
    common = common.astype(np.int64)
    left, right = np.nonzero(np.triu(100 * common >= threshold * (n[:, None] + n[None, :] - common), 1))
    one = np.flatnonzero(ids[1:] == ids[:-1])
    return _labels(len(sets), np.append(left, one), np.append(right, one + 1))


def _settle(threshold: int):
    def some(ids: list[int], sets: list[bytes]) -> Iterator[tuple[int, int]]:
        order = np.argsort(np.array(ids, np.int64), kind="stable")
        arrays = [np.frombuffer(sets[k], np.uint64).reshape(2, -1) for k in order]
        known = np.array(ids, np.int64)[order]
        label = known[linked(arrays, threshold, known)]
        tied = known != label
        yield from set(zip(known[tied].tolist(), label[tied].tolist(), strict=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, ids, sets, out = None, [], [], []
        for batch in batches:
            for g, i, s in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if g != group:
                    if len(ids) > 1:
                        out += some(ids, sets)
                    group, ids, sets = g, [], []
                ids.append(i)
                sets.append(s)
            if len(out) > 50_000:
                yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], schema=_EDGE)
                out = []
        if len(ids) > 1:
            out += some(ids, sets)
        if out:
            yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], schema=_EDGE)

    return run


def _with_texts(texts: DataFrame, seats: DataFrame) -> DataFrame:
    """seats (with id) with the texts of their classes."""
    seats = cut(seats)
    few = seats.limit(BROADCAST_SEATS + 1).count() <= BROADCAST_SEATS
    seats = F.broadcast(seats) if few else seats.hint("shuffle_hash")
    return texts.join(seats, texts["key"] == seats["id"])


def _sets(texts: DataFrame, seats: DataFrame, size: int) -> DataFrame:
    """Full sets of seats (group, id, h1, h2)."""
    return _with_texts(texts, seats).select("group", "id", "h1", "h2", "text").mapInArrow(_full_sets(size), _SET_SQL)


def _exact_links(texts: DataFrame, seats: DataFrame, size: int, threshold: int) -> DataFrame:
    """(u, v): links among the classes that share a group; seats: group, id, h1, h2."""
    width = partitions(texts.sparkSession)
    return _sets(texts, seats, size).repartition(width, "group").sortWithinPartitions("group").mapInArrow(_settle(threshold), _EDGE_SQL)


def _parts() -> Column:
    """Blocks that a group's classes make, by their number and by their shingles."""
    return F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int")


def _settled(texts: DataFrame, classes: DataFrame, candidates: DataFrame, size: int, threshold: int) -> DataFrame:
    """(id, root) of every class that has a link to another."""
    members = components(candidates).withColumnRenamed("root", "cluster")
    members = members.join(classes.select("id", "n", "h1", "h2"), "id")
    blocks = members.groupBy("cluster").agg(_parts().alias("blocks"))
    members = cut(members.join(blocks, "cluster").withColumn("block", F.pmod(F.xxhash64("id", F.lit(1)), F.col("blocks").cast("long")).cast("int")))
    at = lambda *c: F.xxhash64("cluster", *c).alias("group")
    seats = members.select(at("block"), "id", "h1", "h2")
    large = members.where("blocks > 1")
    if large.isEmpty():
        return _star(_exact_links(texts, seats, size, threshold))
    pivots = large.where(F.col("block") < PIVOTS).groupBy("cluster", "block").agg(F.min(F.struct("id", "h1", "h2", "blocks")).alias("p")).select("cluster", "p.*")
    everywhere = pivots.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    links = cut(_exact_links(texts, seats.unionByName(everywhere.select(at("block"), "id", "h1", "h2")).distinct(), size, threshold))
    roots = components(links)
    # what isn't in the largest component of its cluster is held against all of the cluster
    named = large.join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
    largest = named.groupBy("cluster", "root").count().groupBy("cluster").agg(F.max(F.struct("count", "root"))["root"].alias("_main"))
    rest = cut(named.join(largest, "cluster").where("root != _main").select("cluster", "blocks", "id", "n", "h1", "h2"))
    if rest.isEmpty():
        return roots
    pairs = cut(_rare_pairs(texts, large, rest, size, threshold))
    if pairs.isEmpty():
        return roots
    many = pairs.groupBy("u").agg(F.ceil(F.count("*") / BLOCK).alias("_parts"))
    seats = pairs.join(many, "u").withColumn("group", F.xxhash64("u", F.pmod(F.xxhash64("v"), "_parts")))
    seats = seats.select("group", F.col("u").alias("id")).unionByName(seats.select("group", F.col("v").alias("id"))).distinct()
    return components(links.unionByName(_exact_links(texts, seats.join(large.select("id", "h1", "h2"), "id").select("group", "id", "h1", "h2"), size, threshold)))


_COUNT_SQL = "cluster long, shingle long, n long"
_RARE_SQL = "cluster long, shingle long, at long, id long, n long, rest boolean"


def _count_shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(cluster, shingle, sets) of the shingles that several sets of a group share; rows come sorted by group."""
    group, held = None, []

    def out() -> pa.RecordBatch:
        values, n = np.unique(np.concatenate(held), return_counts=True)
        values, n = values[n > 1].view(np.int64), n[n > 1]
        return pa.record_batch([pa.array(np.full(len(n), group)), pa.array(values), pa.array(n)], ["cluster", "shingle", "n"])

    for batch in batches:
        for g, s in zip(batch.column("group").to_pylist(), batch.column("hashes").to_pylist(), strict=True):
            if g != group:
                if held:
                    yield out()
                group, held = g, []
            held.append(np.frombuffer(s, np.uint64).reshape(2, -1)[0])
    if held:
        yield out()


def _rarest(common, size: int, threshold: int):
    """The first shingles of each set, the rarest first, with their places: as many as one of which a similar set must share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        for batch in batches:
            h1, h2, rest = batch.column("h1").to_numpy(), batch.column("h2").to_numpy(), batch.column("rest").to_numpy(zero_copy_only=False)
            cluster, ids, least = (batch.column(c).to_numpy() for c in ("cluster", "id", "least"))
            for lo, hi, w in _words.words_of(batch.column("text"), _words.NOT_SPACE, _words.LOWER):
                h, more, offsets = shingle_sets(w, size)
                a, b = set_ids(h, more, offsets)
                rows: list[list[np.ndarray]] = [[] for _ in range(6)]
                for k in np.flatnonzero((a == h1[lo:hi]) & (b == h2[lo:hi])):
                    own = h[offsets[k] : offsets[k + 1]]
                    values, counts = common.value.get(int(cluster[lo + k]), none)
                    at = np.minimum(np.searchsorted(values, own), max(len(values) - 1, 0))
                    often = np.where(values[at] == own, counts[at], 0) if len(values) else np.zeros(len(own), np.int64)
                    smallest = max(int(least[lo + k]), -(-threshold * len(own) // 100))
                    m = len(own) - -(-threshold * (len(own) + smallest) // (100 + threshold)) + 1
                    first = own[np.lexsort((own, often))[:m]].view(np.int64)
                    for column, value in zip(rows, (np.full(m, cluster[lo + k]), first, np.arange(m), np.full(m, ids[lo + k]), np.full(m, len(own)), np.full(m, rest[lo + k])), strict=True):
                        column.append(value)
                if rows[0]:
                    yield pa.record_batch([pa.array(np.concatenate(c)) for c in rows], ["cluster", "shingle", "at", "id", "n", "rest"])

    return run


def _rare_pairs(texts: DataFrame, large: DataFrame, rest: DataFrame, size: int, threshold: int) -> DataFrame:
    """(u, v): pairs of a cluster, one of them in rest, that may be similar, by prefix filtering.

    Under any order of shingles, the larger of two similar sets has one of its first
    n - ceil(t (n + m) / (1 + t)) + 1 shingles among the first
    n - ceil(2 t n / (1 + t)) + 1 of the smaller, m being the least size that may come
    in the cluster, t n at least; and the places of the first one they share leave room
    for what they must share. So the order changes what this costs and never what it finds. It is by how
    many sets of a cluster's first block have a shingle: what a template gives to all its
    pages comes last, and isn't reached by pages that have enough of their own.
    """
    spark = texts.sparkSession
    wanted = large.join(rest.select("cluster").distinct(), "cluster")
    flagged = wanted.join(rest.select("cluster", "id").distinct().withColumn("rest", F.lit(True)), ["cluster", "id"], "left")
    flagged = flagged.join(wanted.groupBy("cluster").agg(F.min("n").alias("least")), "cluster")
    flagged = flagged.select("cluster", "id", "h1", "h2", "least", F.coalesce("rest", F.lit(False)).alias("rest"))
    first = _sets(texts, wanted.where("block = 0").select(F.col("cluster").alias("group"), "id", "h1", "h2"), size)
    counts = first.repartition(partitions(spark), "group").sortWithinPartitions("group").mapInArrow(_count_shared, _COUNT_SQL)
    listed = counts.orderBy(F.desc("n"), "shingle", "cluster").limit(COMMON).orderBy("cluster").toArrow().to_pandas()
    common = {}
    for c, g in listed.groupby("cluster"):
        values = g["shingle"].to_numpy().view(np.uint64)
        order = np.argsort(values)
        common[int(c)] = (values[order], g["n"].to_numpy()[order])
    sent = spark.sparkContext.broadcast(common)
    joined = _with_texts(texts, flagged)
    rare = cut(joined.select("cluster", "id", "h1", "h2", "least", "rest", "text").mapInArrow(_rarest(sent, size, threshold), _RARE_SQL))
    probe = rare.select("cluster", "shingle", *(F.col(c).alias(f"_{c}") for c in ("at", "id", "n", "rest")))
    index = rare.where(F.col("at") <= F.col("n") - F.ceil(2 * threshold * F.col("n") / (100 + threshold)))
    both = index.join(probe, ["cluster", "shingle"]).where("(rest or _rest) and id != _id and _n >= n")
    need = F.ceil(threshold * (F.col("n") + F.col("_n")) / (100 + threshold))
    room = F.least(F.col("n") - F.col("at"), F.col("_n") - F.col("_at"))
    return both.where((100 * F.col("n") >= threshold * F.col("_n")) & (room >= need)).select(F.least("id", "_id").alias("u"), F.greatest("id", "_id").alias("v")).distinct()


def _star(links: DataFrame) -> DataFrame:
    """Components from forests that don't touch: each group gave its own, rooted at its least member."""
    return cut(links.select(F.col("u").alias("id"), F.col("v").alias("root")).distinct())


def _keyed(size: int):
    """(key, text): the key that a set without any id goes by."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, w in _words.words_of(batch.column("text"), _words.NOT_SPACE, _words.LOWER):
                a, _ = set_ids(*shingle_sets(w, size))
                yield pa.record_batch([pa.array((a.view(np.uint64) >> np.uint64(2)).view(np.int64) + NAMELESS), batch.column("text").slice(lo, hi - lo)], ["key", "text"])

    return run


def near_duplicates(docs: DataFrame, shingle: int = 5, threshold: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for each row of docs.

    Documents whose sets of distinct `shingle`-word shingles have a Jaccard similarity
    of at least `threshold` percent are linked; component_id is the least doc_id that
    is reachable, kept marks the document that has it. Fewer words make one shingle;
    null, empty and blank texts have none and are linked with nothing. Rows that share
    a doc_id are one document. Rows without a doc_id are linked like others and get the
    least doc_id that they reach, else null; they are kept unless there is one. Ids are
    under 2 ** 62. A very long text is one set, of any size: its shingles are sorted in
    one task, and it is sent whole to be compared. An empty table gives no rows. Other
    columns are not read.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    meta = cut(texts.mapInArrow(_describe(shingle), _META_SQL))
    named = F.coalesce("doc_id", F.shiftrightunsigned("h1", 2) + F.lit(NAMELESS))
    classes = cut(meta.where("n > 0").groupBy("h1", "h2").agg(F.min(named).alias("id"), F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.first("nodes").alias("nodes")))
    keyed = texts.where("doc_id is not null").select(F.col("doc_id").alias("key"), "text")
    if not meta.where("doc_id is null").isEmpty():
        keyed = keyed.unionByName(texts.where("doc_id is null").select("text").mapInArrow(_keyed(shingle), "key long, text string"))
    roots = _settled(keyed, classes, _candidates(classes, threshold), shingle, threshold)
    root = F.coalesce("root", "id")
    found = classes.select("h1", "h2", "id").join(roots, "id", "left").select("h1", "h2", F.when(root < NAMELESS, root).alias("_root"))
    out = meta.select("doc_id", "n", "h1", "h2").join(found, ["h1", "h2"], "left")
    component = F.when(F.col("n") > 0, F.col("_root")).otherwise(F.col("doc_id"))
    out = out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))
    return out.withColumn("kept", F.when(F.col("doc_id").isNull(), F.col("component_id").isNull()).otherwise(F.col("doc_id") == F.col("component_id")))


#: Ids that are sent to all tasks, at most (8 bytes each).
BROADCAST_IDS = 500_000


def keep_one(docs: DataFrame, shingle: int = 5, threshold: int = 80) -> DataFrame:
    """The rows of docs whose document is kept, with all their columns.

    Rows that share a doc_id are one document and stay or go together; rows without a
    doc_id stay.
    """
    gone = near_duplicates(docs, shingle, threshold).where("not kept and doc_id is not null").select("doc_id").distinct()
    return docs.join(checked_broadcast(gone, BROADCAST_IDS), "doc_id", "left_anti").select(docs.columns)


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), shingle=3, threshold=85)


OP2_SQL = r"""
WITH RECURSIVE docs AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, md5_number(array_to_string(w[k + 1 : k + 3], ' ')) AS h FROM docs, LATERAL (SELECT unnest(range(0, greatest(1, len(w) - 2))) AS k) WHERE len(w) > 0
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM shingles a JOIN shingles b ON a.h = b.h AND a.doc_id < b.doc_id
  JOIN sizes x ON x.doc_id = a.doc_id JOIN sizes y ON y.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 85 * (x.n + y.n - count(*))
), both_ways AS (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach(a, b) AS (
  SELECT doc_id, doc_id FROM docs UNION SELECT r.a, e.b FROM reach r JOIN both_ways e ON r.b = e.a
), roots AS (
  SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a
)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept FROM docs d JOIN roots USING (doc_id) LEFT JOIN sizes USING (doc_id)
"""
