import hashlib
import random

import pytest
import xxhash
from pyspark.sql import functions as F

from tidemark.llm import fingerprint as fp


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 3) for i, t in rows], "doc_id long, text string, b int")


def prints(spark, *texts):
    rows = fp.fingerprints(frame(spark, list(enumerate(texts)))).collect()
    return [r.fingerprint for r in sorted(rows)]


def corpus(n, seed=5):
    rng = random.Random(seed)
    vocab = ["wé%d" % k for k in range(2000)]
    text = lambda: "\n".join(" ".join(rng.choice(vocab) for _ in range(rng.randrange(1, 30))) for _ in range(rng.randrange(1, 6)))
    rows = [(rng.randrange(10**6) * 7, text()) for _ in range(n)]
    return rows + [(5, None), (6, ""), (-3, "x"), (rows[0][0], rows[0][1]), (rows[1][0], "other"), (None, "nil"), (1, "🙂" * 9), (2, rows[2][1])]


def brute(rows):
    rows = sorted(((-(1 << 63) if i is None else i, t or "") for i, t in rows))
    out = []
    for k, (i, t) in enumerate(rows):
        follower = rows[(k + 1) % len(rows)][1]
        q = len(t) // 4
        out.append((None if i == -(1 << 63) else i, len(t), t[: len(t) - q] + follower[:q], t, follower))
    return out


@pytest.mark.parametrize("range_rows", [3, 1000])
def test_edited_texts_and_likeness(spark, monkeypatch, range_rows):
    monkeypatch.setattr(fp, "RANGE_ROWS", range_rows)
    rows = corpus(60)
    got = fp.edited_fingerprints(frame(spark, rows)).collect()
    want = brute(rows)
    assert sorted(((r.doc_id, r.n_chars, r.edited_sha256) for r in got), key=str) == sorted(((i, n, hashlib.sha256(e.encode()).hexdigest()) for i, n, e, _, _ in want), key=str)
    by = {}
    for i, _, e, t, follower in want:
        by[(i, hashlib.sha256(e.encode()).hexdigest())] = (t, e, follower)
    alone = dict(zip((texts := sorted({x for v in by.values() for x in v})), prints(spark, *texts), strict=True))
    for r in got:
        t, e, follower = by[(r.doc_id, r.edited_sha256)]
        assert r.fingerprint == alone[t] and r.edited_fingerprint == alone[e]
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        assert t != e or r.near_edited == 1.0
        assert t != follower or r.near_next == 1.0
    long = [r for r in got if r.n_chars > 200]
    assert sum(r.near_edited for r in long) / len(long) > 0.6 > 0.2 > sum(r.near_next for r in long) / len(long)


def test_one_and_no_row(spark):
    (r,) = fp.edited_fingerprints(frame(spark, [(4, "abcdefgh")])).collect()
    assert (r.doc_id, r.n_chars, r.edited_sha256, r.near_next) == (4, 8, hashlib.sha256(b"abcdefab").hexdigest(), 1.0)
    assert fp.edited_fingerprints(frame(spark, [])).collect() == []


def test_order_independent_and_distinct(spark):
    a, b, c, d, e = prints(spark, "p one\nq two\np one", "p one\np one\nq two", "p one\nq two", "", None)
    assert a == b != c and d == e != c
    assert len(set(prints(spark, *(f"text {k}" for k in range(200))))) == 200


def test_insert_and_delete(spark):
    a, b, both = prints(spark, "x y\nz", "u v w", "x y\nz\nu v w")
    row = spark.createDataFrame([(a, b, both)], "a string, b string, ab string")
    got = row.select(fp.insert(F.col("a"), F.col("b")), fp.delete(F.col("ab"), F.col("b")), fp.likeness(F.col("a"), F.col("a"))).first()
    assert tuple(got) == (both, a, 1.0)


def spark_hash(*values):
    """xxhash64 of Spark over strings, and 32-bit numbers; a column's hash seeds the next one's."""
    h = 42
    for v in values:
        h = xxhash.xxh64(v.encode() if isinstance(v, str) else v.to_bytes(4, "little"), seed=h).intdigest()
    return h


def brute_fingerprint(text):
    exact, near = [0] * fp.EXACT, [0] * fp.NEAR
    for p in (text or "").split("\n"):
        for seed in range(fp.EXACT // 2):
            h = spark_hash(seed, p)
            exact[2 * seed] += h & 0xFFFFFFFF
            exact[2 * seed + 1] += h >> 32
        w = p.split(" ")
        for a, b in zip(w, w[1:] + [None], strict=True):
            h = spark_hash(a, b) if b is not None else spark_hash(a)
            for k in range(fp.NEAR // 2):
                near[2 * k] += 1 if h >> k & 1 else -1
                near[2 * k + 1] += 1 if h >> (k + 32) & 1 else -1
    return "".join(f"{x & 0xFFFFFFFF:08x}" for x in exact + near), near


def brute_likeness(a, b):
    both = sum(x * x for x in a) + sum(x * x for x in b)
    return min(1.0, max(0.0, 2 * sum(x * y for x, y in zip(a, b, strict=True)) / both)) if both else 1.0


def test_fingerprints_and_likeness_match_plain_python(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").unionByName(frame(spark, [(-5, "x"), (-4, None), (-3, "a b\n\na b"), (-2, "🙂 é 🙂\n")]).select("doc_id", "text"))
    want = {}
    for i, _, e, t, follower in brute([tuple(r) for r in docs.collect()]):
        (f, a), (g, b), (_, c) = brute_fingerprint(t), brute_fingerprint(e), brute_fingerprint(follower)
        want[i] = (f, g, pytest.approx(brute_likeness(a, b)), pytest.approx(brute_likeness(a, c)))
    got = {r.doc_id: (r.fingerprint, r.edited_fingerprint, r.near_edited, r.near_next) for r in fp.edited_fingerprints(docs).collect()}
    assert got == want


def test_likeness_is_that_of_the_fingerprints(spark):
    long = "a " * 400_000 + " ".join(f"w{k}" for k in range(900)) + "\n" + "z" * 10_000_000
    rows = [(1, long), (2, "b c d " * 300_000), (3, "a " * 400_000), *((k, f"text {k} " * 9) for k in range(4, 9))]
    out = fp.edited_fingerprints(frame(spark, rows))
    got = out.select("doc_id", "near_edited", fp.likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("again")).collect()
    assert len(got) == 8 and all(r.near_edited == pytest.approx(r.again) for r in got)
