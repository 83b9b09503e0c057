import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions.signals import round_4
from tidemark.operators import curate, sampling


def mixed(x, seed):
    """The same words in plain Python."""
    y = (x % 2**31 * sampling.MIX[0] + (x >> 31) % 2**31 + seed * 40503) % 2**32
    for m, shift in ((sampling.MIX[1], 16), (sampling.MIX[2], 15)):
        y = (y ^ y >> shift) % 2**31 * m % 2**32 + (y >> 31)
    return (y ^ y >> 16) % 2**31


def test_mixed_is_the_same_arithmetic(spark):
    numbers = [0, 1, 2, 2**31 - 1, 2**31, 2**40 + 7, 2**62 - 1]
    for seed in (0, 3, 1000):
        got = spark.createDataFrame([(x,) for x in numbers], "x long").select("x", sampling.mixed(F.col("x"), seed).alias("y")).collect()
        assert {r.x: r.y for r in got} == {x: mixed(x, seed) for x in numbers}


def test_ranks_are_dense_and_alike_for_any_buckets_and_partitions(spark):
    rows = spark.range(500).select(F.col("id").alias("key"), F.when(F.col("id") % 7 > 0, F.col("id") % 7).alias("label"))
    want = None
    for buckets, parts in ((1, 1), (64, 3), (1000, 7), (sampling.BUCKETS, 2)):
        got = sorted(map(tuple, sampling.hash_ranked(rows.repartition(parts), "r", "key", ["label"], buckets=buckets).select("key", F.coalesce("label", F.lit(-1)), "r").collect()))
        want = want or got
        assert got == want
    by = {}
    for key, label, r in want:
        by.setdefault(label, []).append((r, mixed(key, 0)))
    assert all([r for r, _ in sorted(v)] == list(range(len(v))) and [m for _, m in sorted(v)] == sorted(m for _, m in v) for v in by.values())


def test_drawn_rows(spark):
    n = {"a": 4000, "b": 40, "c": 1, None: 7}
    rows = spark.createDataFrame([(k, label) for label, m in n.items() for k in range(m)], "key long, label string")
    results = [sorted(map(tuple, sampling.with_replacement(rows.repartition(p), "key", "label", 42, b).collect()), key=str) for p, b in ((1, 1), (5, 64), (3, 1000))]
    assert results[0] == results[1] == results[2]
    copies = Counter()
    for _, label, c in results[0]:
        copies[label] += c + 1
    assert copies == {label: 4000 for label in n}
    drawn = np.array([c for _, label, c in results[0] if label == "b"])
    chi = ((drawn - drawn.mean()) ** 2 / drawn.mean()).sum()
    assert 39 - 4 * math.sqrt(78) < chi < 39 + 4 * math.sqrt(78)  # 40 rows, 3,960 draws of equal chance
    again = sampling.with_replacement(rows, "key", "label", 43).where("label = 'b'").collect()
    assert [r.copies for r in sorted(again)] != [c for _, label, c in results[0] if label == "b"]


def test_draws_in_chunks(spark, monkeypatch):
    rows = spark.createDataFrame([(k, "a") for k in range(300)] + [(k, "b") for k in range(3)], "key long, label string")
    want = sorted(map(tuple, sampling.with_replacement(rows, "key", "label").collect()))
    monkeypatch.setattr(sampling, "CHUNK", 7)
    assert sorted(map(tuple, sampling.with_replacement(rows, "key", "label").collect())) == want
    assert sampling.with_replacement(rows.limit(0), "key", "label").collect() == []


@pytest.mark.parametrize("n", [1, 2, 3, 7, 101, 1000, 4099])
def test_permutation(spark, n):
    places = lambda seed: [r.p for r in spark.range(n).select(sampling.permuted(F.col("id"), n, seed).alias("p")).collect()]
    one, two = places(1), places(2)
    assert sorted(one) == sorted(two) == list(range(n))
    if n > 100:
        assert one != two
        for a, b in ((one[:-1], one[1:]), (one, range(n)), (one, two)):
            assert abs(np.corrcoef(a, b)[0, 1]) < 4 / math.sqrt(n)


def test_shuffle_has_no_runs_of_neighbours(spark):
    got = curate.shuffled(spark.range(2000).withColumnRenamed("id", "key"), "key", seed=7).orderBy("place").collect()
    keys = [r.key for r in got]
    assert [r.place for r in got] == list(range(2000)) and sorted(keys) == list(range(2000))
    assert abs(np.corrcoef(keys[:-1], keys[1:])[0, 1]) < 0.1


def test_round_4_is_pythons(spark):
    rnd = random.Random(3)
    values = [0.00005, 0.00015, 2.67495, 1.00005, -0.00015, 0.5**13, -0.0, 1e300, float("inf"), 12345678.00005, 549755813887.99995, 549755813888.00005]
    for k in range(10_000):
        values.append((rnd.uniform(-100, 100), rnd.randrange(-(10**7), 10**7) / 1e5, (rnd.randrange(-(10**9), 10**9) * 2 + 1) / 2 ** rnd.randrange(5, 30), rnd.randrange(1, 10**16) / 10 ** rnd.randrange(5, 16))[k % 4])
    got = spark.createDataFrame(list(enumerate(values)), "k int, x double").select("k", round_4("x").alias("y")).orderBy("k").collect()
    assert [(x, r.y) for x, r in zip(values, got)] == [(x, round(x, 4) if math.isfinite(x) else x) for x in values]
    assert [round(x, 4) for x in values[:4]] == [0.0001, 0.0001, 2.6749, 1.0001]
