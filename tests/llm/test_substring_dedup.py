import hashlib
import random
import re

import pytest

from tidemark.llm import substring_dedup as sd

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, n=20):
    """Per (doc_id, text) row, in doc_id order with null first."""
    key = lambda i: -(1 << 63) if i is None else i
    first = {}
    for i, text in rows:
        w = WORD.findall(text or "")
        for s in range(len(w) - n + 1):
            at = (key(i), s)
            k = tuple(w[s : s + n])
            first[k] = min(first.get(k, at), at)
    out = []
    for i, text in rows:
        w = WORD.findall(text or "")
        gone = set()
        for s in range(len(w) - n + 1):
            if first[tuple(w[s : s + n])] != (key(i), s):
                gone.update(range(s, s + n))
        kept = " ".join(x for p, x in enumerate(w) if p not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def run(spark, rows, n=20, extra=False):
    df = spark.createDataFrame([(i, t, "a", "b") for i, t in rows], "doc_id long, text string, ids string, _db string")
    if not extra:
        df = df.drop("ids", "_db")
    got = sd.remove_repeated_windows(df, n).collect()
    for r in got:
        assert sum(s.end - s.start for s in r.removed) == r.n_removed
    return sorted(((r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.kept_text.encode()).hexdigest()) for r in got), key=str)


def corpus(seed, n=60):
    rng = random.Random(seed)
    vocab = ["wé%d" % k for k in range(30)]
    passages = [[rng.choice(vocab) for _ in range(rng.randrange(15, 60))] for _ in range(4)]
    rows = []
    for i in range(n):
        w = []
        for _ in range(rng.randrange(0, 5)):
            w += rng.choice(passages) if rng.random() < 0.5 else [rng.choice(vocab) for _ in range(rng.randrange(0, 40))]
        rows.append((i * 3, rng.choice([" ", "\n", " \t "]).join(w)))
    return rows + [(1, None), (4, ""), (7, "a " * 100), (None, rows[0][1]), (None, rows[0][1]), (10, rows[5][1])]


@pytest.mark.parametrize("chunk", [50, 4_000_000])
def test_matches_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(sd, "CHUNK", chunk)
    rows = corpus(1)
    assert run(spark, rows, extra=True) == brute(rows)


@pytest.mark.parametrize("n", [3, 16, 40])
def test_other_lengths(spark, n):
    rows = corpus(2, 30)
    assert run(spark, rows, n) == brute(rows, n)


def test_repeated_rows_are_one_occurrence(spark):
    rows = [(1, "x y z " * 20), (1, "x y z " * 20), (2, " ".join(map(str, range(30))))]
    assert run(spark, rows) == brute(rows)


def test_empty_table(spark):
    assert run(spark, []) == []


def test_levels():
    assert sd.levels(20) == [5, 10, 20]
    assert sd.levels(80) == [5, 10, 20, 40, 80]
    assert sd.levels(16) == [8, 16]
    assert sd.levels(7) == [7]


@pytest.mark.parametrize("n", [1024, 4096])
def test_words_that_a_polynomial_would_confuse(spark, n):
    a = [0]
    while len(a) < n:
        a += [1 - x for x in a]
    x, y = "".join("ab"[k] for k in a), "".join("ba"[k] for k in a)
    rows = [(1, f"{x} " * 20), (2, f"{y} " * 20), (3, " ".join([x, y] * 10)), (4, " ".join([y, x] * 10))]
    got = run(spark, rows)
    assert got == brute(rows) and all(r[2] == 0 for r in got)


def test_rows_without_an_id_are_texts_of_their_own(spark):
    passage = " ".join(f"p{k}" for k in range(30))
    rows = [(None, passage), (None, "other words first " + passage), (None, " ".join(f"q{k}" for k in range(30))), (5, passage)]
    got = run(spark, rows)
    assert [r[:3] for r in got if r[0] == 5] == [(5, 30, 30)]
    assert sorted(r[2] for r in got if r[0] is None) == [0, 0, 30]


def test_nothing_repeats(spark):
    rows = [(k, " ".join(f"{k}w{i}" for i in range(50))) for k in range(5)]
    assert run(spark, rows) == brute(rows)


def test_very_long_text(spark):
    words = [f"w{k}" for k in range(1_200_000)]  # some 10 MB
    rows = [(1, " ".join(words)), (2, " ".join(words[500:900])), (3, "y" * 10_000_000)]
    assert [r[:3] for r in run(spark, rows)] == [(1, 1_200_000, 0), (2, 400, 400), (3, 1, 0)]


def test_buckets_follow_the_size(spark, monkeypatch):
    monkeypatch.setattr(sd, "BUCKET_BYTES", 1 << 10)
    rows = corpus(3)
    assert run(spark, rows) == brute(rows)


@pytest.mark.parametrize(("shared", "looked_up"), [(0, 1), (7, 2), (15, 2), (19, 2), (20, 2)])
def test_levels_stop_when_no_candidate_is_left(spark, monkeypatch, shared, looked_up):
    words = lambda k, n: [f"{k}w{i}" for i in range(n)]
    rows = [(k, " ".join(words(k, 25) + words("all", shared) + words(f"{k}z", 25))) for k in range(6)]
    found = []
    real = sd.cut
    monkeypatch.setattr(sd, "cut", lambda df: (lambda c: found.append(c.isEmpty()) or c)(real(df)))
    assert run(spark, rows) == brute(rows)
    assert len(found) == looked_up and found[-1] == (shared < 15)


def test_buckets_go_by_the_bytes_of_texts(spark, monkeypatch):
    rows = [(k, "same words again and again " * 400) for k in range(40)]
    seen = []
    real = sd._first_lookup
    monkeypatch.setattr(sd, "_first_lookup", lambda n, level, buckets, docs: seen.append(buckets) or real(n, level, buckets, docs))
    monkeypatch.setattr(sd, "BUCKET_BYTES", 10_000)
    assert run(spark, rows) == brute(rows)
    assert seen == [sum(len(t) for _, t in rows) // 10_000 + 2]
