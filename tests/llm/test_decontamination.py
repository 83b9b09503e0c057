import hashlib
import random
import re

import pytest

from tidemark.llm import decontamination as dc

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
FOLD = str.maketrans({c: chr(c + 32) for c in range(65, 91)})


def words(text):
    return WORD.findall((text or "").translate(FOLD))


def brute(docs, bench, n=10):
    out = []
    for i, text in docs:
        w, hit, items = words(text), set(), set()
        for item, t in bench:
            b = words(t)
            size = min(n, len(b))
            wins = {tuple(b[k : k + size]) for k in range(len(b) - size + 1)} if b else set()
            for s in range(len(w) - size + 1):
                if tuple(w[s : s + size]) in wins:
                    hit.update(range(s, s + size))
                    items.add(str(item))
        out.append((i, len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()))
    return sorted(out, key=str)


def corpus(seed):
    rng = random.Random(seed)
    vocab = ["é%d" % k for k in range(8)] + ["X", "y9", "ZÉ"]
    seps = [" ", "\n", ", ", " - ", "_", "...", "\x7f"]
    make = lambda n: "".join(rng.choice(vocab) + rng.choice(seps) for _ in range(n))
    bench = [(k, make(rng.randrange(0, 25))) for k in range(12)] + [(50, None), (51, "...!"), (52, "y9 X"), (9, "y9 y9 y9")]
    docs = []
    for i in range(60):
        parts = [make(rng.randrange(0, 15)) for _ in range(rng.randrange(0, 4))]
        if rng.random() < 0.6:
            parts.insert(0, (rng.choice(bench)[1] or "").lower())
        docs.append((i, "".join(parts)))
    return docs + [(100, None), (101, ""), (None, "a b y9 X c"), (3, docs[3][1])], bench


def run(spark, docs, bench, n=10):
    d = spark.createDataFrame([(i, t, "q") for i, t in docs], "doc_id long, text string, items string")
    b = spark.createDataFrame(bench, "item_id long, text string")
    rows = dc.find_contamination(d, b, n).collect()
    for r in rows:
        text = dict(docs)[r.doc_id] or ""
        w = words(text)
        assert [words(text[s.start : s.end]) for s in r.spans] == [w[h.start : h.end] for h in r.hits]
    return sorted(((r.doc_id, r.n_words, r.n_hit, len(r["items"]), hashlib.sha256(",".join(sorted(r["items"])).encode()).hexdigest()) for r in rows), key=str)


def test_matches_brute_force(spark):
    docs, bench = corpus(1)
    assert run(spark, docs, bench) == brute(docs, bench)


def test_short_windows(spark):
    docs, bench = corpus(2)
    assert run(spark, docs, bench, 3) == brute(docs, bench, 3)


def test_empty_tables(spark):
    docs, bench = corpus(3)
    assert run(spark, [], bench) == []
    assert run(spark, docs, []) == brute(docs, [])


def test_item_without_id(spark):
    assert run(spark, [(1, "a b c")], [(None, "b")])[0][2:4] == (1, 0)


@pytest.mark.parametrize("most,piece", [(5, 3), (40, 10_000), (60, 1)])
def test_items_beyond_one_automaton(spark, monkeypatch, most, piece):
    monkeypatch.setattr(dc, "MOST_WORDS", most)
    monkeypatch.setattr(dc, "PIECE", piece)
    docs, bench = corpus(3)
    docs, bench = docs[:40], bench[:4] + bench[-4:]
    assert run(spark, docs, bench, 4) == brute(docs, bench, 4)
    rows = spark.createDataFrame(docs, "doc_id long, TEXT string")
    got = dc.keep_clean(rows, spark.createDataFrame(bench, "item_id long, text string"), 4).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(str(d) for d in docs if not brute([d], bench, 4)[0][2])


def test_very_long_text(spark):
    docs = [(1, "a b " * 2_500_000 + "the item has five words " + "x" * 1_000_000)]
    assert run(spark, docs, [(7, "The item has FIVE words!")])[0][:4] == (1, 5_000_006, 5, 1)


def test_keep_clean(spark):
    docs, bench = corpus(4)
    rows = spark.createDataFrame([(i, t, "c") for i, t in docs], "doc_id long, text string, lang string")
    got = dc.keep_clean(rows, spark.createDataFrame(bench, "item_id long, text string")).collect()
    hit = {(i, t) for i, t in docs if brute([(i, t)], bench)[0][2]}
    assert sorted(map(str, map(tuple, got))) == sorted(str((i, t, "c")) for i, t in docs if (i, t) not in hit)


@pytest.mark.parametrize("base", [2, 3, 64])
def test_windows_in_any_base(monkeypatch, base):
    monkeypatch.setattr(dc, "BASE", base)
    docs, bench = corpus(6)
    windows = dc.Windows([(str(i), dc._automaton.words((t or "").encode())) for i, t in bench], 5)
    assert len(set(windows.digits.values())) == len(windows.digits)
    for i, t in docs:
        w = dc._automaton.words((t or "").encode())
        which, end = windows.places(w)
        hit = {p for k, e in zip(which.tolist(), end.tolist()) for p in range(e - int(windows.length[k]) + 1, e + 1)}
        _, n, n_hit, n_items, _ = brute([(i, t)], bench, 5)[0]
        assert (len(w), len(hit), len(set().union(*(windows.items[k] for k in which.tolist())))) == (n, n_hit, n_items)
        assert windows.any_place(w) == (n_hit > 0)
