import random
import re
from collections import Counter

import numpy as np
import pytest

from tidemark.llm import near_dedup as nd

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = str.maketrans({c: chr(c + 32) for c in range(65, 91)})


def shingles(text, size=3):
    w = WORD.findall((text or "").translate(FOLD))
    return frozenset(tuple(w[k : k + size]) for k in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)]) if w else frozenset()


def brute(rows, threshold=85, size=3):
    sets = [shingles(t, size) for _, t in rows]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= threshold * len(sets[i] | sets[j]):
                a, b = sorted((find(rows[i][0]), find(rows[j][0])))
                root[b] = a
    return sorted((i, len(s), find(i), find(i) == i) for (i, _), s in zip(rows, sets, strict=True))


def corpus(seed, groups=14, size=9, words=80):
    rng = random.Random(seed)
    vocab = ["w%d" % k for k in range(400)] + ["É%d" % k for k in range(50)]
    common = [rng.choice(vocab) for _ in range(30)]
    rows, k = [], 0
    for _ in range(groups):
        base = [rng.choice(vocab) for _ in range(rng.randrange(5, words))] + (common if rng.random() < 0.5 else [])
        for _ in range(rng.randrange(1, size)):
            w = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 3, 5])):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            if rng.random() < 0.2:
                w = [x.upper() for x in w]
            rows.append((1000 - k * 7, " ".join(w)))
            k += 1
    return rows + [(2000, None), (2001, ""), (2002, " \n "), (2003, "one"), (2004, "ONE"), (2005, "one two"), (2006, "two one")]


def run(spark, rows, shingle=3, threshold=85):
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, n int")
    return sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in nd.near_duplicates(df, shingle, threshold).collect())


def test_matches_brute_force(spark):
    rows = corpus(3)
    assert run(spark, rows) == brute(rows)


@pytest.mark.parametrize("block", [1500, 6])
def test_large_nodes_and_groups(spark, monkeypatch, block):
    monkeypatch.setattr(nd, "LIMIT", 4)
    monkeypatch.setattr(nd, "BLOCK", block)
    monkeypatch.setattr(nd, "PIVOTS", 2)
    rows = corpus(4, groups=5, size=40)
    assert run(spark, rows) == brute(rows)


def test_no_id_and_repeated_rows(spark):
    got = Counter(map(str, run_any(spark, [(None, "a b c d"), (5, "a b c d"), (5, "a b c d"), (None, "x y z"), (None, None), (6, None)])))
    assert got == Counter(map(str, [(None, 2, 5, False), (5, 2, 5, True), (5, 2, 5, True), (None, 1, None, True), (None, 0, None, True), (6, 0, 6, True)]))


def run_any(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return [tuple(r) for r in nd.near_duplicates(df, 3, 85).select("doc_id", "n_shingles", "component_id", "kept").collect()]


def test_empty_table(spark):
    assert run(spark, []) == []


def test_labels_find_long_paths():
    n = 200
    order = np.random.default_rng(0).permutation(n)
    assert (nd._labels(n, order[:-1], order[1:]) == 0).all()


@pytest.mark.parametrize("hub", [2, 1000])
def test_components_in_one_task_and_in_rounds(spark, monkeypatch, hub):
    rng = random.Random(hub)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(180)] + [(1000, k) for k in range(1001, 1060)] + [(k, k + 1) for k in range(2000, 2040)] + [(7, 7)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    want = sorted((x, find(x)) for x in {y for a, b in edges if a != b for y in (a, b)})
    df = spark.createDataFrame(edges, "u long, v long")
    assert sorted(map(tuple, nd.components(df).collect())) == want
    monkeypatch.setattr(nd, "ONE_TASK_EDGES", 0)
    monkeypatch.setattr(nd, "HUB", hub)
    assert sorted(map(tuple, nd.components(df).collect())) == want


def test_lower_thresholds_match_brute_force(spark):
    assert (nd.agree(85), nd.agree(80)) == (41, 36)
    rows = []
    for k in range(30):  # pairs that share 78 of 122 shingles, and no third document that would tie them
        words = [f"d{k}w{i}" for i in range(102)]
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(words[:40] + [f"x{w}" for w in words[40:60]] + words[60:]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in nd.near_duplicates(df, 3, 60).collect())
    assert got == brute(rows, 60)


def thue_morse(n):
    a = [0]
    while len(a) < n:
        a += [1 - x for x in a]
    return "".join("ab"[x] for x in a), "".join("ba"[x] for x in a)


@pytest.mark.parametrize("n", [1024, 4096])
def test_words_that_a_polynomial_would_confuse(spark, n):
    a, b = thue_morse(n)
    rows = [(1, f"x y {a} z"), (2, f"x y {b} z"), (3, f"{a} {b} {a} {b} q"), (4, f"{b} {a} {b} {a} q")]
    assert run(spark, rows) == brute(rows) and all(r[3] for r in run(spark, rows))


@pytest.mark.parametrize("open_", [6, 4096])
def test_five_words_and_hot_groups(spark, monkeypatch, open_):
    monkeypatch.setattr(nd, "LIMIT", 4)
    monkeypatch.setattr(nd, "OPEN", open_)
    monkeypatch.setattr(nd, "SALT_ROWS", 7)
    monkeypatch.setattr(nd, "HUB", 3)
    monkeypatch.setattr(nd, "ONE_TASK_EDGES", 0)
    rows = corpus(9, groups=4, size=60, words=120)
    assert run(spark, rows, 5, 80) == brute(rows, 80, 5)


def test_boilerplate_links_nothing_and_is_settled_nowhere(spark, monkeypatch):
    rng = random.Random(2)
    footer = " ".join(f"f{k}" for k in range(80))
    rows = [(k, " ".join(f"w{rng.randrange(10**6)}" for _ in range(80)) + " " + footer) for k in range(3000)]
    seats = []
    real = nd._exact_links
    monkeypatch.setattr(nd, "_exact_links", lambda texts, s, *a: seats.append(s.count()) or real(texts, s, *a))
    got = run(spark, rows)
    assert all(i == root and kept for i, _, root, kept in got) and len(got) == 3000
    assert sum(seats) < 300  # chance candidates only, not the group with the footer


@pytest.mark.parametrize("n", [4000, 8000])
def test_pages_of_a_template_are_settled_in_linear_room(spark, monkeypatch, n):
    rng = random.Random(3)
    template = [f"t{k}" for k in range(90)]
    rows = [(k, " ".join(template + [f"w{rng.randrange(10**7)}" for _ in range(12)])) for k in range(n)]  # likeness 0.786
    seats, pairs = [], []
    real, real_pairs = nd._exact_links, nd._rare_pairs
    monkeypatch.setattr(nd, "_exact_links", lambda texts, s, *a: seats.append(s.count()) or real(texts, s, *a))
    monkeypatch.setattr(nd, "_rare_pairs", lambda *a: (lambda p: pairs.append(p.count()) or p)(nd.cut(real_pairs(*a))))
    got = run(spark, rows)
    assert len(got) == n and all(i == root and kept for i, _, root, kept in got)
    assert sum(seats) <= 2 * n and sum(pairs) <= n // 100 and (pairs or sum(seats) < n)


@pytest.mark.parametrize(("block", "common"), [(5, 500_000), (9, 3), (3, 0)])
def test_links_outside_a_clusters_main_part(spark, monkeypatch, block, common):
    monkeypatch.setattr(nd, "BLOCK", block)
    monkeypatch.setattr(nd, "COMMON", common)
    monkeypatch.setattr(nd, "PIVOTS", 1)
    rng = random.Random(block)
    template, rows = [f"t{k}" for k in range(60)], []
    for k in range(40):  # pages of one template in small groups, some of them alike enough, of several sizes
        own = [f"g{k // 3}x{j}" for j in range(rng.randrange(4, 14))]
        for j in rng.sample(range(len(own)), rng.randrange(0, 3)):
            own[j] = f"z{k}y{j}"
        cut = rng.randrange(0, 60)
        rows.append((k, " ".join(template[:cut] + own + template[cut:])))
    used = []
    real = nd._rare_pairs
    monkeypatch.setattr(nd, "_rare_pairs", lambda *a: used.append(1) or real(*a))
    monkeypatch.setattr(nd, "agree", lambda t: 20)  # all are candidates
    assert run(spark, rows) == brute(rows)
    assert used


def test_recall_at_the_threshold(spark):
    rng = random.Random(8)
    rows = []
    for k in range(1500):  # pairs just above 0.85, of 3-word shingles
        words = [f"d{k}w{i}" for i in range(102)]
        at = rng.randrange(0, 97)
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(words[:at] + [f"x{w}" for w in words[at : at + 5]] + words[at + 5 :]))]
    got = run(spark, rows)
    want = brute_pairs(rows)
    assert 1300 < len(want) and sum(root == i - 1 for i, _, root, _ in got if i in want) == len(want)


def brute_pairs(rows):
    return {b for (a, s), (b, t) in zip(rows[::2], rows[1::2]) if 100 * len(shingles(s) & shingles(t)) >= 85 * len(shingles(s) | shingles(t))}


def test_repeated_ids_and_no_ids(spark):
    base = [f"w{k}" for k in range(60)]
    near = " ".join(base[:-1] + ["z"])
    far = " ".join(f"v{k}" for k in range(60))
    rows = [(9, " ".join(base)), (9, " ".join(base)), (3, near), (None, " ".join(["y", *base[1:]])), (None, far), (None, far + " end"), (4, None)]
    got = Counter(map(str, run_any(spark, rows)))
    assert got == Counter(map(str, [(9, 58, 3, False)] * 2 + [(3, 58, 3, True), (None, 58, 3, False), (None, 58, None, True), (None, 59, None, True), (4, 0, 4, True)]))


def test_very_long_text(spark):
    rng = random.Random(4)
    words = [f"w{rng.randrange(10**5)}" for _ in range(1_500_000)]  # some 10 MB
    other = list(words)
    other[7] = "changed"
    rows = [(1, " ".join(words)), (2, " ".join(other)), (3, "x" * 10_000_000), (4, "short text of words")]
    got = {r[0]: r for r in run(spark, rows)}
    assert got[2][2] == 1 and got[3][1] == 1 and got[3][2] == 3 and got[4][3]


def joined_rows(spark, after):
    """Rows that inner joins by node made in the queries after a number."""
    store, n = spark._jsparkSession.sharedState().statusStore(), 0
    runs = store.executionsList()
    for k in range(runs.size()):
        at = runs.apply(k).executionId()
        if at > after:
            nodes, values = store.planGraph(at).allNodes(), store.executionMetrics(at)
            for j in range(nodes.size()):
                node = nodes.apply(j)
                if "Join [node" in node.desc() and "Inner" in node.desc():
                    for i in range(node.metrics().size()):
                        m = node.metrics().apply(i)
                        if m.name() == "number of output rows" and values.contains(m.accumulatorId()):
                            n += int(values.apply(m.accumulatorId()).replace(",", ""))
    return n


def test_a_row_of_a_large_node_is_joined_once_with_its_pivot(spark):
    """Classes that all take one label cost one joined row for each root, and a group twice as large twice as many."""
    rng = random.Random(1)
    base = [f"w{rng.randrange(10_000)}" for _ in range(400)]
    made = []
    for n in (200, 400):
        rows = [(k, " ".join([*base, f"end{k}"])) for k in range(n)]
        store = spark._jsparkSession.sharedState().statusStore()
        before = store.executionsList().last().executionId() if store.executionsCount() else -1
        assert {r[2] for r in run(spark, rows)} == {0}
        made.append(joined_rows(spark, before))
    roots = nd.TREES * nd.BRANCHES
    assert 100 * roots < made[0] <= 250 * roots and made[1] <= 500 * roots
