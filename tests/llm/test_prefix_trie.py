import hashlib
import zlib
from collections import defaultdict

import duckdb
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tidemark.llm import prefix_trie as T

SCHEMA = "conv_id long, turn long, role string, text string"


def digest(role, text):
    return hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()[:16]


def own_turns(rows):
    """conv_id -> turns (role, text), in order."""
    own = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, digest(role or "", text or ""), (role or "", text or "")))
    return {c: [x[3] for x in sorted(t)] for c, t in own.items()}


def rebuild(own):
    """Heads of the hundred's first conversation before each one's own rest."""
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = own.get(int(c / 100) * 100, [])[:h] + turns[h:]
    return out


def brute_force(convs):
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    kids = defaultdict(list)
    for path in members:
        if path:
            kids[path[:-1]].append(path)
    leaves, saved = {}, {}
    for path in sorted(members, key=len, reverse=True):
        leaves[path] = sum(leaves[k] for k in kids[path]) or 1
        saved[path] = sum(saved[k] for k in kids[path]) + ((len(members[path]) - 1) * len(path[-1][1]) if path else 0)
    rows = []
    for path, ids in members.items():
        ends = ",".join(str(c) for c in sorted(ids) if len(convs[c]) == len(path))
        rows.append((min(ids), len(path), min(members[path[:-1]]) if path else None, len(ids), len(kids[path]), leaves[path], saved[path], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(rows, key=str)


def result(df):
    return sorted(map(tuple, df.collect()), key=str)


def table_of(spark, convs):
    """convs as rows, each turn a row."""
    return spark.createDataFrame([(c, k, r, t) for c, turns in convs.items() for k, (r, t) in enumerate(turns)], SCHEMA)


turns = st.lists(st.tuples(st.sampled_from("ua"), st.sampled_from(["", "x", "é🙂"])), max_size=6)


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.dictionaries(st.integers(-50, 5000), turns.filter(bool), min_size=1, max_size=40), st.sampled_from([1, 7, 500]))
def test_any_forest(spark, convs, buckets):
    assert result(T.prefix_trie(T.paths(table_of(spark, convs)), buckets=buckets)) == brute_force(convs)


@pytest.mark.parametrize("buckets", [1, 300])
def test_hot_turns_copies_and_nested_conversations(spark, buckets):
    head = [("s", "rules"), ("u", "hello")]
    convs = {k: head + [("a", "same")] for k in range(0, 9000, 3)}  # many equal ones, over several ranges of ids
    convs |= {k: head + [("a", f"own {k % 11}"), ("u", f"and {k % 5}"), ("a", "bye")] for k in range(1, 600, 3)}
    convs |= {k: head + [("a", "deep")] * (k % 40) for k in range(2, 400, 3)}  # each the beginning of the next
    convs |= {k: [("u", f"alone {k}")] for k in range(20_000, 20_050)}
    convs |= {30_000: [("s", "rules")], 30_001: [("s", "rules")] + [("u", "long")] * 700}
    assert result(T.prefix_trie(T.paths(table_of(spark, convs)), buckets=buckets)) == brute_force(convs)


def test_nested_conversations_take_few_levels(spark, monkeypatch):
    convs = {k: [("u", f"step {j}") for j in range(k + 1)] for k in range(300)}
    calls = []
    real = T._sent
    monkeypatch.setattr(T, "_sent", lambda df: calls.append(1) or real(df))
    assert result(T.prefix_trie(T.paths(table_of(spark, convs)), buckets=60)) == brute_force(convs)
    assert len(calls) <= 3 * 9  # three a level, and a level takes away a constant share


def test_rebuilt(spark):
    rows = [(c, k, "user" if k % 2 else "assistant", f"{c} {k}") for c in [100, 101, 102, 103, 117, 199, 205, 350] for k in range(c % 7 + 1)]
    rows += [(100, None, None, None), (100, None, "user", "first"), (300, 4, "user", "x"), (300, 4, "user", "x"), (None, 1, "user", "nobody"), (-7, 0, "user", "minus"), (0, 0, "user", "zero")]
    convs = spark.createDataFrame([(*r, 1) for r in rows], SCHEMA + ", PATH int")
    assert result(T.prefix_trie(T.rebuilt_paths(convs))) == brute_force(rebuild(own_turns(rows)))


def test_turnless_and_empty(spark):
    lone = [c for c in range(101, 400) if c % 100 and zlib.crc32(str(c).encode()) % 6][:4]  # no first conversation, all turns cut off
    rows = [(c, 0, "user", "x") for c in lone]
    got = result(T.prefix_trie(T.rebuilt_paths(spark.createDataFrame(rows, SCHEMA))))
    assert got == brute_force(rebuild(own_turns(rows))) and len(got) == 1
    assert result(T.prefix_trie(T.rebuilt_paths(spark.createDataFrame([], SCHEMA)))) == []
    assert result(T.prefix_trie(T.paths(spark.createDataFrame([(None, 1, "user", "x")], SCHEMA)))) == []


def test_very_long_texts_and_conversations(spark):
    convs = {1: [("u", "x" * 3_000_000), ("a", "é" * 1_000_000)], 2: [("u", "x" * 3_000_000)], 3: [("u", f"{k}") for k in range(5000)], 4: [("u", f"{k}") for k in range(4000)]}
    got = result(T.prefix_trie(T.paths(table_of(spark, convs)), buckets=3))
    assert len(got) == 1 + 2 + 5000
    assert (1, 1, 1, 2, 1, 1, 3_000_000, hashlib.sha256(b"2").hexdigest()) in got
    root = next(r for r in got if r[1] == 0)
    assert root[3:7] == (4, 2, 2, 3_000_000 + sum(len(str(k)) for k in range(4000)))


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_equals_sql_and_brute_force(spark, sf):
    path = f"/root/testdata/{sf}/conversations.parquet"
    got = result(T.op12_prefix_trie(spark, f"/root/testdata/{sf}"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{path}'")
    assert got == sorted(con.sql(T.OP12_SQL).fetchall(), key=str)
    assert got == brute_force(rebuild(own_turns(con.sql("SELECT conv_id, turn, role, text FROM conversations").fetchall())))
