import hashlib
import os
import zlib
from collections import Counter, defaultdict
from datetime import datetime, timedelta

import numpy as np
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.llm import time_partitions as T


def plan(moments, limit):
    """Leaf name of each moment, by following the rule one sibling after the other."""
    known = [m for m in moments if m is not None]
    names = {}

    def siblings(parents, level, members):
        run, n_run = [], 0

        def close():
            nonlocal run, n_run
            if n_run:
                for name, mine in run:
                    for m in mine:
                        names[m] = "/".join([*parents, f"{run[0][0]}-{run[-1][0]}"])
            run, n_run = [], 0

        for name, mine in members:
            size = sum(counts[m] for m in mine)
            if size > limit:
                close()
                if level == 3:
                    for m in mine:
                        names[m] = "/".join([*parents, f"{name}-{name}"])
                else:
                    siblings([*parents, name], level + 1, parts(level + 1, mine))
                continue
            if run and n_run + size > limit:
                close()
            run.append((name, mine))
            n_run += size
        close()

    def parts(level, mine):
        one = next(iter(mine))
        if level == 1:
            labels = [f"{k:02d}" for k in range(1, 13)]
        elif level == 2:
            after = datetime(one.year + one.month // 12, one.month % 12 + 1, 1)
            labels = [f"{k:02d}" for k in range(1, (after - datetime(one.year, one.month, 1)).days + 1)]
        else:
            labels = [f"{k:02d}" for k in range(24)]
        by = defaultdict(list)
        for m in mine:
            by[f"{(m.month, m.day, m.hour)[level - 1]:02d}"].append(m)
        return [(x, by.get(x, [])) for x in labels]

    counts = Counter(known)
    if known:
        by = defaultdict(list)
        for m in counts:
            by[m.year].append(m)
        siblings([], 0, [(f"{y:04d}", by.get(y, [])) for y in range(min(by), max(by) + 1)])
    return [T.NULL if m is None else names[m] for m in moments]


def lay_out_by_hand(rows, limit):
    """(leaf, part) -> rows (moment, arrived, id, ...) in file order."""
    first = lambda x: (x is not None, x or 0)
    out = defaultdict(list)
    for leaf, r in zip(plan([r[0] for r in rows], limit), rows, strict=True):
        out[leaf].append(r)
    return {(leaf, k // limit + 1): part[k : k + limit] for leaf, mine in out.items() for part in [sorted(mine, key=lambda r: ((r[0] is not None, r[0] or datetime.min), (r[1] is not None, r[1] or datetime.min), first(r[2])))] for k in range(0, len(part), limit)}


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 9), min_size=1, max_size=30), st.integers(1, 12))
def test_runs(counts, limit):
    sums = np.concatenate([[0], np.cumsum(counts)])
    got, at = list(T.runs(sums, limit)), 0
    for a, b, over in got:
        assert a == at and b > a and over == (counts[a] > limit)
        n = sum(counts[a:b])
        assert over and b == a + 1 or n <= limit and (b == len(counts) or n + counts[b] > limit)
        at = b
    assert at == len(counts)


def data_files(folder):
    return sorted(os.path.join(d, x) for d, _, names in os.walk(folder) for x in names if not x.startswith((".", "_")))


def read(folder, files):
    """(leaf, part) -> rows of a folder's files, in file order; nothing else may lie there."""
    assert data_files(folder) == sorted(f.path for f in files)
    assert not [d for d in os.listdir(folder) if d.startswith("_")]
    return {(f.leaf, f.part): [tuple(r.values()) for r in pq.read_table(f.path).to_pylist()] for f in files}


SCHEMA = "ts timestamp_ntz, arrived timestamp_ntz, id long, _TIME string"
begin = datetime(2023, 12, 30)


def hot_rows():
    rows = [(begin + timedelta(hours=7 * k), begin + timedelta(hours=7 * k, seconds=k % 5), k, "a") for k in range(300)]
    rows += [(datetime(2024, 1, 8), begin + timedelta(seconds=k % 50), 1000 + k % 60, f"{k % 3}") for k in range(400)]  # one hour over the limit
    rows += [(None, begin if k % 4 else None, k % 30 if k % 5 else None, None) for k in range(150)]
    rows += [(datetime(1969, 2, 3, 23, 59, 59, 999999), None, 5, ""), (datetime(1969, 3, 1), begin, 6, ""), (datetime(2009, 7, 1), begin, 7, "")]
    return rows + [(begin, begin, 9, "same")] * 70  # equal rows


@pytest.mark.parametrize("limit, task_rows", [(1, 1_000_000), (7, 50), (40, 1_000_000), (100_000, 1_000_000)])
def test_layout_and_rewrite(spark, tmp_path, monkeypatch, limit, task_rows):
    monkeypatch.setattr(T, "TASK_ROWS", task_rows)
    spark.conf.set("spark.sql.files.maxRecordsPerFile", 5)
    try:
        layout_and_rewrite(spark, tmp_path, limit)
    finally:
        spark.conf.unset("spark.sql.files.maxRecordsPerFile")


def layout_and_rewrite(spark, tmp_path, limit):
    rows = hot_rows()
    rows = rows[:120] if limit == 1 else rows
    early = [k % 9 != 8 and (r[0] is None or r[0] < datetime(2024, 3, 1)) for k, r in enumerate(rows)]
    df = spark.createDataFrame([(*r, e) for r, e in zip(rows, early, strict=True)], SCHEMA + ", early boolean").repartition(5)
    folder = str(tmp_path / "f")
    args = (folder, limit, F.col("ts"), ["arrived", "id"])
    start = T.lay_out(df.filter("early"), *args)
    want = lay_out_by_hand([r for r, e in zip(rows, early, strict=True) if e], limit)
    got = read(folder, start)
    assert {k: [r[:3] for r in v] for k, v in got.items()} == {k: [r[:3] for r in v] for k, v in want.items()}
    stamps = {f.path: os.stat(f.path).st_mtime_ns for f in start}

    files = T.lay_out(df, *args, held=F.col("early"), before=start)
    final = read(folder, files)
    want = lay_out_by_hand(rows, limit)
    assert {k: [r[:3] for r in v] for k, v in final.items()} == {k: [r[:3] for r in v] for k, v in want.items()}
    assert Counter(r for v in final.values() for r in v) == Counter((*r, e) for r, e in zip(rows, early, strict=True))
    for f in files:
        same = Counter(got.get((f.leaf, f.part), [])) == Counter(final[f.leaf, f.part])
        assert f.rewritten == (not same) and (f.rewritten or os.stat(f.path).st_mtime_ns == stamps[f.path])
        assert f.held == sum(r[-1] for r in final[f.leaf, f.part]) and f.n_rows == len(final[f.leaf, f.part]) <= limit
    if limit in (7, 40):
        assert {f.rewritten for f in files} == {True, False} and any(f.part > 1 for f in files)
    # rows that go again take their files with them
    again = T.lay_out(df.filter("early"), *args, before=files)
    assert {k: [r[:3] for r in v] for k, v in read(folder, again).items()} == {k: [r[:3] for r in v] for k, v in got.items()}


def test_digests_are_of_the_files_order(spark, tmp_path):
    df = spark.createDataFrame([(begin + timedelta(hours=k % 50), begin, 500 - k, "x") for k in range(400)] + [(None, None, None, None)] * 2, SCHEMA)
    files = T.lay_out(df, str(tmp_path), 30, F.col("ts"), ["arrived", "id"])
    got = {r.file_name: r.sha256 for r in T.file_digests(spark, str(tmp_path), "id").collect()}
    assert len(got) == len(files)
    for f in files:
        ids = ",".join("" if x is None else str(x) for x in pq.read_table(f.path).column("id").to_pylist())
        assert got[os.path.basename(f.path)] == hashlib.sha256(ids.encode()).hexdigest()


def test_empty_table(spark, tmp_path):
    empty = spark.createDataFrame([], SCHEMA)
    assert T.lay_out(empty, str(tmp_path / "e"), 3, F.col("ts"), ["arrived", "id"]) == [] and os.listdir(tmp_path / "e") == []
    one = spark.createDataFrame([(begin, begin, 1, "x")], SCHEMA)
    files = T.lay_out(one, str(tmp_path / "e"), 3, F.col("ts"), ["arrived", "id"])
    assert [f.leaf for f in files] == ["2023-2023"]
    assert T.lay_out(empty, str(tmp_path / "e"), 3, F.col("ts"), ["arrived", "id"], before=files) == [] and data_files(tmp_path / "e") == []


def moment(ts, click_id):
    if ts is None or click_id is None:
        return ts
    k = zlib.crc32(str(click_id).encode()) % 128
    if k < 16:
        return ts - timedelta(days=(k + 6) ** 3)
    if k > 111:
        day = ts.replace(hour=0, minute=0, second=0, microsecond=0)
        return day - timedelta(days=day.weekday())
    return ts


def test_query_matches_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    rows = pq.read_table(f"{sf}/clicks.parquet").to_pylist()
    limit = 1 + len(rows) // 800
    keyed = [(moment(r["ts"], r["click_id"]), r["arrived_at"], r["click_id"], tuple(r.values())) for r in rows]
    early = [k for k in keyed if k[1] is not None and k[1] < datetime(2024, 4, 1)]
    start, final = lay_out_by_hand(early, limit), lay_out_by_hand(keyed, limit)
    got = T.op13_time_partitions(spark, sf).collect()
    assert sorted((r.leaf, r.part) for r in got) == sorted(final)
    was = Counter(k[3] for k in early)
    for r in got:
        mine = final[r.leaf, r.part]
        assert r.ids_sha256 == hashlib.sha256(",".join(str(k[2]) for k in mine).encode()).hexdigest()
        assert (r.n_rows, r.n_new) == (len(mine), sum(k[3] not in was for k in mine)) and r.columns == ",".join(rows[0])
        assert r.rewritten == (Counter(k[3] for k in mine) != Counter(k[3] for k in start.get((r.leaf, r.part), [])))
        assert Counter(tuple(x.values()) for x in pq.read_table(r.path.removeprefix("file:")).to_pylist()) == Counter(k[3] for k in mine)
    folder = os.path.dirname(got[0].path.removeprefix("file:"))
    assert data_files(folder) == sorted(r.path.removeprefix("file:") for r in got)
    assert {r.rewritten for r in got} == {True, False}
