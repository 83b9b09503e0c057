"""Time partitions that adapt to how many rows a stretch of time has, as Parquet files in a folder.

A layout is a tree of years, months, days and hours. A node of more rows than a limit is
split into all its parts; neighbouring siblings within the limit are joined to runs of
at most the limit. Runs and single hours are leaves, and rows without a moment are one
more. A leaf's rows fill files of the limit each.

Rows are counted by hour. Within a year the counts become one dense array of prefix
sums: a node's count is a difference of two of them, and a run's end is found by one
binary search. Years are counted on their own, so the driver sees a number for each
year, and the leaves, whose number depends on the limit's share of the rows. Each row
finds its leaf by bisection of the leaves' first hours. Rows of leaves beyond the limit
are ranked by a sort over all tasks, so neither an hour nor the rows without a moment
meet in one task; only the rows of one file do.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm._spark import cut, drop_folder, partitions, shared_folder, table

NULL = "null"
#: Rows of a task, about, where rows are sorted.
TASK_ROWS = 1_000_000
_LEAF_SQL = "leaf string, start long, n long"


@dataclass(frozen=True)
class File:
    """A file of a layout. `held` counts its rows that were said to be in the folder before; `digest` is of its rows, in any order."""

    leaf: str
    part: int
    n_rows: int
    held: int
    digest: tuple[int, ...]
    path: str
    rewritten: bool


def runs(sums: np.ndarray, limit: int) -> Iterator[tuple[int, int, bool]]:
    """(from, to, whether it is one sibling over the limit) of each run of siblings; sums: rows before each sibling and after the last."""
    at = 0
    while at < len(sums) - 1:
        end = int(np.searchsorted(sums, sums[at] + limit, side="right")) - 1
        yield at, max(end, at + 1), end == at
        at = max(end, at + 1)


def leaves_of_year(year: int, hours: np.ndarray, counts: np.ndarray, limit: int) -> list[tuple[str, int, int]]:
    """(name, first hour, rows) of the leaves of a year over the limit; hours since 1970 with their counts."""
    first, after = (int(np.datetime64(f"{y:04d}-01-01T00", "h").astype(int)) for y in (year, year + 1))
    sums = np.concatenate([[0], np.cumsum(np.bincount(hours - first, counts, minlength=after - first).astype(np.int64))])
    out: list[tuple[str, int, int]] = []

    def split(parents: str, edges: np.ndarray, from_one: int, finer: tuple[int, ...]) -> None:
        """Siblings between edges, numbered from 0 or 1; finer: hours of their parts, and of these again."""
        for a, b, over in runs(sums[edges - first], limit):
            n = int(sums[edges[b] - first] - sums[edges[a] - first])
            if over and finer:
                more = np.arange(edges[a], edges[b] + 1, finer[0])
                split(f"{parents}/{a + from_one:02d}", more, int(finer[0] > 1), finer[1:])
            elif n:
                out.append((f"{parents}/{a + from_one:02d}-{b - 1 + from_one:02d}", int(edges[a]), n))

    months = np.arange(f"{year:04d}-01", f"{year + 1:04d}-01", dtype="datetime64[M]")
    split(f"{year:04d}", np.append(months.astype("datetime64[h]").astype(np.int64), after), 1, (24, 1))
    return out


def hour_of(moment: Column) -> Column:
    """Hours since 1970, by the calendar of the moment itself."""
    return F.unix_date(F.to_date(moment)).cast("long") * 24 + F.hour(moment)


def leaves(hours: DataFrame, limit: int) -> tuple[list[tuple[str, int, int]], int]:
    """(name, first hour, rows) of each leaf in time order, and the rows without an hour, of a table of hour and n."""
    by_year = hours.withColumn("year", F.year(F.date_from_unix_date(F.floor(F.col("hour") / 24).cast("int"))))
    years = {r.year: r.n for r in by_year.groupBy("year").agg(F.sum("n").alias("n")).collect()}
    nulls = years.pop(None, 0)
    if not years:
        return [], nulls
    first, last = min(years), max(years)
    sums = np.concatenate([[0], np.cumsum([years.get(y, 0) for y in range(first, last + 1)])])
    out, large = [], []
    for a, b, over in runs(sums, limit):
        n = int(sums[b] - sums[a])
        if over:
            large.append(first + a)
        elif n:
            out.append((f"{first + a:04d}-{first + b - 1:04d}", int(np.datetime64(f"{first + a:04d}-01-01T00", "h").astype(int)), n))
    if large:

        def split(part: pd.DataFrame) -> pd.DataFrame:
            found = leaves_of_year(int(part["year"].iloc[0]), part["hour"].to_numpy(), part["n"].to_numpy(), limit)
            return pd.DataFrame(found, columns=["leaf", "start", "n"])

        found = by_year.filter(F.col("year").isin(large)).select("year", "hour", "n").groupBy("year").applyInPandas(split, _LEAF_SQL)
        out += [tuple(r) for r in found.collect()]
    return sorted(out, key=lambda x: x[1]), nulls


def _router(starts: np.ndarray, after: int):
    """A function of hours to the number of their leaf, `after` for rows without one."""

    @F.pandas_udf("int")
    def route(hours: pd.Series) -> pd.Series:
        missing = hours.isna().to_numpy()
        at = np.searchsorted(starts, hours.fillna(0).to_numpy(np.int64), side="right") - 1
        return pd.Series(np.where(missing, after, at).astype(np.int32))

    return route


def _tasks(spark: SparkSession, rows: int) -> int:
    """As many tasks as the session names, or more for many rows."""
    return max(partitions(spark), -(-rows // TASK_ROWS))


def _lanes(columns: list[Column]) -> list[Column]:
    """Sums of 32-bit lanes of two hashes of each row: equal for equal rows in any order."""
    out = []
    for seed in (1, 2):
        h = F.xxhash64(F.lit(seed), *columns)
        out += [F.sum(F.shiftrightunsigned(h, 32)), F.sum(h.bitwiseAND(F.lit(0xFFFFFFFF)))]
    return out


def lay_out(rows: DataFrame, folder: str, limit: int, moment: Column, order: list[str], held: Column | None = None, before: list[File] | None = None) -> list[File]:
    """Write rows to a folder as a layout of at most `limit` rows a file, and return its files.

    A leaf's rows stand by moment, then `order`, nulls first, then by a hash of the whole
    row. `before` are the files that an earlier call returned for the same folder: those
    whose leaf, part and rows are the same again stay as they are, all others of them are
    deleted once the new ones are in place. `held` says which rows these hold, and is only
    counted. Repeated rows are rows each. Columns of any name are kept, and no other is
    written. An empty table leaves an empty folder.

    Files appear under a hidden name and are then renamed, so a task that is lost leaves
    nothing. Their number follows the limit's share of the rows, not the table's size.
    """
    spark = rows.sparkSession
    token = uuid.uuid4().hex[:8]
    m, hour, leaf, part, tie, at, of = (f"_{token}_{x}" for x in ("moment", "hour", "leaf", "part", "tie", "at", "of"))
    columns, known = rows.columns, F.lit(False) if held is None else F.coalesce(held, F.lit(False))
    timed = rows.withColumn(m, moment).withColumn(hour, hour_of(F.col(m)))
    hours = cut(timed.groupBy(F.col(hour).alias("hour")).agg(F.count("*").alias("n")))
    found, nulls = leaves(hours, limit)
    names, sizes = [x[0] for x in found] + [NULL], [x[2] for x in found] + [nulls]
    every = [F.col(f"`{c}`") for c in columns]
    timed = timed.withColumn(leaf, _router(np.array([x[1] for x in found], np.int64), len(found))(F.col(hour))).withColumn(tie, F.xxhash64(*every))

    tasks = _tasks(spark, sum(sizes))
    large = [k for k, n in enumerate(sizes) if n > limit]
    planned = timed.withColumn(part, F.lit(1))
    if large:
        sort = [leaf, m, *order, tie]
        ranged = timed.filter(F.col(leaf).isin(large)).withColumn(at, F.monotonically_increasing_id())
        ranged = ranged.repartitionByRange(tasks, *sort, at).sortWithinPartitions(*sort, at)
        ranged = cut(ranged.withColumn(at, F.monotonically_increasing_id()).withColumn(of, F.shiftright(at, 33)))
        sums = Window.partitionBy(leaf).orderBy(of).rowsBetween(Window.unboundedPreceding, -1)
        # a row for each task and leaf that meet: as many as tasks and leaves together, at most
        shift = ranged.groupBy(leaf, of).agg(F.count("*").alias("_n"), F.min(at).alias("_first"))
        shift = shift.select(leaf, of, (F.coalesce(F.sum("_n").over(sums), F.lit(0)) - F.col("_first")).alias("_shift"))
        ranked = ranged.join(F.broadcast(shift), [leaf, of]).withColumn(part, (F.floor((F.col(at) + F.col("_shift")) / limit) + 1).cast("int"))
        kept = [*columns, m, hour, leaf, tie, part]
        planned = planned.filter(~F.col(leaf).isin(large)).select(*(F.col(f"`{c}`") for c in kept)).unionByName(ranked.select(*(F.col(f"`{c}`") for c in kept)))

    lanes = [x.alias(f"_d{k}") for k, x in enumerate(_lanes(every))]
    files = planned.groupBy(leaf, part).agg(F.count("*").alias("_n"), F.sum(known.cast("long")).alias("_held"), *lanes).collect()
    old = {(f.leaf, f.part, f.n_rows, f.digest): f for f in before or []}
    out, todo = [], []
    for r in files:
        key = (names[r[0]], r[1], r[2], tuple(r[4:]))
        same = old.get(key)
        if same is None:
            todo.append((r[0], r[1]))
        out.append(File(*key[:3], r[3], key[3], same.path if same else f"{folder}/{key[0].replace('/', '_')}-part{r[1]:05d}-{token}.parquet", same is None))

    store = spark._jvm.org.apache.hadoop.fs
    base = store.Path(folder)
    fs = base.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(base)
    if todo:
        if len(todo) < len(files):
            planned = planned.join(F.broadcast(spark.createDataFrame(todo, f"`{leaf}` int, `{part}` int")), [leaf, part], "left_semi")
        dealt = planned.repartition(tasks, leaf, part).sortWithinPartitions(leaf, part, m, *order, tie)
        hidden = f"{folder}/_{token}"
        dealt.select(*every, leaf, part).write.option("maxRecordsPerFile", 0).partitionBy(leaf, part).parquet(hidden)
        path_of = {(f.leaf, f.part): f.path for f in out if f.rewritten}
        listed = fs.listFiles(store.Path(hidden), True)
        moved = 0
        while listed.hasNext():
            path = listed.next().getPath()
            if path.getName().endswith(".parquet"):
                p, k = (x.getName().rpartition("=")[2] for x in (path.getParent(), path.getParent().getParent()))
                if not fs.rename(path, store.Path(path_of.pop((names[int(k)], int(p))))):
                    raise OSError(f"{path} can't be renamed")
                moved += 1
        if path_of or moved != len(todo):
            raise OSError(f"{len(path_of)} files of {len(todo)} are missing")
        drop_folder(spark, hidden)
    stays = {f.path for f in out}
    for f in before or []:
        if f.path not in stays:
            fs.delete(store.Path(f.path), False)
    return sorted(out, key=lambda f: (f.leaf, f.part))


def file_digests(spark: SparkSession, folder: str, column: str, n_rows: int = 0) -> DataFrame:
    """file_name, and the digest of a column's values in decimal, joined by commas in file order, of each file of a folder.

    `n_rows`, if known, is how many rows the folder has: more tasks share many of them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, digest = None, None
        for batch in batches:
            out = []
            names, values = batch.column("file_name").to_pylist(), batch.column("value").to_pylist()
            edges = [k for k in range(len(names)) if k == 0 or names[k] != names[k - 1]] + [len(names)]
            for a, b in zip(edges, edges[1:], strict=False):
                if names[a] != name:
                    if digest is not None:
                        out.append((name, digest.hexdigest()))
                    name, digest, gap = names[a], hashlib.sha256(), ""
                else:
                    gap = ","
                digest.update((gap + ",".join(values[a:b])).encode())
            if out:
                yield pa.record_batch([pa.array([x[k] for x in out], pa.string()) for k in (0, 1)], ["file_name", "sha256"])
        if digest is not None:
            yield pa.record_batch([pa.array([x], pa.string()) for x in (name, digest.hexdigest())], ["file_name", "sha256"])

    rows = spark.read.parquet(folder).select(F.col("_metadata.file_name").alias("file_name"), F.col("_metadata.row_index").alias("_row"), F.coalesce(F.col(f"`{column}`").cast("string"), F.lit("")).alias("value"))
    return rows.repartition(_tasks(spark, n_rows), "file_name").sortWithinPartitions("file_name", "_row").select("file_name", "value").mapInArrow(run, "file_name string, sha256 string")


# Fixed values of the query: when the starting files end, files of the whole table, and how moments are made of ts.
CUTOFF, SHARE = "2024-04-01 00:00:00", 800
KINDS, MOVED, FLOORED, FURTHER = 128, 16, 111, 6


def moment_of(ts: str, click_id: str, kind: str) -> Column:
    """ts, moved back by days or floored to a Monday, as crc32 of the id says; kind is the type of ts."""
    k = F.crc32(F.col(click_id).cast("string").cast("binary")) % KINDS
    far = k + FURTHER
    moved = F.col(ts) - F.make_dt_interval((far * far * far).cast("int"))
    day = F.to_date(ts)
    monday = F.date_sub(day, F.weekday(day)).cast(kind)
    return F.when(k < MOVED, moved).when(k > FLOORED, monday).otherwise(F.col(ts))


def op13_time_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    clicks = table(spark, sf_dir, "clicks")
    kinds = dict(clicks.dtypes)
    limit = 1 + clicks.count() // SHARE
    folder = f"{shared_folder(spark)}/time-partitions-{uuid.uuid4().hex}"
    moment, order = moment_of("ts", "click_id", kinds["ts"]), ["arrived_at", "click_id"]
    early = F.col("arrived_at") < F.lit(CUTOFF).cast(kinds["arrived_at"])
    start = lay_out(clicks.filter(early), folder, limit, moment, order)
    files = lay_out(clicks, folder, limit, moment, order, held=early, before=start)
    rows = [(f.leaf, f.part, f.n_rows, f.n_rows - f.held, f.path, f.rewritten, f.path.rpartition("/")[2]) for f in files]
    out = spark.createDataFrame(rows, "leaf string, part long, n_rows long, n_new long, path string, rewritten boolean, file_name string")
    if not files:
        return out.select("leaf", "part", "n_rows", "n_new", "path", "rewritten", F.lit("").alias("columns"), F.lit("").alias("ids_sha256"))
    digests = file_digests(spark, folder, "click_id", sum(f.n_rows for f in files))
    return out.join(digests, "file_name").select("leaf", "part", "n_rows", "n_new", "path", "rewritten", F.lit(",".join(clicks.columns)).alias("columns"), F.col("sha256").alias("ids_sha256"))
