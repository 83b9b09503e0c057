"""What several operators need of a session."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stands for a null id inside the operators; results carry the null again.
NO_ID = -(1 << 63)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it; a temporary one where it names none and all is one process."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if not named and not context.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="tidemark-"))
    return named or context.getCheckpointDir()


def drop_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder in whatever store it is, if it is there."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def checked_broadcast(df: DataFrame, most: int) -> DataFrame:
    """df with a hint to broadcast it if it has at most `most` rows, and without one beyond."""
    df = cut(df)
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def cut(df: DataFrame) -> DataFrame:
    """Write df to the checkpoint folder that the cluster shares and go on from there, without its lineage."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def column_index(df: DataFrame, name: str) -> int:
    """The place of a column whose name may be spelled in any case, the exact spelling first."""
    if name in df.columns:
        return df.columns.index(name)
    return [c.lower() for c in df.columns].index(name.lower())


def new_name(df: DataFrame, name: str) -> str:
    """name, or name with as many underscores as no column of df has in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def known_id(name: str) -> Column:
    return F.coalesce(F.col(name).cast("long"), F.lit(NO_ID))


def null_id(name: str) -> Column:
    return F.when(F.col(name) != NO_ID, F.col(name))


def spread(key: Column, n: int) -> Column:
    """A bucket from 0 to n - 1 of a long; spread_array does the same in numpy."""
    return F.pmod(key.bitwiseXOR(F.shiftrightunsigned(key, 17)).bitwiseXOR(F.shiftrightunsigned(key, 37)), F.lit(n).cast("long")).cast("int")


def spread_array(key, n: int):
    import numpy as np

    u = key.astype(np.int64).view(np.uint64)
    x = (u ^ (u >> np.uint64(17)) ^ (u >> np.uint64(37))).view(np.int64)
    return np.mod(x, n)
