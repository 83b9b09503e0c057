"""Row numbers without one task that holds all rows of a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def numbered(df: DataFrame, into: str, bucket: Column, order: list[Column | str], by: list[str] | None = None) -> DataFrame:
    """df with a dense number from 0 in the order (bucket, *order) within each group of `by`.

    Rows are numbered inside (group, bucket) and shifted by the sizes of the buckets
    before, so a group is dealt to as many tasks as it has buckets. The buckets' counts
    are one small row each and are joined, not collected.
    """
    by = by or []
    rows = df.withColumn("_bucket", bucket)
    sizes = rows.groupBy(*by, "_bucket").agg(F.count("*").alias("_size"))
    before = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*by, "_bucket", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*by, "_bucket").orderBy(*order)
    rows = rows.withColumn("_in", F.row_number().over(inside) - 1)
    # null groups are groups too
    same = None
    for c in [*by, "_bucket"]:
        one = rows[c].eqNullSafe(offsets[c])
        same = one if same is None else same & one
    out = rows.join(offsets, same, "left")
    return out.select(*(rows[c] for c in df.columns), (F.col("_in") + F.col("_before")).cast("long").alias(into))
