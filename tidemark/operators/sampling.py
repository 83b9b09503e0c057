"""Seeded sampling whose result depends on keys and seeds alone: not on partitions, buckets or a table's size.

Numbers are mixed by products of less than 2 ** 63, so any engine with 64-bit integers
makes the same ones.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.ranking import numbered

# Words of 31 and 32 bits, and odd multipliers under 2 ** 31.
WORD, LONG = 1 << 31, 1 << 32
MIX = (1540483477, 668265263, 374761393)
#: Numbers that are drawn by one row of the plan, and steps of a permutation's walk back into its range, at most.
CHUNK, WALK, ROUNDS = 1 << 16, 64, 4
#: Buckets that rows are numbered in; ranks are the same for any number of them.
BUCKETS = 1 << 16


def _fixed(n: int) -> Column:
    return F.lit(n).cast("long")


def let(x: Column, then: Callable[[Column], Column]) -> Column:
    """then(x), with x computed once however often it is used."""
    return F.get(F.transform(F.array(x), then), F.lit(0))


def mixed(x: Column, seed: int) -> Column:
    """31 bits of a whole number of at least 0 and a seed."""

    def fold(y: Column, m: int, shift: int) -> Column:
        return y.bitwiseXOR(F.shiftright(y, shift)) % WORD * _fixed(m) % LONG + F.shiftright(y, 31)

    first = (x % WORD * _fixed(MIX[0]) + F.shiftright(x, 31) % WORD + _fixed(seed * 40503)) % LONG
    return let(first, lambda y: let(fold(y, MIX[1], 16), lambda y: let(fold(y, MIX[2], 15), lambda y: y.bitwiseXOR(F.shiftright(y, 16)) % WORD)))


def below(x: Column, seed: int, n: Column) -> Column:
    """A number from 0 to n - 1 drawn by x: 62 bits modulo n."""
    return (mixed(x, 2 * seed) * _fixed(WORD) + mixed(x, 2 * seed + 1)) % n


def hash_ranked(rows: DataFrame, into: str, key: str, by: list[str] | None = None, seed: int = 0, buckets: int = BUCKETS) -> DataFrame:
    """Dense numbers from 0 in the order (mixed key, key) within each group; a bucket is a range of mixed keys, so their number doesn't matter."""
    code = mixed(F.pmod(F.col(key), _fixed(1 << 62)), seed)
    place = F.floor(code * buckets / WORD).cast("int")
    return numbered(rows.withColumn("_code", code), into, place, ["_code", key], by).drop("_code")


def with_replacement(rows: DataFrame, key: str, label: str, seed: int = 42, buckets: int = BUCKETS) -> DataFrame:
    """rows with copies: each label is raised to the largest count by as many draws, each of any of its rows with equal chance.

    Draw j of a label takes the row whose rank is drawn by j. Draws are made and counted
    in chunks before they meet the rows, so neither a label nor a row drawn often is one
    task's. Null is a label too. Rows that share a label and a key are ranked among each
    other in any order, as they can't be told apart.
    """
    sizes = rows.groupBy(F.col(label).alias("_label")).agg(F.count("*").alias("_n"))
    most = sizes.agg(F.max("_n").alias("_most"))
    short = sizes.join(F.broadcast(most)).select("_label", "_n", (F.col("_most") - F.col("_n")).alias("_short")).where("_short > 0")
    chunks = short.withColumn("_from", F.explode(F.sequence(_fixed(0), F.col("_short") - 1, _fixed(CHUNK))))
    chunks = chunks.repartition("_label", "_from")
    draws = chunks.select("_label", "_n", F.explode(F.sequence("_from", F.least(F.col("_from") + CHUNK, F.col("_short")) - 1)).alias("_j"))
    taken = draws.groupBy("_label", below(F.col("_j"), seed, F.col("_n")).alias("_rank")).agg(F.count("*").alias("_times"))
    ranked = hash_ranked(rows, "_rank", key, [label], buckets=buckets)
    same = ranked[label].eqNullSafe(taken["_label"]) & (ranked["_rank"] == taken["_rank"])
    out = ranked.join(taken, same, "left").select(*(ranked[c] for c in rows.columns), F.coalesce("_times", F.lit(0)).cast("int").alias("copies"))
    return out


def permuted(x: Column, n: int, seed: int = 42) -> Column:
    """A permutation of 0 to n - 1: a Feistel network over the digits of x in mixed radix, walked until it is back in range.

    The radices are the root of n and what it leaves, so few numbers lie beyond n and a
    walk is short; one of more than WALK steps is an error, not a wrong place.
    """
    if n < 2:
        return x
    a = int(n**0.5) + 1
    b = -(-n // a)

    def rounds(low: Column, high: Column, k: int) -> Column:
        if k == ROUNDS:
            return high * a + low
        return let((low + mixed(high, seed * ROUNDS + k)) % a, lambda low: let((high + mixed(low, seed * ROUNDS + k + 1)) % b, lambda high: rounds(low, high, k + 2)))

    def step(y: Column) -> Column:
        return rounds(y % a, F.floor(y / a), 0)

    # one step as a function of a state, so that the plan holds the network twice and not WALK times
    out = F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), step(x.cast("long")), lambda y, _: F.when(y >= n, step(y)).otherwise(y))
    return F.when(out < n, out).otherwise(F.raise_error(F.lit("a walk takes too many steps")))
