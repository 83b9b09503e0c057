"""Numeric functions over frame signals, and aggregates that don't depend on the order of tasks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def logistic_posture(aspect_ratio: Column | str) -> Column:
    """Score of lying from a box's aspect ratio: a logistic of slope 3 around 1.4."""
    return 1 / (1 + F.exp(-(col(aspect_ratio) - 1.4) * 3))


def aspect_ratio(width: Column | str, height: Column | str) -> Column:
    """Width by height, a height under 1 counting as 1; 0 without a box."""
    return F.coalesce(col(width) / F.greatest(col(height), F.lit(1.0)), F.lit(0.0))


def box_area(width: Column | str, height: Column | str) -> Column:
    return F.coalesce(col(width) * col(height), F.lit(0.0))


def abs_difference(a: Column | str, b: Column | str) -> Column:
    return F.abs(col(a) - col(b))


def clamp(x: Column | str, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), col(x)))


def safe_float(x: Column | str) -> Column:
    """NaN and infinities become 0."""
    x = col(x).cast("double")
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), 0.0).otherwise(x)


def safe_divide(a: Column | str, b: Column | str) -> Column:
    """a / b where b is positive, else 0."""
    return F.when(col(b) > 0, F.try_divide(col(a), col(b))).otherwise(0.0)


def round_4(x: Column | str) -> Column:
    """Four places, halves to even, of the binary value itself: 0.00015 lies under the half and becomes 0.0001.

    The product with 10,000 is kept exactly as a double and its error, by splitting the
    factor in two halves of 26 bits; where the double lies half way, the error decides.
    From 2 ** 39 on the places are finer than a double's own steps.
    """
    x = col(x).cast("double")
    wide = x * 134217729.0
    high = wide - (wide - x)
    product = x * 10000.0
    error = (high * 10000.0 - product) + (x - high) * 10000.0
    near = F.rint(product)
    rest = product - near
    up, down = (rest == 0.5) & (error > 0), (rest == -0.5) & (error < 0)
    near = F.when(up, near + 1.0).when(down, near - 1.0).otherwise(near)
    return F.when(F.abs(x) < float(1 << 39), near / 10000.0).otherwise(x)


def scaled(x: Column | str, scale: int) -> Column:
    """x as an integer number of 1 / scale."""
    return F.round(col(x) * scale).cast("long")


def exact_mean(x: Column | str, scale: int = 1000) -> Column:
    """Mean of values that are whole multiples of 1 / scale. The sum is an integer, so it is the same for any partitioning."""
    s = scaled(x, scale)
    return F.sum(s).cast("double") / F.count(s).cast("double") / F.lit(float(scale))


def exact_std(x: Column | str, scale: int = 1000) -> Column:
    """Population standard deviation, from integer sums as in exact_mean."""
    s = scaled(x, scale)
    n = F.count(s).cast("double")
    mean = F.sum(s).cast("double") / n
    return F.sqrt(F.greatest(F.lit(0.0), F.sum(s * s).cast("double") / n - mean * mean)) / F.lit(float(scale))


def get_or(m: Column | str, key: str, default: float) -> Column:
    """A map's value at a key, or a default."""
    return F.coalesce(F.try_element_at(col(m), F.lit(key)), F.lit(default))


def uniform_prior(m: Column | str) -> Column:
    """1 / number of classes; 1 for an empty or missing map."""
    return 1.0 / F.greatest(F.coalesce(F.size(col(m)), F.lit(0)), F.lit(1))


def zip_probabilities(labels: Column | str, probabilities: Column | str) -> Column:
    return F.map_from_arrays(col(labels), col(probabilities))


def top_class(labels: Column, probabilities: Column) -> Column:
    """(label, probability) of the largest probability, the first of equals."""
    ranked = F.transform(probabilities, lambda p, k: F.struct(p.alias("p"), (-k).alias("k")))
    best = F.array_max(ranked)
    return F.struct(F.get(labels, -best["k"]).alias("label"), best["p"].alias("probability"))
