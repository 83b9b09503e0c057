"""Keypoint and feature-vector functions; joint j has x, y and score at 3 j, 3 j + 1 and 3 j + 2."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.signals import clamp, col
from tidemark.schemas import JOINTS

SPAN_SCALE = 150.0
#: y of left and right shoulder, left and right hip in a flat vector.
SHOULDERS, HIPS = (16, 19), (34, 37)


def _at(flat: Column, k: Column | int) -> Column:
    return F.coalesce(F.get(flat, F.lit(k) if isinstance(k, int) else k), F.lit(0).cast("double"))


def reshape_keypoints(flat: Column | str) -> Column:
    """Flat triplets as [[x, y, score]] of 17 joints; what is missing is 0, what is beyond is dropped."""
    flat = col(flat)
    return F.transform(F.sequence(F.lit(0), F.lit(JOINTS - 1)), lambda j: F.array(_at(flat, 3 * j), _at(flat, 3 * j + 1), _at(flat, 3 * j + 2)))


def flatten_features(keypoints: Column | str, motion: Column | str, audio: Column | str) -> Column:
    """17 x 3 keypoints, motion and audio as 53 values; a joint without three values is zeros."""
    zero = F.array(*[F.lit(0.0)] * 3)
    joint = lambda j: F.get(col(keypoints), j)
    joints = F.transform(F.sequence(F.lit(0), F.lit(JOINTS - 1)), lambda j: F.when(F.size(joint(j)) == 3, joint(j)).otherwise(zero))
    return F.concat(F.flatten(joints), F.array(F.coalesce(col(motion), F.lit(0.0)), F.coalesce(col(audio), F.lit(0.0))))


def keypoint_motion(now: Column | str, before: Column | str) -> Column:
    """Mean distance in the plane of the joints of two frames; 0 without a frame before."""
    distance = F.zip_with(col(now), col(before), lambda a, b: F.sqrt(F.pow(F.get(a, 0) - F.get(b, 0), F.lit(2)) + F.pow(F.get(a, 1) - F.get(b, 1), F.lit(2))))
    n = F.greatest(F.size(distance), F.lit(1))
    return F.when(col(before).isNull(), 0.0).otherwise(F.aggregate(distance, F.lit(0.0), lambda s, d: s + d) / n)


def vertical_span(flat: Column | str) -> Column:
    """Distance in y of the middle of the shoulders and the middle of the hips."""
    flat = col(flat)
    middle = lambda pair: (_at(flat, pair[0]) + _at(flat, pair[1])) / 2
    return F.abs(middle(SHOULDERS) - middle(HIPS))


def span_posture(mean_span: Column | str) -> Column:
    """Score of lying from the mean vertical span of a window: 1 - span / 150, between 0 and 1."""
    return F.coalesce(clamp(1 - F.least(F.lit(1.0), col(mean_span) / SPAN_SCALE)), F.lit(0.0))


def keypoint_box_area(flat: Column | str) -> Column:
    """Area of the box around the 17 joints."""
    flat = col(flat)

    def extent(offset: int) -> Column:
        values = F.transform(F.sequence(F.lit(0), F.lit(JOINTS - 1)), lambda j: _at(flat, 3 * j + offset))
        return F.array_max(values) - F.array_min(values)

    return extent(0) * extent(1)


def head_window(series: Column | str, size: int) -> Column:
    """The first `size` values of a series, filled with zeros."""
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda k: F.coalesce(F.get(col(series), k), F.lit(0).cast("double")))
