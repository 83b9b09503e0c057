"""Windows that count rows: sliding windows of a clip, their signals, tracks and first appearances."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.config import DEFAULTS, Settings
from tidemark.functions.signals import exact_mean, exact_std
from tidemark.functions.vectors import head_window, keypoint_box_area, span_posture, vertical_span


def long_enough(frames: DataFrame, least: int = DEFAULTS.window) -> DataFrame:
    """Frames of clips that have at least `least`."""
    n = F.count("*").over(Window.partitionBy("clip_id"))
    return frames.withColumn("_n", n).where(F.col("_n") >= least).drop("_n")


def sliding_windows(frames: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """frames, once for each window that holds it, with start and pos; partial windows at the end are dropped.

    A frame goes to window / stride rows at most; nothing is collected.
    """
    size, stride = settings.window, settings.stride
    rows = frames.withColumn("_n", F.count("*").over(Window.partitionBy("clip_id")))
    i = F.col("frame_idx")
    low = F.greatest(F.lit(0), F.ceil((i - size + 1) / F.lit(stride)) * stride).cast("int")
    high = F.least(F.floor(i / F.lit(stride)) * stride, F.floor((F.col("_n") - size) / F.lit(stride)) * stride).cast("int")
    starts = F.when((F.col("_n") >= size) & (low <= high), F.sequence(low, high, F.lit(stride)))
    return rows.withColumn("start", F.explode(starts)).withColumn("pos", (i - F.col("start")).cast("int")).drop("_n")


def window_counts(frames: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """How many windows each clip has, from its length alone."""
    n = F.col("frames")
    out = frames.groupBy("clip_id").agg(F.count("*").alias("frames"))
    return out.withColumn("windows", F.when(n >= settings.window, F.floor((n - settings.window) / settings.stride) + 1).otherwise(0).cast("long"))


def window_signals(windows: DataFrame) -> DataFrame:
    """Motion mean and std, audio mean, posture and area change of each window.

    windows has motion, audio, span (vertical span) and box_area; the area change is over
    the n - 1 differences inside the window.
    """
    inside = Window.partitionBy("clip_id", "start").orderBy("pos")
    rows = windows.withColumn("_da", F.abs(F.col("box_area") - F.lag("box_area").over(inside)))
    out = rows.groupBy("clip_id", "start").agg(
        F.count("*").alias("frames"),
        exact_mean("motion").alias("motion_mean"),
        exact_std("motion").alias("motion_std"),
        exact_mean("audio").alias("audio_distress"),
        span_posture(exact_mean("span", 1_000_000)).alias("horizontal_posture_score"),
        F.coalesce(exact_mean("_da"), F.lit(0.0)).alias("area_change_mean"),
    )
    return out.withColumn("duration_seconds", F.col("frames") / F.lit(DEFAULTS.default_fps))


def vector_window_frames(windows: DataFrame, features: str = "features") -> DataFrame:
    """windows with motion, audio, span and box_area read off 53-value vectors."""
    v = F.col(features)
    return windows.withColumns({"motion": F.element_at(v, -2).cast("double"), "audio": F.element_at(v, -1).cast("double"), "span": vertical_span(v), "box_area": keypoint_box_area(v)})


def tensor_windows(windows: DataFrame, features: str = "features") -> DataFrame:
    """(clip_id, start, window): each window's vectors in order."""
    rows = F.array_sort(F.collect_list(F.struct("pos", F.col(features).alias("x"))))
    return windows.groupBy("clip_id", "start").agg(F.transform(rows, lambda r: r["x"]).alias("window"))


def head_windows(frames: DataFrame, columns: dict[str, str], settings: Settings = DEFAULTS) -> DataFrame:
    """The first `window` values of each column of a clip, filled with zeros: {column: result name}."""
    kept = frames.where(F.col("frame_idx") < settings.window)
    rows = F.array_sort(F.collect_list(F.struct("frame_idx", *(F.col(c) for c in columns))))
    out = kept.groupBy("clip_id").agg(rows.alias("_rows"))

    def values(c: str) -> Column:
        return F.transform("_rows", lambda r: r[c].cast("double"))

    return out.select("clip_id", *(head_window(values(c), settings.window).alias(name) for c, name in columns.items()))


def runtime_tensor(posture: Column, motion: Column, audio: Column, settings: Settings = DEFAULTS) -> Column:
    """A 32 x 53 matrix with posture in slot 0, motion in 51 and audio in 52, zeros elsewhere."""
    zeros = lambda n: F.array_repeat(F.lit(0.0), n)
    at = lambda s, k: F.array(F.coalesce(F.get(s, k), F.lit(0.0)))
    return F.transform(F.sequence(F.lit(0), F.lit(settings.window - 1)), lambda k: F.concat(at(posture, k), zeros(50), at(motion, k), at(audio, k)))


def longest_track(tracks: DataFrame, file: str, length: str, position: str) -> DataFrame:
    """One track for each file: the longest, the first of equals; empty ones are none."""
    best = Window.partitionBy(file).orderBy(F.col(length).desc(), F.col(position))
    return tracks.withColumn("_k", F.row_number().over(best)).where(f"_k = 1 and `{length}` > 0").drop("_k")


def order_frame_keys(keys: Column | str, numeric: bool = False) -> Column:
    """Sorted frame keys, as text ("10" before "2") or as numbers."""
    keys = F.col(keys) if isinstance(keys, str) else keys
    if not numeric:
        return F.array_sort(keys)
    by_number = F.array_sort(F.transform(keys, lambda k: F.struct(F.try_to_number(k, F.lit("999999999999")).alias("n"), k.alias("k"))))
    return F.transform(by_number, lambda s: s["k"])


def first_appearance(rows: DataFrame, label: str, position: list[str], into: str = "label_id") -> DataFrame:
    """Each label's dense id from 0, by its first row in `position`; one row for each label."""
    first = rows.groupBy(label).agg(F.min(F.struct(*position)).alias("_first"))
    return first.withColumn(into, (F.row_number().over(Window.orderBy("_first")) - 1).cast("long")).drop("_first")
