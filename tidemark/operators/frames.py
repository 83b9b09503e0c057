"""Frames to clip signals: motion, area change, posture, latency, and the adaptive controller.

A frame table has clip_id, frame_idx (dense, from 0) and measured columns. Everything
here shuffles by clip_id once; sums are over integers, so results don't depend on how
rows meet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tidemark.config import DEFAULTS, Settings
from tidemark.functions.signals import clamp, col, exact_mean, exact_std, logistic_posture, round_4, safe_divide
from tidemark.functions.vectors import keypoint_motion

#: Distress is motion's standard deviation by this.
DISTRESS_SCALE = 25.0


def in_order(order: list[str] | None = None) -> WindowSpec:
    """A clip's frames by number, or by columns that say the same: a sort that has been done for numbering serves again."""
    return Window.partitionBy("clip_id").orderBy(*(order or ["frame_idx"]))


def index_frames(df: DataFrame, order: list[str], into: str = "frame_idx") -> DataFrame:
    """Dense frame numbers from 0 in each clip."""
    return df.withColumn(into, (F.row_number().over(Window.partitionBy("clip_id").orderBy(*order)) - 1).cast("int"))


def first_frames(frames: DataFrame, most: int = DEFAULTS.max_frames) -> DataFrame:
    return frames.where(F.col("frame_idx") < most)


def stride_sample(frames: DataFrame, samples: int = 48) -> DataFrame:
    """Frames at multiples of max(1, total / samples), which isn't a cap: 95 frames keep all."""
    total = F.count("*").over(Window.partitionBy("clip_id"))
    stride = F.greatest(F.lit(1), F.floor(total / samples))
    return frames.withColumn("_s", stride).where(F.col("frame_idx") % F.col("_s") == 0).drop("_s")


def frame_motion(value: Column | str, order: list[str] | None = None) -> Column:
    """Absolute change from the frame before; 0 for the first."""
    return F.coalesce(F.abs(col(value) - F.lag(col(value)).over(in_order(order))), F.lit(0.0))


def pixel_motion(frames: DataFrame, pixels: str = "gray") -> DataFrame:
    """Motion as the mean absolute difference of two frames' pixel arrays."""
    before = F.lag(pixels).over(in_order())
    total = F.aggregate(F.zip_with(F.col(pixels), F.col("_before"), lambda a, b: F.abs(a - b).cast("double")), F.lit(0.0), lambda s, x: s + x)
    moved = F.when(F.col("_before").isNull(), 0.0).otherwise(total / F.greatest(F.size(pixels), F.lit(1)))
    return frames.withColumn("_before", before).withColumn("motion", moved).drop("_before")


def track_motion(frames: DataFrame, keypoints: str = "keypoints") -> DataFrame:
    """Motion as the mean distance of the joints from the frame before."""
    return frames.withColumn("_before", F.lag(keypoints).over(in_order())).withColumn("motion", keypoint_motion(keypoints, "_before")).drop("_before")


def area_change(area: Column | str = "area", order: list[str] | None = None) -> Column:
    """Absolute change of the area; before the first frame it is 0, so the first change is its own area."""
    return F.abs(col(area) - F.lag(col(area), 1, 0.0).over(in_order(order)))


def motion_frames(frames: DataFrame, order: list[str] | None = None) -> DataFrame:
    """frames with area_change (from area), horizontal (from aspect_ratio) and motion, from brightness where a decoder hasn't measured it."""
    motion = {} if "motion" in frames.columns else {"motion": frame_motion("brightness", order)}
    return frames.withColumns(motion | {"area_change": area_change(order=order), "horizontal": logistic_posture("aspect_ratio")})


def signal_sums(scale: int = 1000) -> list[Column]:
    """Aggregates of clip_signals; brightness, motion and area change are taken in units of 1 / scale."""
    return [
        F.count("*").alias("sample_count"),
        exact_mean("brightness", scale).alias("brightness_mean"),
        exact_mean("motion", scale).alias("motion_mean"),
        exact_std("motion", scale).alias("motion_std"),
        exact_mean("horizontal", 1_000_000).alias("horizontal_posture_score"),
        exact_mean("area_change", scale).alias("area_change_mean"),
    ]


def clip_aggregates(frames: DataFrame, *more: Column, scale: int = 1000, settings: Settings = DEFAULTS, order: list[str] | None = None) -> DataFrame:
    """Signals, and whatever else is asked of a clip's frames, in one grouping of at most max_frames of them."""
    out = motion_frames(first_frames(frames, settings.max_frames), order).groupBy("clip_id").agg(*signal_sums(scale), *more)
    return out.withColumn("distress_score", clamp(F.col("motion_std") / DISTRESS_SCALE))


def clip_signals(frames: DataFrame, scale: int = 1000, settings: Settings = DEFAULTS, order: list[str] | None = None) -> DataFrame:
    """Means of brightness, motion, posture and area change, population std of motion, distress, per clip, over its first max_frames frames."""
    return clip_aggregates(frames, scale=scale, settings=settings, order=order)


def pose_change_mean(values: Column | str, scale: int = 1000) -> Column:
    """Mean absolute change over the n - 1 differences of a window's column of differences, the first being null; 0 for one frame."""
    return F.coalesce(exact_mean(values, scale), F.lit(0.0))


def clip_timing(clips: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """fps (default where missing) and duration_seconds of clips with fps and total_frames."""
    fps = F.coalesce(F.nullif(F.col("fps"), F.lit(0.0)), F.lit(settings.default_fps))
    return clips.withColumn("fps", fps).withColumn("duration_seconds", safe_divide(F.col("total_frames"), F.col("fps")))


def latency_sums(settings: Settings = DEFAULTS) -> list[Column]:
    """Aggregates of latency_summary."""
    ms, target = F.col("latency_ms"), float(settings.latency_target_ms)
    return [
        F.count("*").alias("frame_count_processed"),
        F.percentile(ms, F.lit(0.5)).alias("p50_ms"),
        F.percentile(ms, F.lit(0.95)).alias("p95_ms"),
        F.max(ms).alias("max_ms"),
        F.count_if(ms > target).alias("violations"),
        F.bool_and(ms <= target).alias("met_target"),
    ]


def latency_summary(frames: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Exact interpolated p50 and p95, max, violations and whether the target was met, per clip, over its first max_frames frames.

    A percentile holds a clip's distinct values, at most max_frames.
    """
    return first_frames(frames, settings.max_frames).groupBy("clip_id").agg(*latency_sums(settings))


def latency_gate(clips: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(clips that met the target, clips to quarantine)."""
    met = F.coalesce(F.col("met_target"), F.lit(False))
    return clips.where(met), clips.where(~met)


def series_of(value: str, settings: Settings = DEFAULTS) -> Column:
    """Aggregate: the first values of a clip in frame order, four places each. Only those are gathered."""
    kept = F.when(F.col("frame_idx") < settings.series_cap, F.struct("frame_idx", F.col(value).alias("x")))
    return F.transform(F.array_sort(F.collect_list(kept)), lambda r: round_4(r["x"]))


def series(frames: DataFrame, value: str, into: str, settings: Settings = DEFAULTS) -> DataFrame:
    return frames.where(F.col("frame_idx") < settings.series_cap).groupBy("clip_id").agg(series_of(value, settings).alias(into))


def controller_fold(settings: Settings = DEFAULTS, skip_frames: bool = True) -> Column:
    """Aggregate: final downscale (in hundredths) and stride of each clip, and what was processed.

    On a latency over the target the downscale falls by a tenth to a quarter at least and
    the stride grows to four at most; neither relaxes. Without skip_frames every one of
    the first max_frames is processed, and the state is a function of the number of late
    ones. With it a frame is processed only where its index is a multiple of the stride so
    far, and no more than max_frames are: a fold over a clip's frames in order, of which
    max_frames times max_stride can matter and are gathered.
    """
    down, least = round(settings.downscale_step * 100), round(settings.min_downscale * 100)
    first = round(settings.initial_downscale * 100)
    if not skip_frames:
        seen = F.col("frame_idx") < settings.max_frames
        late = F.count_if(seen & (F.col("latency_ms") > settings.latency_target_ms)).cast("int")
        d = F.greatest(F.least(F.lit(first), F.lit(least)), F.lit(first) - late * down)
        return F.struct(d.alias("d"), F.least(F.lit(settings.max_stride), late + 1).alias("s"), F.count_if(seen).cast("int").alias("n"), late.alias("v"))
    start = F.struct(*(F.lit(v).cast("int").alias(k) for k, v in (("d", first), ("s", 1), ("n", 0), ("v", 0))))

    def step(a: Column, r: Column) -> Column:
        late = r["latency_ms"] > settings.latency_target_ms
        seen = F.struct(
            F.when(late, F.greatest(F.lit(least), a["d"] - down)).otherwise(a["d"]).alias("d"),
            F.when(late, F.least(F.lit(settings.max_stride), a["s"] + 1)).otherwise(a["s"]).alias("s"),
            (a["n"] + 1).alias("n"),
            (a["v"] + late.cast("int")).alias("v"),
        )
        return F.when((r["frame_idx"] % a["s"] == 0) & (a["n"] < settings.max_frames), seen).otherwise(a)

    row = F.struct(F.col("frame_idx").cast("int").alias("frame_idx"), F.col("latency_ms").cast("double").alias("latency_ms"))
    rows = F.array_sort(F.collect_list(F.when(F.col("frame_idx") < settings.max_frames * settings.max_stride, row)))
    return F.aggregate(rows, start, step)


def adaptive_controller(frames: DataFrame, settings: Settings = DEFAULTS, skip_frames: bool = True) -> DataFrame:
    """The controller's final state for each clip."""
    out = frames.groupBy("clip_id").agg(controller_fold(settings, skip_frames).alias("_c"))
    names = {"d": "downscale_hundredths", "s": "skip_stride_final", "n": "frames_processed", "v": "violations"}
    return out.select("clip_id", *(F.col(f"_c.{k}").cast("long").alias(v) for k, v in names.items()))


def distress(std: Column | str) -> Column:
    return F.least(F.lit(1.0), col(std) / DISTRESS_SCALE)


def signal_bundle(clips: DataFrame, settings: Settings = DEFAULTS) -> Column:
    """The nested record of a clip's signals, from a row with clip_signals, latency_summary, controller and series columns.

    Columns that a caller doesn't have (series, controller, probabilities, timing) are null in it.
    """
    have = set(clips.columns)
    c = lambda name, kind="double": F.col(name).cast(kind) if name in have else F.lit(None).cast(kind)
    s = lambda **fields: F.struct(*(v.alias(k) for k, v in fields.items()))
    doubles = "array<double>"
    video = s(
        fps=c("fps"), total_frames=c("total_frames", "int"), duration_seconds=c("duration_seconds"), sample_count=c("sample_count", "int"),
        brightness_mean=c("brightness_mean"), motion_mean=c("motion_mean"), motion_std=c("motion_std"), motion_series=c("motion_series", doubles),
    )
    pose = s(pose_sample_count=c("sample_count", "int"), horizontal_posture_score=c("horizontal_posture_score"), area_change_mean=c("area_change_mean"), horizontal_series=c("horizontal_series", doubles))
    audio = s(distress_score=c("distress_score"), audio_pipeline_status=F.lit("placeholder_from_video_proxy"))
    latency = s(
        target_ms=F.lit(settings.latency_target_ms), frame_count_processed=c("frame_count_processed", "int"), p50_ms=c("p50_ms"), p95_ms=c("p95_ms"), max_ms=c("max_ms"), violations=c("violations", "int"),
        met_target=c("met_target", "boolean"), downscale_final=c("downscale_hundredths") / 100, skip_stride_final=c("skip_stride_final", "int"), total_analysis_ms=c("total_analysis_ms"),
    )
    fast = s(available=F.coalesce(c("fast_available", "boolean"), F.lit(False)), event_probs=c("event_probs", "map<string,double>"), top_event=c("top_event", "string"), top_confidence=c("top_confidence"))
    return s(video=video, pose=pose, audio=audio, latency=latency, fast_path=fast)


def sampled_signals(frames: DataFrame, samples: int = 48) -> DataFrame:
    """The older extractor's signals: about `samples` frames at a stride, NaN counting as 0, and changes over the n - 1 differences of the kept frames.

    Its area change thus leaves out the first area, unlike clip_signals; aspect ratios are averaged too.
    """
    kept = stride_sample(frames, samples)
    change = lambda name: F.abs(F.col(name) - F.lag(name).over(in_order()))
    kept = kept.withColumns({"_m": change("brightness"), "_a": change("area"), "_h": logistic_posture("aspect_ratio")})
    return kept.groupBy("clip_id").agg(
        F.count("*").alias("sample_count"),
        F.coalesce(exact_mean(F.nanvl("_m", F.lit(0.0))), F.lit(0.0)).alias("motion_mean"),
        F.coalesce(exact_std(F.nanvl("_m", F.lit(0.0))), F.lit(0.0)).alias("motion_std"),
        exact_mean("_h", 1_000_000).alias("horizontal_posture_score"),
        exact_mean("aspect_ratio", 10_000).alias("aspect_ratio_mean"),
        pose_change_mean("_a").alias("area_change_mean"),
    )
