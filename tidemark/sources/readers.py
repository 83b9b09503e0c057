"""Readers of the engine's files; every schema is explicit."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import config, schemas
from tidemark.functions.text import suffix
from tidemark.functions.vectors import reshape_keypoints
from tidemark.operators.curate import last_wins
from tidemark.operators.windows import longest_track


def read_clips(spark: SparkSession, path: str) -> DataFrame:
    """Media files as rows; content is read only where it is selected. Empty files are no rows, so they never get on."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)


def stream_clips(spark: SparkSession, path: str, files_per_trigger: int = 100, archive: str | None = None) -> DataFrame:
    """A landing folder as a stream of uploads; with `archive`, files that finished batches have read are moved there."""
    reader = spark.readStream.format("binaryFile").schema(schemas.CLIP).option("maxFilesPerTrigger", files_per_trigger)
    if archive:
        reader = reader.option("cleanSource", "archive").option("sourceArchiveDir", archive)
    return reader.load(path)


#: What opening an upload counts for, in bytes: a task of 128 MB has at most 512.
OPEN_BYTES = 256 << 10


@contextmanager
def many_files(spark: SparkSession) -> Iterator[None]:
    """While it lasts, streams of a session read many small files with few tasks, unless the session says how.

    Spark looks at the files of each batch one by one, in up to 10,000 tasks, and reads at most
    32 in a task. A stream of files goes by its session's settings at each batch, so these hold
    until the query has ended.
    """
    given, cores = spark.conf.getAll, spark.sparkContext.defaultParallelism
    wanted = {"spark.sql.sources.parallelPartitionDiscovery.parallelism": 4 * cores, "spark.sql.files.openCostInBytes": OPEN_BYTES}
    mine = {key: value for key, value in wanted.items() if key not in given}
    for key, value in mine.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key in mine:
            spark.conf.unset(key)


def upload_error(path: Column | str = "path", length: Column | str = "length") -> Column:
    """Why an upload is rejected, or null: no name, a suffix that isn't allowed, an empty body."""
    path = F.col(path) if isinstance(path, str) else path
    length = F.col(length) if isinstance(length, str) else length
    return (
        F.when(F.coalesce(path, F.lit("")) == "", "missing name")
        .when(~suffix(path).isin(*config.VIDEO_SUFFIXES), "unsupported type")
        .when(F.coalesce(length, F.lit(0)) <= 0, "empty file")
    )


def is_media(mime: Column | str) -> Column:
    """The looser check of the upload form: any video type."""
    return F.coalesce((F.col(mime) if isinstance(mime, str) else mime).startswith("video/"), F.lit(False))


def accepted_uploads(clips: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected with a reason)."""
    judged = clips.withColumn("reason", upload_error())
    return judged.where("reason is null").drop("reason"), judged.where("reason is not null")


def read_label_map(spark: SparkSession, path: str) -> DataFrame:
    """filename, label from CSV files with a header, both trimmed; the last of a repeated name wins."""
    rows = spark.read.schema(schemas.LABEL_MAP).option("header", "true").csv(path)
    place = F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id())  # the order in a file, however its blocks are dealt
    rows = rows.select(F.trim("filename").alias("filename"), F.trim("label").alias("label"), place.alias("_at"))
    return last_wins(rows.where("filename is not null"), "filename", "_at").drop("_at")


POSE_GLOB = "*_alphapose_tracked_person.json"


def read_pose_files(spark: SparkSession, path: str, glob: str = POSE_GLOB) -> DataFrame:
    """filename, tracks (person to frame key to keypoints) of pose files below a folder.

    Tracks that aren't objects and frames without keypoints are no tracks and empty
    frames. Files are whole rows; a file that isn't JSON drops out.
    """
    files = spark.read.option("wholetext", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).text(path)
    rows = files.select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("filename"), F.input_file_name().alias("path"), "value")
    people = F.from_json("value", "map<string,string>")
    rows = rows.withColumn("_people", people).where("_people is not null")
    # one track that isn't an object must not void the others, so each is parsed on its own
    parsed = F.transform_values("_people", lambda _, v: F.from_json(v, "map<string,struct<keypoints:array<double>>>"))
    tracks = F.map_filter(parsed, lambda _, v: v.isNotNull())
    return rows.select("filename", "path", tracks.alias("tracks"))


def pose_tracks(files: DataFrame) -> DataFrame:
    """filename, person, pos, frames (frame key to keypoints), n for each track, in file order."""
    rows = files.select("filename", "path", F.posexplode("tracks").alias("pos", "person", "frames"))
    return rows.withColumn("n", F.size("frames"))


def annotation_frames(files: DataFrame, numeric_order: bool = False) -> DataFrame:
    """clip_id, path, frame_idx, keypoints (17 x 3) of the longest track of each pose file, frames in key order; files go by path."""
    best = longest_track(pose_tracks(files), "path", "n", "pos")
    rows = best.select(F.col("filename").alias("clip_id"), "path", F.explode("frames").alias("key", "frame"))
    from tidemark.operators.frames import index_frames

    order = F.try_to_number("key", F.lit("999999999999")) if numeric_order else F.col("key")
    indexed = index_frames(rows.withColumn("_k", order), ["_k", "key"])
    empty = F.array().cast("array<double>")
    return indexed.select("clip_id", "path", "frame_idx", reshape_keypoints(F.coalesce("frame.keypoints", empty)).alias("keypoints"))


def read_annotations(spark: SparkSession, path: str) -> DataFrame:
    """label (default none), frames (default empty) of JSON lines; blank lines are skipped."""
    rows = spark.read.schema(schemas.ANNOTATION).json(path)
    empty = F.array().cast(schemas.ANNOTATION["frames"].dataType)
    return rows.select(F.coalesce("label", F.lit("none")).alias("label"), F.coalesce("frames", empty).alias("frames"))


def read_sft(spark: SparkSession, path: str) -> DataFrame:
    """Training rows of JSON lines; no row at all is an error."""
    rows = spark.read.schema(schemas.SFT_INPUT).json(path)
    if rows.isEmpty():
        raise ValueError(f"no training rows in {path}")
    return rows


def read_windows(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(windows, vocabulary) as `write_windows` wrote them."""
    return spark.read.schema(schemas.WINDOW).parquet(f"{path}/windows"), spark.read.parquet(f"{path}/labels")


def read_tensor_file(spark: SparkSession, path: str) -> DataFrame:
    """clip_id, start, label, window from NPZ archives (X, y, labels), one file a task at a time."""
    import io
    from collections.abc import Iterator

    import pandas as pd

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np

        for files in batches:
            for name, body in zip(files["path"], files["content"], strict=True):
                with np.load(io.BytesIO(body), allow_pickle=False) as data:
                    x, y, labels = data["X"], data["y"], [str(v) for v in data["labels"]]
                for lo in range(0, len(x), 256):
                    part = x[lo : lo + 256]
                    yield pd.DataFrame({"clip_id": name, "start": range(lo, lo + len(part)), "label": [labels[int(k)] for k in y[lo : lo + 256]], "window": [w.tolist() for w in part]})

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(unpack, "clip_id string, start int, label string, window array<array<float>>")


def read_reports(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Reports of a folder of indented JSON files, one each, or of files of JSON lines; malformed ones are skipped."""
    rows = spark.read.schema(schemas.REPORT).option("multiLine", str(not lines).lower()).option("mode", "DROPMALFORMED").json(path)
    return rows.where("report_id is not null")


def read_report(spark: SparkSession, path: str, report_id: str) -> DataFrame:
    """One report of a folder that `write_report_store` wrote: only its id's partition is listed and read."""
    return spark.read.parquet(path).where((F.col("part") == report_id[: config.REPORT_PART]) & (F.col("report_id") == report_id)).drop("part")


# ---- the driver's tables in place of clips


def frames_of_events(events: DataFrame) -> DataFrame:
    """An event table as frames: a user is a clip, a value a signal.

    brightness is value / 5, aspect_ratio value / 50, area value times props.k, latency the value.
    """
    from tidemark.operators.frames import index_frames

    k = F.get_json_object("props", "$.k").cast("double")
    rows = events.select(
        F.col("user_id").alias("clip_id"), "event_id", "ts", "event_type", "value",
        (F.col("value") * 0.2).alias("brightness"), (F.col("value") / 50).alias("aspect_ratio"), (F.col("value") * k).alias("area"), F.col("value").alias("latency_ms"),
    )
    return index_frames(rows, ["ts", "event_id"])
