"""From pose files and labels to training tables: windows, vocabulary, instruction rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import config
from tidemark.config import DEFAULTS, Settings
from tidemark.functions.vectors import flatten_features
from tidemark.operators import curate, frames, windows
from tidemark.sources import readers


@dataclass(frozen=True)
class TrainingTables:
    annotations: DataFrame  # clip_id, path, label, frame_idx, keypoints, motion, audio_distress
    windows: DataFrame  # clip_id, start, pos, features, label
    vocabulary: DataFrame  # label, label_id
    signals: DataFrame  # sample_id, label, window signals


def tables(spark: SparkSession, poses: str, label_map: str, settings: Settings = DEFAULTS) -> TrainingTables:
    """One lineage from files to windows; only clips with a label and enough frames go on."""
    labels = readers.read_label_map(spark, label_map).withColumnRenamed("filename", "clip_id")
    rows = frames.track_motion(readers.annotation_frames(readers.read_pose_files(spark, poses)))
    rows = curate.label_join(windows.long_enough(rows, settings.window), labels, "clip_id").withColumn("audio_distress", F.lit(0.0))
    cut = windows.sliding_windows(rows.withColumn("features", flatten_features("keypoints", "motion", "audio_distress")), settings)
    cut = cut.select("clip_id", "start", "pos", "features", "label")
    vocabulary = windows.first_appearance(rows, "label", ["path"])
    signals = windows.window_signals(windows.vector_window_frames(cut)).join(labels, "clip_id")
    signals = signals.withColumn("sample_id", F.xxhash64("clip_id", "start"))
    return TrainingTables(rows, cut, vocabulary, signals)


def instruction_rows(spark: SparkSession, signals: DataFrame, synthetic_none: int = 0, synthetic_taking: int = 0, balanced: bool = False) -> DataFrame:
    """sample_id, label, prompt, response: real rows, synthetic ones, and every label raised to the largest if asked."""
    made = curate.sft_rows(signals)
    for label, n in (("none", synthetic_none), ("shoplifting", synthetic_taking)):
        if n:
            own = curate.synthetic_rows(spark.range(n), label).withColumn("sample_id", F.xxhash64(F.lit(label), "sample_id"))
            made = made.unionByName(curate.sft_rows(own, F.lit(curate.SYNTHETIC_CONFIDENCE)))
    return curate.balance(made, "label", "sample_id").drop("copy") if balanced else made


def recipe(rows: DataFrame, base: str, **settings: object) -> DataFrame:
    """One row of metadata for a fine-tuning run elsewhere: base model, rows, settings as JSON."""
    values = F.create_map(*(F.lit(str(x)) for kv in sorted(settings.items()) for x in kv)) if settings else F.lit(None).cast("map<string,string>")
    return rows.agg(F.count("*").alias("rows")).select(F.lit(base).alias("base_model"), "rows", F.to_json(values).alias("settings"))


def model_file(base: str, adapter: str, system: str = config.SYSTEM_TURN, temperature: float = 0.1) -> str:
    """The four lines that a local model server reads."""
    return f'FROM {base}\nADAPTER {adapter}\nPARAMETER temperature {temperature}\nSYSTEM """{system}"""\n'
