"""From uploaded clips to reports and alerts, as one lazy plan or as a stream of batches."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.config import DEFAULTS, Settings
from tidemark.functions.text import summary_lines
from tidemark.operators import classify as C
from tidemark.operators import enrich, frames
from tidemark.sources import decode, readers
from tidemark.sources.sinks import report_batches


@dataclass(frozen=True)
class Analysis:
    """Reports of clips that met the latency target, clips that missed it, and rejected uploads with a reason."""

    reports: DataFrame
    late: DataFrame
    rejected: DataFrame


def clip_table(signals: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """One row for each clip of a frame table (see decode.SIGNALS): signals, latency, controller and series.

    All are aggregates of one grouping, so frames are decoded once and latencies agree.
    """
    out = frames.motion_frames(frames.first_frames(signals, settings.max_frames)).groupBy("clip_id").agg(
        F.max("fps").alias("fps"),
        F.max("total_frames").alias("total_frames"),
        *frames.signal_sums(1_000_000),
        *frames.latency_sums(settings),
        frames.controller_fold(settings, skip_frames=False).alias("_c"),
        frames.series_of("motion", settings).alias("motion_series"),
        frames.series_of("horizontal", settings).alias("horizontal_series"),
    )
    out = out.withColumns({"distress_score": frames.distress("motion_std"), "downscale_hundredths": F.col("_c.d"), "skip_stride_final": F.col("_c.s")})
    return frames.clip_timing(out.drop("_c"), settings)


def summary_text() -> Column:
    return summary_lines("fps", "duration_seconds", "motion_mean", "motion_std", "brightness_mean", "horizontal_posture_score", "area_change_mean", "distress_score")


def analyze(clips: DataFrame, decoder: decode.FrameDecoder, settings: Settings = DEFAULTS, client: Callable[[str], str] | None = None, created_at: Column | None = None, keep: Callable[[DataFrame], DataFrame] | None = None) -> Analysis:
    """clips are binaryFile rows; client, if given, is asked for the evidence of emitted incidents only.

    `keep` may write the clip table out and read it again: latencies are measured, so two
    runs of one plan can differ on which clips are late.
    """
    accepted, rejected = readers.accepted_uploads(clips)
    rows = clip_table(decode.decode(accepted, decoder, settings), settings)
    rows = keep(rows) if keep else rows
    met, late = frames.latency_gate(rows)
    classified = C.classify(met)
    gated = classified.where((F.col("incident_type") != "none") & (F.col("confidence") >= settings.min_confidence)).withColumn("_summary", summary_text())
    replies = enrich.model_evidence(gated, "clip_id", "_summary", client or enrich.client_of(settings))
    found = C.emit(classified, settings, replies=replies)
    bundle = met.withColumns({"raw_signals": frames.signal_bundle(met, settings), "source_filename": F.element_at(F.split("clip_id", "/"), -1), "processing_time_ms": F.col("p95_ms")})
    reports = C.assemble_reports(bundle, found, settings, created_at, F.col("raw_signals"))
    return Analysis(reports, late, rejected.select("path", "length", "reason"))


@dataclass(frozen=True)
class LiveSinks:
    """Folders of a live query: what it finds, and what else becomes of an upload. Each batch writes below its number."""

    reports: str
    alerts: str
    late: str
    rejected: str
    clips: str

    @classmethod
    def below(cls, folder: str) -> LiveSinks:
        return cls(*(f"{folder}/{name}" for name in ("reports", "alerts", "late", "rejected", "clips")))


def _kept(path: str) -> Callable[[DataFrame], DataFrame]:
    """Writes a table once, with a mark that it is whole; a batch that runs again reads what the first run left."""

    def run(rows: DataFrame) -> DataFrame:
        spark = rows.sparkSession
        done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
        if not done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
            rows.write.mode("overwrite").parquet(path)
        return spark.read.schema(rows.schema).parquet(path)

    return run


def live_batch(sinks: LiveSinks, decoder: decode.FrameDecoder, settings: Settings = DEFAULTS, client: Callable[[str], str] | None = None, mail: Callable[[DataFrame, int], None] | None = None) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: every upload of a batch ends in reports, in late (with its latency) or in rejected (with a reason).

    Clips are decoded once and their measured signals kept below the batch's number, and
    all else follows from these, so a batch that runs again changes nothing. Accepted
    files that can't be decoded are rejected as such.
    """
    write = report_batches(sinks.reports, sinks.alerts, settings)

    def run(uploads: DataFrame, number: int) -> None:
        own = _kept(f"{sinks.clips}/batch={number}")
        kept: list[DataFrame] = []
        found = analyze(uploads, decoder, settings, client, keep=lambda rows: kept.append(own(rows)) or kept[0])
        # an upload that isn't accepted is never decoded, so one look at the batch tells all that are rejected
        judged = uploads.select("path", "length", readers.upload_error().alias("why"))
        rejected = judged.join(kept[0].select(F.col("clip_id").alias("path")), "path", "left_anti")
        rejected.select("path", "length", F.coalesce("why", F.lit("unreadable")).alias("reason")).write.mode("overwrite").json(f"{sinks.rejected}/batch={number}")
        late = found.late.select("clip_id", "frame_count_processed", "p50_ms", "p95_ms", "max_ms", "violations")
        late.write.mode("overwrite").json(f"{sinks.late}/batch={number}")
        write(found.reports, number)
        if mail is not None:
            mail(found.reports, number)

    return run


def run_live(spark: SparkSession, uploads: str, sinks: LiveSinks, decoder: decode.FrameDecoder, checkpoint: str, settings: Settings = DEFAULTS, client: Callable[[str], str] | None = None, files: int = 100, archive: str | None = None, mail: Callable[[DataFrame, int], None] | None = None, **trigger):
    """Start a query that analyses what lands in a folder, `files` uploads a batch; see live_batch for what becomes of them.

    With `archive`, uploads that a finished batch has read are moved there; `mail` is a
    foreachBatch function over the reports, see sinks.mail_batches. Where uploads are many
    and small, let the query run within readers.many_files.
    """
    stream = readers.stream_clips(spark, uploads, files, archive).writeStream.foreachBatch(live_batch(sinks, decoder, settings, client, mail)).option("checkpointLocation", checkpoint)
    return stream.trigger(**(trigger or {"availableNow": True})).start()
