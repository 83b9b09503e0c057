"""Sinks: idempotent reports and alerts, training files, mail."""

from __future__ import annotations

import smtplib
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from email.mime.text import MIMEText

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from tidemark import config
from tidemark.config import DEFAULTS, Settings
from tidemark.functions.text import upload_name
from tidemark.operators.classify import alerts
from tidemark.sources import avi


def write_reports(reports: DataFrame, path: str, kind: str = "json") -> None:
    """Reports by day; a day that is written again is replaced, so a rerun leaves one copy."""
    by_day = reports.withColumn("day", F.to_date("created_at"))
    by_day.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").format(kind).save(path)


def write_report_store(reports: DataFrame, path: str) -> None:
    """Reports by the first characters of their ids, for reads by id; a part that is written again is replaced."""
    parts = reports.withColumn("part", F.substring("report_id", 1, config.REPORT_PART)).repartition("part")
    parts.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(path)


def write_alerts(reports: DataFrame, path: str, settings: Settings = DEFAULTS) -> None:
    alerts(reports, settings).write.mode("overwrite").json(path)


def report_batches(reports_path: str, alerts_path: str, settings: Settings = DEFAULTS) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that writes a batch's reports and alerts under its number: a repeated batch replaces itself."""

    def run(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            batch.write.mode("overwrite").json(f"{reports_path}/batch={number}")
            alerts(batch, settings).write.mode("overwrite").json(f"{alerts_path}/batch={number}")
        finally:
            batch.unpersist()

    return run


@contextmanager
def _mail_server(settings: Settings, connect: Callable) -> Iterator:
    with connect(settings.alert_host, settings.alert_port) as server:
        server.starttls()
        server.login(settings.alert_user, settings.alert_password)
        yield server


def _message(row: Row, settings: Settings) -> MIMEText:
    message = MIMEText(str({k: v for k, v in row.asDict(recursive=True).items() if k != "_digest"}), "plain", "utf-8")
    message["Subject"] = f"Critical incident {row.report_id}"
    message["From"], message["To"] = settings.alert_from, settings.alert_to
    return message


def mail_alerts(found: DataFrame, settings: Settings = DEFAULTS, connect: Callable = smtplib.SMTP) -> int:
    """Send each alert by mail; nothing unless host, recipient, user and password are all set. Returns how many were sent. See mail_batches for alerts that are sent once."""
    if not settings.mail_available():
        return 0
    sent = 0
    with _mail_server(settings, connect) as server:
        for row in found.toLocalIterator():
            server.send_message(_message(row, settings))
            sent += 1
    return sent


def land_uploads(clips: DataFrame, path: str) -> None:
    """Accepted uploads as rows under their landed names, stamped and unique."""
    name = upload_name(F.col("modificationTime"), F.md5(F.concat_ws(":", "path", F.col("length").cast("string"))), "path")
    clips.withColumn("landed_name", name).write.mode("append").parquet(path)


#: Bytes of a clip's frames that are written at once, unless one has more.
CHUNK_BYTES = 1 << 20


def write_clips(frames: DataFrame, path: str, width: int, height: int, channels: int = 1, fps: float = 25.0) -> int:
    """An uncompressed AVI file for each clip_id below a path, from frames with frame_idx and pixels (bytes, the first row on top). Returns how many.

    A clip is one file and so one task's, which writes some frames after others, `CHUNK_BYTES` of
    them at once. A file is written under another name and then renamed, so one that a lost
    task left is replaced.
    """
    counted = frames.withColumn("_n", F.count("*").over(Window.partitionBy("clip_id")))
    dealt = counted.repartition("clip_id").sortWithinPartitions("clip_id", "frame_idx").select("clip_id", "_n", "pixels")
    shape, size = (height, width) if channels == 1 else (height, width, channels), avi.frame_bytes(width, height, channels)
    most, whole = max(1, CHUNK_BYTES // size), width * height * channels

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(path) if ":/" in path else (pafs.LocalFileSystem(), path)
        fs.create_dir(root, recursive=True)
        clip, n, left, out, done = None, 0, 0, None, 0
        for batch in batches:
            clips, counts, pixels = (batch.column(k) for k in ("clip_id", "_n", "pixels"))
            at = 0
            while at < len(batch):
                if out is None:
                    clip, n, hidden = clips[at].as_py(), counts[at].as_py(), f"{root}/_{uuid.uuid4().hex}"
                    left = n
                    out = fs.open_output_stream(hidden)
                    out.write(avi.avi_head(width, height, channels, n, fps))
                images = pixels.slice(at, min(left, most)).to_pylist()
                if any(len(image) != whole for image in images):
                    raise ValueError(f"a frame of clip {clip} hasn't {whole} bytes")
                out.write(avi.frame_chunks(np.frombuffer(b"".join(images), np.uint8).reshape(len(images), *shape)))
                at += len(images)
                left -= len(images)
                if not left:
                    out.write(avi.avi_index(n, size))
                    out.close()
                    fs.move(hidden, f"{root}/{clip}.avi")
                    out, done = None, done + 1
        yield pa.record_batch([pa.array([done], pa.int64())], ["n"])

    return dealt.mapInArrow(run, "n long").agg(F.sum("n")).first()[0] or 0


def write_texts(rows: DataFrame, path: str) -> int:
    """A file with the text of each row (name, text) below a path. Returns how many; a file that a lost task left is replaced.

    Rows are dealt to all cores, as few bytes can be many files.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(path) if ":/" in path else (pafs.LocalFileSystem(), path)
        fs.create_dir(root, recursive=True)
        for batch in batches:
            for name, text in zip(batch.column("name"), batch.column("text"), strict=True):
                hidden = f"{root}/_{uuid.uuid4().hex}"
                with fs.open_output_stream(hidden) as out:
                    out.write((text.as_py() or "").encode())
                fs.move(hidden, f"{root}/{name.as_py()}")
            yield pa.record_batch([pa.array([len(batch)], pa.int64())], ["n"])

    dealt = rows.select("name", "text").repartition(rows.sparkSession.sparkContext.defaultParallelism)
    return dealt.mapInArrow(run, "n long").agg(F.sum("n")).first()[0] or 0


def send_once(ledger: str, send: Callable[[Row], None], key: list[str], every: int = 1) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that sends each row once, by a digest of its key columns.

    Digests of what was sent are kept below `ledger`, and rows that stand there or come
    twice in a batch aren't sent. They are written after every `every` rows, and for the
    rows before a failure, so a batch that runs again sends only what is left; a driver
    that is lost between sending and writing repeats `every` rows at most. Rows are sent
    from the driver one by one: this is for the few that a gate lets through.
    """

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        digest = F.sha2(F.to_json(F.struct(*key), {"ignoreNullFields": "false"}), 256)
        rows = batch.withColumn("_digest", digest).dropDuplicates(["_digest"])
        try:
            rows = rows.join(spark.read.parquet(ledger), "_digest", "left_anti")
        except AnalysisException:  # nothing has been sent yet
            pass
        sent: list[str] = []

        def note() -> None:
            if sent:
                spark.createDataFrame([(d, number) for d in sent], "_digest string, batch long").coalesce(1).write.mode("append").parquet(ledger)
                sent.clear()

        try:
            for row in rows.sort("_digest").toLocalIterator():
                send(row)
                sent.append(row["_digest"])
                if len(sent) >= every:
                    note()
        finally:
            note()

    return run


def mail_batches(ledger: str, settings: Settings = DEFAULTS, connect: Callable = smtplib.SMTP) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function over reports that mails each critical incident's alert once; nothing where mail isn't set up."""

    def run(batch: DataFrame, number: int) -> None:
        if not settings.mail_available():
            return
        with _mail_server(settings, connect) as server:
            send_once(ledger, lambda row: server.send_message(_message(row, settings)), ["report_id", "critical_incidents"])(alerts(batch, settings), number)

    return run


def write_annotations(clips: DataFrame, path: str) -> None:
    """label and frames as JSON lines."""
    clips.select("label", "frames").write.mode("overwrite").json(path)


def annotation_records(frames: DataFrame, labels: DataFrame, least: int = DEFAULTS.window) -> DataFrame:
    """label, frames of each labelled clip with enough frames; frames has clip_id, frame_idx, keypoints, motion."""
    record = F.struct("frame_idx", "keypoints", "motion", F.lit(0.0).alias("audio_distress"))
    rows = frames.groupBy("clip_id").agg(F.array_sort(F.collect_list(record)).alias("frames")).where(F.size("frames") >= least)
    joined = rows.join(labels.withColumnRenamed("filename", "clip_id"), "clip_id")
    return joined.select("clip_id", "label", F.transform("frames", lambda f: f.dropFields("frame_idx")).alias("frames"))


def write_windows(windows: DataFrame, vocabulary: DataFrame, path: str) -> None:
    windows.write.mode("overwrite").parquet(f"{path}/windows")
    vocabulary.write.mode("overwrite").parquet(f"{path}/labels")


def write_sft(rows: DataFrame, path: str) -> None:
    """prompt and response only."""
    rows.select("prompt", "response").write.mode("overwrite").json(path)


def response(reports: DataFrame, message: str = "Analysis completed.") -> DataFrame:
    """A message and a report as one JSON text each."""
    return reports.select(F.to_json(F.struct(F.lit(message).alias("message"), F.struct(*reports.columns).alias("report"))).alias("body"))


def show_class_counts(rows: DataFrame, label: str) -> None:
    rows.groupBy(label).count().orderBy(label).show(truncate=False)
