import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_sources import moving_square, npz, pose
from tidemark import config, schemas
from tidemark.plans import online, training
from tidemark.sources import decode
from tidemark.sources import sinks as sinks_

SLOW = config.Settings(latency_target_ms=10_000_000)


class Named(decode.ArrayDecoder):
    """Archives under a video's suffix."""


def uploads(folder):
    folder.mkdir()
    (folder / "moving.mp4").write_bytes(npz(moving_square(10), 25.0))
    (folder / "still.MOV").write_bytes(npz(np.zeros((4, 16, 16), np.uint8)))
    (folder / "notes.txt").write_bytes(b"x")
    (folder / "empty.mp4").write_bytes(b"")
    (folder / "broken.avi").write_bytes(b"not a clip")
    return str(folder)


def test_analyze(spark, tmp_path):
    from tidemark.sources.readers import read_clips

    clips = read_clips(spark, uploads(tmp_path / "in"))
    out = online.analyze(clips, Named(), SLOW, client=lambda text: '{"evidence": "seen"}', created_at=F.lit("2024-01-01 00:00:00").cast("timestamp"))
    assert sorted(r.reason for r in out.rejected.collect()) == ["unsupported type"]  # Spark lists no empty files
    reports = {r.source_filename: r for r in out.reports.collect()}
    assert set(reports) == {"moving.mp4", "still.MOV"}
    r = reports["moving.mp4"]
    assert r.incidents[0].incident_type == "shoplifting" and r.incidents[0].evidence.endswith("LLM: seen") and r.met_latency_target
    assert r.raw_signals.video.fps == 25.0 and r.raw_signals.video.total_frames == 10 and len(r.raw_signals.video.motion_series) == 10 and r.raw_signals.latency.met_target
    assert reports["still.MOV"].incidents[0].incident_type == "none" and reports["still.MOV"].raw_signals.video.duration_seconds == pytest.approx(4 / 30)
    flat = lambda s: s.jsonValue()["fields"]
    assert [f["name"] for f in flat(out.reports.schema["raw_signals"].dataType)] == [f["name"] for f in flat(schemas.SIGNALS)]
    assert out.late.count() == 0
    assert online.analyze(clips, Named(), config.Settings(latency_target_ms=0)).late.count() == 2


def test_live(spark, tmp_path):
    folder, sinks = uploads(tmp_path / "in"), online.LiveSinks.below(str(tmp_path / "out"))
    for _ in range(2):  # a second run finds nothing new
        q = online.run_live(spark, folder, sinks, Named(), str(tmp_path / "c"), SLOW)
        q.awaitTermination()
    assert spark.read.json(sinks.reports).count() == 2
    alerts = spark.read.json(sinks.alerts).collect()
    assert [a.critical_incidents[0].incident_type for a in alerts] == ["shoplifting"]


class Sized:
    """Decodes archives whose frames are square; of the larger ones each takes over a tenth of a second."""

    def open(self, content):
        fps, n, frames_ = decode.ArrayDecoder().open(content)
        return fps, n, (np.kron(f, np.ones((80, 80, 1), np.uint8)) if f.shape[0] > 16 else f for f in frames_)


def test_every_upload_ends_in_one_of_three_sinks(spark, tmp_path):
    from tests.test_sources import moving_square, npz

    (tmp_path / "in").mkdir()
    sinks = online.LiveSinks.below(str(tmp_path / "out"))
    settings = config.Settings(latency_target_ms=60)
    small, large = npz(moving_square(3, 16)), npz(moving_square(2, 32))
    named = {"s{}.mp4": small, "l{}.mp4": large, "t{}.txt": b"x", "u{}.mp4": b"no clip"}
    names, batches = set(), []
    real = online.live_batch

    def noted(*args):
        run = real(*args)
        return lambda rows, number: batches.append((rows.select("path").collect(), number)) or run(rows, number)

    online.live_batch = noted
    try:
        for k in range(5):
            for name, body in named.items():
                (tmp_path / "in" / name.format(k)).write_bytes(body)
                names.add(name.format(k))
            online.run_live(spark, str(tmp_path / "in"), sinks, Sized(), str(tmp_path / "c"), settings, archive=str(tmp_path / "old")).awaitTermination()
    finally:
        online.live_batch = real
    assert [n for _, n in batches if _] == [0, 1, 2, 3, 4]

    def held():
        base = lambda p: p.rpartition("/")[2]
        reports = {(base(r.source_filename), "report") for r in spark.read.json(sinks.reports).collect()}
        late = {(base(r.clip_id), "late") for r in spark.read.schema("clip_id string, max_ms double").json(sinks.late).collect() if r.max_ms > 60}
        rejected = {(base(r.path), r.reason) for r in spark.read.json(sinks.rejected).collect()}
        return reports | late | rejected

    first = held()
    want = {(f"s{k}.mp4", "report") for k in range(5)} | {(f"l{k}.mp4", "late") for k in range(5)} | {(f"t{k}.txt", "unsupported type") for k in range(5)} | {(f"u{k}.mp4", "unreadable") for k in range(5)}
    assert first == want and {n for n, _ in first} == names
    # a batch that runs again changes nothing, though its latencies would be measured anew
    again = spark.read.format("binaryFile").load([f"{tmp_path}/in/{r.path.rpartition('/')[2]}" for r in batches[4][0]])
    online.live_batch(sinks, Sized(), config.Settings(latency_target_ms=60))(again, 4)
    assert held() == first


class Post:
    """A mail server that may fail."""

    sent, fails_at = [], None

    def __init__(self, host, port):
        pass

    __enter__ = lambda self: self
    __exit__ = lambda self, *a: None
    starttls = login = lambda self, *a: None

    def send_message(self, message):
        if len(Post.sent) == Post.fails_at:
            Post.fails_at = None
            raise OSError("lost")
        Post.sent.append(message["Subject"])


def test_each_alert_is_mailed_once(spark, tmp_path):
    from tests.test_sources import report

    found = report(spark, 1)
    rows = found.withColumn("report_id", F.explode(F.array(*(F.lit(f"id{k}") for k in range(6)))))
    settings = config.Settings(alert_host="h", alert_to="t", alert_user="u", alert_password="p")
    mail = sinks_.mail_batches(str(tmp_path / "ledger"), settings, Post)
    Post.sent, Post.fails_at = [], 3
    with pytest.raises(OSError):
        mail(rows, 0)
    assert len(Post.sent) == 3
    for number in (0, 0, 1):
        mail(rows, number)
    assert sorted(Post.sent) == [f"Critical incident id{k}" for k in range(6)]
    mail(rows.withColumn("report_id", F.lit("new")), 2)
    mail(rows.withColumn("report_id", F.lit("new")).unionByName(rows), 3)
    assert len(Post.sent) == 7 and Post.sent[-1] == "Critical incident new"
    sinks_.mail_batches(str(tmp_path / "ledger"), config.Settings(), Post)(rows, 4)
    assert len(Post.sent) == 7


def test_training_tables(spark, tmp_path):
    root = tmp_path / "poses"
    root.mkdir()
    name = "{}_alphapose_tracked_person.json".format
    for k, n in (("a", 40), ("b", 48), ("c", 31), ("d", 32)):
        (root / name(k)).write_text(json.dumps({"p": pose(n, 3.0)}))
    (tmp_path / "labels.csv").write_text("filename,label\n" + "".join(f"{name(k)},{x}\n" for k, x in (("a", "none"), ("b", "shoplifting"), ("c", "none"))))
    t = training.tables(spark, str(root), str(tmp_path / "labels.csv"))
    assert {r.label: r.label_id for r in t.vocabulary.collect()} == {"none": 0, "shoplifting": 1}
    assert t.windows.select("clip_id", "start").distinct().count() == 5 and len(t.windows.first().features) == 53
    signals = t.signals.collect()
    assert len(signals) == 5 and all(r.frames == 32 and r.motion_mean > 0 and r.audio_distress == 0 for r in signals)
    rows = training.instruction_rows(spark, t.signals, 4, 6, balanced=True)
    counts = {r.label: r["count"] for r in rows.groupBy("label").count().collect()}
    assert counts == {"none": 9, "shoplifting": 9}
    one = rows.where("label = 'none'").first()
    assert one.prompt.startswith(config.PROMPTS["training"][:200]) and json.loads(one.response)[0]["incident_type"] == "none"
    meta = training.recipe(rows, "base", rank=16).first()
    assert meta.rows == 18 and json.loads(meta.settings) == {"rank": "16"}
    assert training.model_file("m", "a").count("\n") == 4
