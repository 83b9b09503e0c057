import io
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark import config
from tidemark.operators import curate, frames, windows
from tidemark.sources import decode, readers, sinks


def npz(frames_, fps=None):
    out = io.BytesIO()
    np.savez(out, frames=frames_, **({} if fps is None else {"fps": fps}))
    return out.getvalue()


def moving_square(n, size=64):
    clip = np.zeros((n, size, size, 3), np.uint8)
    for k in range(n):
        clip[k, 10:30, 4 + 4 * k : 24 + 4 * k] = 200
    return clip


def test_decode(spark):
    clips = spark.createDataFrame([("a.npz", npz(moving_square(5), 25.0)), ("bad.npz", b"x"), ("none.npz", npz(np.zeros((0, 8, 8), np.uint8)))], "path string, content binary")
    rows = sorted(decode.decode(clips, decode.ArrayDecoder()).collect(), key=lambda r: r.frame_idx)
    assert [r.frame_idx for r in rows] == [0, 1, 2, 3, 4] and {r.clip_id for r in rows} == {"a.npz"} and rows[0].fps == 25.0 and rows[0].total_frames == 5
    assert rows[0].motion == 0.0 and all(r.motion > 1 for r in rows[1:])
    assert all(0.7 < r.aspect_ratio < 1.4 and 80 <= r.area <= 170 and r.latency_ms > 0 for r in rows)
    few = decode.decode(clips, decode.ArrayDecoder(), config.Settings(max_frames=2))
    assert few.count() == 2


def test_pixels():
    rng = np.random.default_rng(0)
    image = rng.integers(0, 256, (8, 12), dtype=np.uint8)
    small = decode.resize_area(image, 0.5)
    assert (small == np.rint(image.reshape(4, 2, 6, 2).mean((1, 3)))).all()
    assert (decode.blur(np.full((5, 5), 9, np.uint8)) == 9).all() and decode.blur(image, 5).shape == image.shape
    two = np.where(np.arange(100) < 60, 20, 220).astype(np.uint8).reshape(10, 10)
    assert 20 <= decode.otsu(two) < 220
    mask = np.zeros((6, 9), bool)
    mask[1:3, 1:3] = mask[3:6, 3:8] = True
    assert decode.largest_box(mask) == (1, 1, 7, 5)
    mask[2, 2] = False
    assert decode.largest_box(mask) == (3, 3, 5, 3) and decode.largest_box(mask & False) is None
    ring = np.zeros((9, 20), bool)  # a ring's hole counts as filled, what lies in it too
    ring[0:7, 0:7] = True
    ring[1:6, 1:6] = False
    ring[3, 3] = True
    ring[2:8, 9:15] = True
    assert decode.largest_box(ring) == (0, 0, 7, 7)
    diagonal = np.eye(12, dtype=bool)  # many pixels, no area
    diagonal[0:3, 8:11] = True
    assert decode.largest_box(diagonal) == (8, 0, 3, 3)
    bgr = np.zeros((2, 2, 3), np.uint8)
    bgr[..., 1] = 100
    assert (decode.to_gray(bgr) == 59).all()


def test_uploads(spark):
    rows = [("a.MP4", 1), ("b.txt", 1), ("", 1), (None, 1), ("c.mkv", 0)]
    got = spark.createDataFrame(rows, "path string, length long").select(readers.upload_error().alias("e")).collect()
    assert [r.e for r in got] == [None, "unsupported type", "missing name", "missing name", "empty file"]
    kinds = spark.createDataFrame([("video/x",), ("image/png",), (None,)], "m string").select(readers.is_media("m").alias("x")).collect()
    assert [r.x for r in kinds] == [True, False, False]


def test_label_map(spark, tmp_path):
    (tmp_path / "labels.csv").write_text("filename,label\n a.json , theft \nb.json,none\na.json,none\n")
    got = {r.filename: r.label for r in readers.read_label_map(spark, str(tmp_path / "labels.csv")).collect()}
    assert got == {"a.json": "none", "b.json": "none"}


def pose(n, value=1.0, width=51):
    return {str(k): {"keypoints": [value * k + j for j in range(width)]} for k in range(n)}


def test_pose_files_to_training_windows(spark, tmp_path):
    root = tmp_path / "poses" / "deep"
    root.mkdir(parents=True)
    name = "{}_alphapose_tracked_person.json".format
    (root / name("a")).write_text(json.dumps({"p1": pose(40), "p2": pose(40, 2.0), "p3": "junk", "p4": pose(3)}))
    (root / name("b")).write_text(json.dumps({"p": pose(31)}))
    (root / name("c")).write_text("{}")
    (root / name("d")).write_text(json.dumps({"p": pose(48, 1.0, 48)}))
    (root / name("e")).write_text("not json")
    (root / "other.json").write_text(json.dumps({"p": pose(50)}))
    files = readers.read_pose_files(spark, str(tmp_path / "poses"))
    raw = readers.annotation_frames(files)
    first = sorted((r for r in raw.where(F.col("clip_id").startswith("a_")).collect()), key=lambda r: r.frame_idx)
    assert len(first) == 40 and [r.keypoints[0][0] for r in first[:4]] == [0.0, 1.0, 10.0, 11.0]  # keys in text order, the first of equal tracks
    moved = frames.track_motion(raw)
    labels = spark.createDataFrame([(name("a"), "theft"), (name("b"), "x"), (name("d"), "none")], "filename string, label string")
    records = sinks.annotation_records(moved, labels)
    assert sorted((r.label, len(r.frames)) for r in records.collect()) == [("none", 48), ("theft", 40)]
    sinks.write_annotations(records, str(tmp_path / "ann"))
    back = readers.read_annotations(spark, str(tmp_path / "ann"))
    assert sorted(r.label for r in back.collect()) == ["none", "theft"]
    numeric = readers.annotation_frames(files, numeric_order=True).where(F.col("clip_id").startswith("a_")).orderBy("frame_idx").collect()
    assert [r.keypoints[0][0] for r in numeric[:4]] == [0.0, 1.0, 2.0, 3.0]
    counts = windows.sliding_windows(moved).groupBy("clip_id").agg(F.countDistinct("start").alias("n")).collect()
    assert sorted(r.n for r in counts) == [2, 3]


@pytest.mark.parametrize(("n", "want"), [(31, 0), (32, 1), (39, 1), (40, 2), (48, 3)])
def test_window_count(spark, n, want):
    df = spark.range(n).select(F.lit("c").alias("clip_id"), F.col("id").cast("int").alias("frame_idx"))
    rows = windows.sliding_windows(df).collect()
    assert len({r.start for r in rows}) == want and len(rows) == 32 * want
    assert windows.window_counts(df).first().windows == want
    assert windows.long_enough(df).count() == (n if want else 0)


def test_sft_files(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"prompt": "p", "response": "r"}\n\n{"messages": [{"role": "user", "content": "x"}]}\n')
    assert readers.read_sft(spark, str(tmp_path / "a.jsonl")).count() == 2
    (tmp_path / "b.jsonl").write_text("")
    with pytest.raises(ValueError):
        readers.read_sft(spark, str(tmp_path / "b.jsonl"))


def test_tensor_file(spark, tmp_path):
    np.savez(tmp_path / "w.npz", X=np.arange(2 * 32 * 53, dtype=np.float32).reshape(2, 32, 53), y=np.array([1, 0], np.int32), labels=np.array(["a", "b"]))
    rows = readers.read_tensor_file(spark, str(tmp_path / "w.npz")).orderBy("start").collect()
    assert [r.label for r in rows] == ["b", "a"] and len(rows[0].window) == 32 and rows[1].window[0][0] == 32 * 53.0


def report(spark, k):
    return spark.createDataFrame([(f"id{k}", f"f{k}.mp4", 5.0, "s")], "report_id string, source_filename string, processing_time_ms double, summary string").withColumns(
        {"created_at": F.lit(f"2024-01-0{k} 00:00:00").cast("timestamp"), "incidents": F.array(F.struct(F.lit("shoplifting").alias("incident_type"), F.lit(0.7).alias("confidence"), F.lit(1.5).alias("timestamp_seconds"), F.lit("e").alias("evidence"), F.lit("a").alias("recommended_action")))}
    )


def test_report_files(spark, tmp_path):
    folder = tmp_path / "reports"
    folder.mkdir()
    (folder / "good.json").write_text(json.dumps({"report_id": "a", "summary": "s", "incidents": [{"incident_type": "none", "confidence": 0.8}], "created_at": "2024-01-02T03:04:05Z"}, indent=2))
    (folder / "bad.json").write_text('{"report_id": ')
    rows = readers.read_reports(spark, str(folder)).collect()
    assert [(r.report_id, r.incidents[0].confidence) for r in rows] == [("a", 0.8)]


def test_sinks_are_idempotent(spark, tmp_path):
    both = report(spark, 1).unionByName(report(spark, 2))
    for _ in range(2):
        sinks.write_reports(both, str(tmp_path / "r"))
    assert spark.read.json(str(tmp_path / "r")).count() == 2
    sinks.write_reports(report(spark, 3), str(tmp_path / "r"))
    assert spark.read.json(str(tmp_path / "r")).count() == 3
    write = sinks.report_batches(str(tmp_path / "br"), str(tmp_path / "ba"))
    for number in (0, 1, 1):
        write(report(spark, number + 1), number)
    assert spark.read.json(str(tmp_path / "br")).count() == 2 and spark.read.json(str(tmp_path / "ba")).count() == 2
    body = json.loads(sinks.response(report(spark, 1)).first().body)
    assert body["report"]["report_id"] == "id1"


def test_mail(spark):
    from tidemark.operators.classify import alerts

    sent = []

    class Server:
        def __init__(self, *address):
            self.address = address

        def __enter__(self):
            return self

        def __exit__(self, *_):
            pass

        starttls = login = lambda self, *_: None

        def send_message(self, m):
            sent.append(m["Subject"])

    found = alerts(report(spark, 1))
    assert sinks.mail_alerts(found, connect=Server) == 0 and not sent
    full = config.Settings(alert_host="h", alert_to="t", alert_user="u", alert_password="p")
    assert sinks.mail_alerts(found, full, Server) == 1 and sent == ["Critical incident id1"]


def test_balance_and_split(spark):
    rows = spark.createDataFrame([(k, "a" if k < 10 else "b" if k < 14 else "c") for k in range(15)], "key long, label string")
    out = curate.balance(rows, "label", "key").groupBy("label").count().collect()
    assert {r.label: r["count"] for r in out} == {"a": 10, "b": 10, "c": 10}
    split = curate.train_validation(rows, "key").groupBy("split").count().collect()
    assert {r.split: r["count"] for r in split} == {"train": 12, "validation": 3}
    one = curate.train_validation(rows.where("key = 0"), "key", 1.0).collect()
    assert sorted(r.split for r in one) == ["train", "validation"]
    numbers = [r.place for r in curate.shuffled(spark.range(500).withColumnRenamed("id", "key"), "key").collect()]
    assert sorted(numbers) == list(range(500))


def test_adaptive_controller(spark):
    def run(latencies, skip):
        df = spark.createDataFrame([("c", k, float(x)) for k, x in enumerate(latencies)], "clip_id string, frame_idx int, latency_ms double")
        r = frames.adaptive_controller(df, skip_frames=skip).first()
        return r.downscale_hundredths, r.skip_stride_final, r.frames_processed, r.violations

    assert run([1, 1, 1], True) == (50, 1, 3, 0)
    assert run([100, 101, 150, 150, 150, 150], False) == (25, 4, 6, 5)
    assert run([101, 999, 1, 999, 1], True) == (40, 2, 3, 1)  # frames 1 and 3 are skipped


def test_stride_sample(spark):
    df = lambda n: spark.range(n).select(F.lit("c").alias("clip_id"), F.col("id").cast("int").alias("frame_idx"))
    assert frames.stride_sample(df(95)).count() == 95
    assert frames.stride_sample(df(480)).count() == 48
    timing = spark.createDataFrame([(None, 60), (0.0, 60), (25.0, 50)], "fps double, total_frames int")
    assert [(r.fps, r.duration_seconds) for r in frames.clip_timing(timing).collect()] == [(30.0, 2.0), (30.0, 2.0), (25.0, 2.0)]


def plain_regions(mask, diagonal):
    out, number = np.zeros(mask.shape, int), 0
    for r, c in zip(*np.nonzero(mask)):
        if not out[r, c]:
            number += 1
            todo = [(r, c)]
            out[r, c] = number
            while todo:
                y, x = todo.pop()
                for dy in (-1, 0, 1):
                    for dx in (-1, 0, 1):
                        a, b = y + dy, x + dx
                        if (diagonal or not dy or not dx) and 0 <= a < mask.shape[0] and 0 <= b < mask.shape[1] and mask[a, b] and not out[a, b]:
                            out[a, b] = number
                            todo.append((a, b))
    return out


@pytest.mark.parametrize("diagonal", [True, False])
def test_regions_match_a_flood_fill(diagonal):
    rng = np.random.default_rng(6)
    for density in (0.2, 0.5, 0.8, 1.0, 0.0):
        for _ in range(30):
            mask = rng.random((rng.integers(1, 14), rng.integers(1, 14))) < density
            assert (decode.regions(mask, diagonal) == plain_regions(mask, diagonal)).all()


def test_report_store_reads_one_part(spark, tmp_path):
    from tidemark.functions.text import stable_id
    from tidemark.sources import sinks

    reports = spark.range(300).select(stable_id("id").alias("report_id"), "id")
    sinks.write_report_store(reports, str(tmp_path / "s"))
    sinks.write_report_store(reports.limit(5), str(tmp_path / "s"))  # replaces parts
    key = reports.first().report_id
    found = readers.read_report(spark, str(tmp_path / "s"), key)
    assert found.collect()[0].id == 0 and len(found.inputFiles()) >= 1
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "part" in plan.split("PartitionFilters")[1][:120]
    assert readers.read_report(spark, str(tmp_path / "s"), "zz").collect() == []


def test_model_calls(spark):
    from tidemark import config
    from tidemark.operators import enrich

    clips = spark.createDataFrame([(1, "one", 0.5), (2, "two", 0.7)], "clip_id long, s string, motion double")
    seen = lambda t: '[{"incident_type": "intrusion", "confidence": 0.9}, {"incident_type": "choking"}]' if "SUMMARY:\none" in t and "retail context, person leaving" in t else "nothing"
    got = enrich.hosted_incidents(clips, "clip_id", "s", seen).collect()
    assert [(r.clip_id, r.incident_type, r.evidence) for r in got] == [(1, "intrusion", "Model reasoning")]
    assert enrich.hosted_incidents(clips, "clip_id", "s", None) is None
    base = spark.createDataFrame([(1, "shoplifting", 0.8, 1.5, "e", "a")], "clip_id long, incident_type string, confidence double, timestamp_seconds double, evidence string, recommended_action string")
    better = lambda t: '{"incident_type": "none", "confidence": 0.2}' if 'signals={"motion":0.7}\nbaseline=[]' in t else "?" if '"incident_type":"shoplifting"' in t else "!"
    out = enrich.refined(base, clips, "clip_id", F.struct("motion"), better).orderBy("clip_id").collect()
    assert [(r.clip_id, r.incident_type, r.evidence) for r in out] == [(1, "shoplifting", "e"), (2, "none", "Local model reasoning")]
    assert enrich.refined(base, clips, "clip_id", F.struct("motion"), None) is base
    settings = config.Settings(hosted_endpoint="http://h", hosted_key="k")
    assert enrich.hosted_client_of(settings) is None and enrich.hosted_client_of(config.Settings(hosted_endpoint="http://h", hosted_key="k", offline_mode=False)) is not None
    assert enrich.REFINE_TIMEOUT == 8 and enrich.refine_client_of(settings) is None


def test_class_counts_are_shown(spark, capsys):
    sinks.show_class_counts(spark.createDataFrame([("b",), ("a",), ("b",)], "label string"), "label")
    shown = [[c.strip() for c in line.split("|")[1:-1]] for line in capsys.readouterr().out.splitlines() if line.startswith("|")]
    assert shown == [["label", "count"], ["a", "1"], ["b", "2"]]


def test_texts_as_files(spark, tmp_path):
    rows = spark.createDataFrame([("a.json", "{}"), ("b.json", None), ("c.json", "é")], "name string, text string")
    for _ in range(2):  # a second run replaces the files
        assert sinks.write_texts(rows, str(tmp_path / "t")) == 3
    assert {p.name: p.read_text() for p in (tmp_path / "t").iterdir()} == {"a.json": "{}", "b.json": "", "c.json": "é"}
