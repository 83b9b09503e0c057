"""The queries, each a function of (spark, sf_dir). Ids and counts are longs, shares are whole numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark import config, schemas
from tidemark.functions import chat, signals, text, vectors
from tidemark.functions.llm_json import LOCAL_EVIDENCE, parse_replies
from tidemark.operators import classify as C
from tidemark.operators import curate, frames, network, windows
from tidemark.operators import model as ml
from tidemark.plans import online
from tidemark.sources import avi, readers, sinks
from tidemark.streaming import live

# The class that an event type stands for, and the gap that ends a session.
CLASS_OF = {"click": "shoplifting", "purchase": "suspicious_activity", "view": "none", "error": "violent_activity", "signup": "intrusion"}
SESSION_GAP = "2 hours"
#: What orders a clip's frames in the event table; sorting by it once serves numbering and lags.
ORDER = ["ts", "event_id"]
#: Users' clips are shorter than the caps on frames and series, so some queries take ten cameras' instead.
CAMERAS = 10


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.frames_of_events(table(spark, sf_dir, "events"))


def _camera_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.frames_of_events(table(spark, sf_dir, "events").withColumn("user_id", F.col("user_id") % CAMERAS))


def _clips(spark: SparkSession, sf_dir: str, *more: Column) -> DataFrame:
    """Signals, latency and more of each clip in one grouping; percentiles of values with two decimals have four."""
    out = frames.clip_aggregates(_frames(spark, sf_dir), *frames.latency_sums(), *more, order=ORDER)
    return out.withColumns({c: F.round(c, 4) for c in ("p50_ms", "p95_ms")})


def _class_of(event_type: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in CLASS_OF.items() for x in kv)), event_type)


def _long(**columns: Column | str) -> list[Column]:
    return [(F.col(c) if isinstance(c, str) else c).cast("long").alias(name) for name, c in columns.items()]


def _time(c: str) -> Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


# ---- clips to incidents


def clip_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.clip_signals(_frames(spark, sf_dir), order=ORDER)


def camera_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clips longer than the cap on frames."""
    return frames.clip_signals(_camera_frames(spark, sf_dir), order=ORDER)


def clip_latency_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values have two decimals, so interpolated ones have four."""
    out = frames.latency_summary(_frames(spark, sf_dir))
    return out.withColumns({c: F.round(c, 4) for c in ("p50_ms", "p95_ms")})


def latency_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    met, missed = frames.latency_gate(clip_latency_summary(spark, sf_dir))
    return met.withColumn("gate", F.lit("pass")).unionByName(missed.withColumn("gate", F.lit("quarantine"))).select("clip_id", "gate", "max_ms", "violations")


def _classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.classify(clip_signals(spark, sf_dir))


def clip_incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _classified(spark, sf_dir)
    emitted = (F.col("incident_type") != "none") & (F.col("confidence") >= config.DEFAULTS.min_confidence)
    return out.select("clip_id", "incident_type", "confidence", "rule", emitted.alias("emitted"))


def _with_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clip signals with class probabilities: the shares of a clip's event types."""
    of = _class_of(F.col("event_type"))
    rows = _clips(spark, sf_dir, *(F.count_if(of == c).alias(f"_n_{c}") for c in CLASS_OF.values()))
    shares = F.create_map(*(x for c in CLASS_OF.values() for x in (F.lit(c), F.col(f"_n_{c}") / F.col("sample_count"))))
    return rows.withColumn("event_probs", shares).withColumn("fast_available", F.lit(True))


def clip_incidents_fastpath(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = C.classify(_with_shares(spark, sf_dir), fast_path=True)
    labels = F.array(*(F.lit(c) for c in CLASS_OF.values()))
    top = signals.top_class(labels, F.transform(labels, lambda c: signals.get_or("event_probs", c, 0.0)))
    return out.select("clip_id", "incident_type", "confidence", "rule", top["label"].alias("top_event"), top["probability"].alias("top_confidence"))


def _reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A clip has one incident at most, so its report needs no other shuffle than its signals."""
    rows = C.classify(_clips(spark, sf_dir))
    clips = rows.withColumn("source_filename", F.concat(F.lit("clip_"), F.col("clip_id").cast("string"), F.lit(".mp4"))).withColumn("processing_time_ms", F.col("p95_ms"))
    return C.clip_reports(clips, created_at=F.lit("2024-02-01 00:00:00").cast("timestamp"))


def incident_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.get("incidents", 0)
    return _reports(spark, sf_dir).select(
        "clip_id", "report_id", "source_filename", "processing_time_ms", "met_latency_target", "offline_mode",
        *_long(emergency_latency_target_ms="emergency_latency_target_ms", incidents=F.size("incidents"), timeline=F.size("timeline")),
        i["incident_type"].alias("incident_type"), i["confidence"].alias("confidence"), i["timestamp_seconds"].alias("timestamp_seconds"), i["recommended_action"].alias("recommended_action"),
    )


def incident_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = C.alerts(_reports(spark, sf_dir)).select("report_id", F.explode("critical_incidents").alias("i"))
    return out.select("report_id", F.col("i.incident_type").alias("incident_type"), F.col("i.confidence").alias("confidence"), F.col("i.recommended_action").alias("recommended_action"))


def incident_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence and action of the incidents that the rules and the class shares give."""
    rows = C.emit(C.classify(_with_shares(spark, sf_dir), fast_path=True), fast_path=True)
    return rows.select("clip_id", "incident_type", "evidence", "recommended_action")


def incident_summary_top2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The summary of the two most confident incidents of each group of ten clips, by clip among equals."""
    rows = C.emit(_classified(spark, sf_dir)).withColumn("camera", F.col("clip_id") % CAMERAS)
    lists = rows.groupBy("camera").agg(F.transform(F.array_sort(F.collect_list(F.struct("clip_id", C.incident().alias("i")))), lambda x: x["i"]).alias("incidents"))
    lists = table(spark, sf_dir, "events").select((F.col("user_id") % CAMERAS).alias("camera")).distinct().join(lists, "camera", "left")
    empty = F.array().cast(lists.schema["incidents"].dataType)
    return lists.withColumn("incidents", F.coalesce("incidents", empty)).select("camera", C.summary("incidents").alias("summary"))


def report_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = C.list_reports(_reports(spark, sf_dir))
    shown = F.slice(F.filter("incidents", lambda i: i["incident_type"] != "none"), 1, 4)
    return rows.select("report_id", "source_filename", F.size(shown).cast("long").alias("shown_incidents"), F.when(F.col("met_latency_target"), "Yes").otherwise("No").alias("target_met"))


def report_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each report's place in the listing (by id downwards) and in the history (newest first, then by id downwards)."""
    hours = F.col("clip_id") % 50
    made = F.timestamp_seconds(F.unix_timestamp(F.lit("2024-02-01 00:00:00").cast("timestamp")) + hours * 3600)
    rows = _reports(spark, sf_dir).withColumn("created_at", made)
    rows = C.listing_places(C.listing_places(rows, "listed"), "shown", recent_first=True)
    return rows.select("report_id", "clip_id", "listed", "shown")


def report_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report of clip 7, by its id, from stored reports of which one partition is read."""
    folder = live.shared_folder(spark)
    sinks.write_report_store(_reports(spark, sf_dir), folder)
    key = spark.range(1).select(text.stable_id(F.lit(7).cast("long"), F.lit("clip_7.mp4"))).first()[0]
    return readers.read_report(spark, folder, key).select("report_id", "clip_id", "source_filename", "summary")


def reports_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports written as JSON by day and read back."""
    folder = live.shared_folder(spark)
    sinks.write_reports(_reports(spark, sf_dir), folder)
    i = F.get("incidents", 0)
    return readers.read_reports(spark, folder, lines=True).select(
        "report_id", "source_filename", "processing_time_ms", "met_latency_target", "summary", _time("created_at").alias("created_at"), i["incident_type"].alias("incident_type"), i["confidence"].alias("confidence"), F.get("timeline", 0)["note"].alias("note")
    )


def alerts_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alerts written as JSON and read back."""
    folder = live.shared_folder(spark)
    sinks.write_alerts(_reports(spark, sf_dir), folder)
    out = spark.read.schema(schemas.ALERT).json(folder).select("report_id", "summary", F.explode("critical_incidents").alias("i"))
    return out.select("report_id", "summary", F.col("i.incident_type").alias("incident_type"), F.col("i.confidence").alias("confidence"))


def landed_uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as uploads under their landed names, written and read back."""
    folder = live.shared_folder(spark)
    clips = table(spark, sf_dir, "pages").select("page_id", F.regexp_replace("url", r"[?#].*$", "").alias("path"), F.length("html").cast("long").alias("length"), F.lit("2024-02-03 04:05:06").cast("timestamp").alias("modificationTime"))
    sinks.land_uploads(clips, folder)
    return spark.read.parquet(folder).select("page_id", "landed_name")


# ---- frames


def frame_motion(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = frames.motion_frames(_frames(spark, sf_dir), ORDER)
    return rows.select("clip_id", *_long(frame_idx="frame_idx"), signals.scaled("motion", 1000).alias("motion_thousandths"), signals.scaled("area_change", 100).alias("area_change_hundredths"))


def horizontal_posture(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = frames.motion_frames(_frames(spark, sf_dir), ORDER)
    return rows.select("clip_id", *_long(frame_idx="frame_idx"), signals.scaled("horizontal", 1_000_000).alias("posture_millionths"), signals.scaled(signals.clamp(F.col("aspect_ratio")), 10_000).alias("clamped_ratio"))


def stride_sampled_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = frames.stride_sample(_frames(spark, sf_dir), 10)
    return kept.groupBy("clip_id").agg(F.count("*").alias("samples"), F.max("frame_idx").cast("long").alias("last_frame"))


def sampled_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.sampled_signals(_frames(spark, sf_dir), 20)


def signal_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields read back from the nested record of a clip's signals."""
    rows = _clips(spark, sf_dir)
    out = rows.select("clip_id", frames.signal_bundle(rows).alias("s"))
    return out.select("clip_id", F.col("s.video.motion_mean").alias("motion_mean"), F.col("s.audio.distress_score").alias("distress_score"), F.col("s.latency.met_target").alias("met_target"), F.col("s.fast_path.available").alias("fast_available"), *_long(frames="s.latency.frame_count_processed", target_ms="s.latency.target_ms"))


def motion_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clips longer than the cap on series."""
    rows = frames.motion_frames(_camera_frames(spark, sf_dir), ORDER)
    out = frames.series(rows, "motion", "series")
    shown = F.array_join(F.transform("series", lambda x: signals.scaled(x, 1000).cast("string")), ",")
    return out.select("clip_id", F.size("series").cast("long").alias("n"), shown.alias("series"))


def pixel_motion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as the pixels of a label's frames, in thousandths."""
    rows = _vectors(spark, sf_dir).select(F.col("label").alias("clip_id"), "vec_id", F.transform("v", lambda x: F.round(x * 1000).cast("double")).alias("gray"))
    out = frames.pixel_motion(frames.index_frames(rows, ["vec_id"]))
    return out.select("vec_id", F.round(F.col("motion") * 64).cast("long").alias("moved"))


def adaptive_controller(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.adaptive_controller(_frames(spark, sf_dir), skip_frames=False)


def adaptive_controller_skipping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clips longer than the cap on frames."""
    return frames.adaptive_controller(_camera_frames(spark, sf_dir), skip_frames=True)


# ---- windows


def sliding_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = windows.sliding_windows(_frames(spark, sf_dir))
    return rows.groupBy("clip_id", F.col("start").cast("long").alias("start")).agg(F.count("*").alias("frames"), F.min("event_id").alias("first_event"), F.max("event_id").alias("last_event"))


def window_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.window_counts(_frames(spark, sf_dir))


def window_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signals of 32-frame windows; the span of a frame is its value and its box the frame's area."""
    rows = frames.motion_frames(_frames(spark, sf_dir), ORDER)
    rows = rows.select("clip_id", "frame_idx", "motion", (F.col("value") / 100).alias("audio"), F.col("value").alias("span"), F.col("area").alias("box_area"))
    out = windows.window_signals(windows.sliding_windows(rows))
    return out.withColumn("start", F.col("start").cast("long"))


def window_incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The heuristic rule on windows; a window's motion starts from the clip's frame before."""
    rows = windows.sliding_windows(frames.motion_frames(_frames(spark, sf_dir), ORDER))
    out = rows.groupBy("clip_id", F.col("start").cast("long").alias("start")).agg(
        signals.exact_mean("motion").alias("motion_mean"), signals.exact_std("motion").alias("motion_std"), signals.exact_mean("horizontal", 1_000_000).alias("horizontal_posture_score")
    )
    out = C.classify(out.withColumn("distress_score", frames.distress("motion_std")))
    return out.select("clip_id", "start", "incident_type", "confidence")


def head_window_pad(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = windows.head_windows(_frames(spark, sf_dir), {"value": "head"}, config.Settings(window=64))
    total = F.aggregate("head", F.lit(0).cast("long"), lambda s, x: s + signals.scaled(x, 100))
    zeros = F.size(F.filter("head", lambda x: x == 0)).cast("long")
    return out.select("clip_id", F.size("head").cast("long").alias("n"), zeros.alias("zeros"), total.alias("total_hundredths"))


def runtime_tensor(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = frames.motion_frames(_frames(spark, sf_dir), ORDER)
    heads = windows.head_windows(rows, {"horizontal": "p", "motion": "m", "value": "a"})
    out = heads.select("clip_id", windows.runtime_tensor(F.col("p"), F.col("m"), F.col("a")).alias("t"))
    column = lambda k: F.aggregate("t", F.lit(0).cast("long"), lambda s, r: s + signals.scaled(F.get(r, k), 1000))
    return out.select("clip_id", F.size("t").cast("long").alias("rows"), F.size(F.get("t", 0)).cast("long").alias("width"), column(51).alias("motion_sum"), column(52).alias("audio_sum"), column(1).alias("other_sum"))


def longest_track(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's day with the most events, the first of equals."""
    rows = table(spark, sf_dir, "events").groupBy("user_id", F.to_date("ts").cast("string").alias("day")).agg(F.count("*").alias("n"))
    return windows.longest_track(rows, "user_id", "n", "day").select("user_id", "day", "n")


def frame_key_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The keys of a clip's frames, as text and as numbers: how many, and a digest of each order."""
    keys = _frames(spark, sf_dir).groupBy("clip_id").agg(F.collect_list(F.col("frame_idx").cast("string")).alias("k"))
    line = lambda numeric: F.md5(F.array_join(windows.order_frame_keys("k", numeric), ","))
    return keys.select("clip_id", F.size("k").cast("long").alias("n"), line(False).alias("as_text"), line(True).alias("as_numbers"))


def window_store_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of three values a frame and their vocabulary, written and read back with the labels' names."""
    folder = live.shared_folder(spark)
    rows = frames.motion_frames(_frames(spark, sf_dir), ORDER)
    cut = windows.sliding_windows(rows.select(F.col("clip_id").cast("string").alias("clip_id"), "frame_idx", F.array(F.col("motion"), F.col("value"), F.col("area")).cast("array<float>").alias("features")))
    tensors = windows.tensor_windows(cut).withColumn("label_id", (F.col("clip_id").cast("long") % 5).cast("int"))
    vocabulary = label_vocabulary(spark, sf_dir).select(F.col("event_type").alias("label"), "label_id")
    sinks.write_windows(tensors, vocabulary, folder)
    back, names = readers.read_windows(spark, folder)
    value = lambda k: F.aggregate("window", F.lit(0).cast("long"), lambda s, x: s + signals.scaled(F.get(x, k).cast("double"), 10)).alias(f"sum_{k}")
    out = back.select("clip_id", F.col("start").cast("long").alias("start"), F.col("label_id").cast("long").alias("label_id"), F.size("window").cast("long").alias("frames"), value(1))
    return out.join(names, "label_id")


# ---- labels


def label_csv_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last label of each user, written as a label map and read back."""
    folder = live.shared_folder(spark)
    rows = label_map_last_wins(spark, sf_dir).select(F.concat(F.lit(" u"), F.col("user_id").cast("string"), F.lit(" ")).alias("filename"), F.concat("event_type", F.lit(" ")).alias("label"))
    rows.write.option("header", "true").option("ignoreLeadingWhiteSpace", "false").option("ignoreTrailingWhiteSpace", "false").csv(folder)
    return readers.read_label_map(spark, folder)


def annotations_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as annotation records of one frame, written as JSON lines and read back, in sums by label."""
    folder = live.shared_folder(spark)
    frame = F.struct(vectors.reshape_keypoints("v").alias("keypoints"), F.get("v", 51).alias("motion"), F.get("v", 52).alias("audio_distress"))
    sinks.write_annotations(_vectors(spark, sf_dir).select(F.concat(F.lit("c"), F.col("label").cast("string")).alias("label"), F.array(frame).alias("frames")), folder)
    one = F.get("frames", 0)
    joints = F.aggregate(one["keypoints"], F.lit(0).cast("long"), lambda s, j: s + signals.scaled(F.get(j, 0), 1000))
    rows = readers.read_annotations(spark, folder).select("label", signals.scaled(one["motion"], 1000).alias("m"), joints.alias("x"))
    return rows.groupBy("label").agg(F.count("*").alias("n"), F.sum("m").alias("motion_thousandths"), F.sum("x").alias("x_thousandths"))


#: Vectors that make the frames of one pose file.
POSES = 40


def pose_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as pose files of forty frames, written as JSON with a label map, read back, joined, kept as annotations and read again; in sums by label."""
    folder = live.shared_folder(spark)
    rows = _vectors(spark, sf_dir).withColumn("clip", F.floor(F.col("vec_id") / POSES))
    frame = F.struct((F.col("vec_id") % POSES).cast("string").alias("key"), F.slice("v", 1, 51).alias("keypoints"))
    tracks = rows.groupBy("clip").agg(F.map_from_entries(F.collect_list(F.struct(frame["key"].alias("key"), F.struct(frame["keypoints"].alias("keypoints")).alias("frame")))).alias("frames"))
    name = F.concat(F.lit("c"), F.col("clip").cast("string"), F.lit(readers.POSE_GLOB[1:]))
    sinks.write_texts(tracks.select(name.alias("name"), F.to_json(F.create_map(F.lit("p1"), F.col("frames"))).alias("text")), f"{folder}/poses")
    named = rows.select("clip").distinct().where("clip % 7 != 0").select(name.alias("filename"), F.concat(F.lit("l"), (F.col("clip") % 5).cast("string")).alias("label"))
    named.write.option("header", "true").csv(f"{folder}/labels")
    poses = frames.track_motion(readers.annotation_frames(readers.read_pose_files(spark, f"{folder}/poses")))
    sinks.write_annotations(sinks.annotation_records(poses, readers.read_label_map(spark, f"{folder}/labels")), f"{folder}/kept")
    kept = readers.read_annotations(spark, f"{folder}/kept").select("label", F.explode("frames").alias("f"))
    return kept.groupBy("label").agg(F.count("*").alias("frames"), F.sum(signals.scaled("f.motion", 1000)).alias("motion_thousandths"))


def label_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.trim("lang").alias("lang"), "n_chars")
    return curate.label_join(docs, table(spark, sf_dir, "labels"), "doc_id").select("doc_id", "lang", "n_chars", *_long(quality="quality", toxic="toxic"))


def unlabeled_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curate.without_label(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id").select("doc_id", "lang")


def label_map_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curate.last_wins(table(spark, sf_dir, "events").select("user_id", "event_id", "event_type"), "user_id", "event_id")


def label_template_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", F.coalesce(F.when(F.col("event_type") != "view", _class_of(F.col("event_type"))), F.lit("unknown")).alias("label"))
    return rows.select("event_id", "label", curate.label_templates("label", "evidence").alias("evidence"), curate.label_templates("label", "action").alias("action"), curate.target_confidence("label").alias("confidence"), C.default_action("label").alias("default_action"))


def label_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.first_appearance(table(spark, sf_dir, "events"), "event_type", ["ts", "event_id"]).select("event_type", "label_id")


def class_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = curate.class_counts(table(spark, sf_dir, "events"), "event_type")
    return out.select("event_type", "n", F.max("n").over(Window.partitionBy(F.lit(0))).alias("most"))


def class_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights of the vocabulary, of which one label never occurs."""
    rows = table(spark, sf_dir, "events")
    vocabulary = rows.select("event_type").distinct().unionByName(spark.sql("SELECT 'never' AS event_type"))
    return curate.class_weights(rows, vocabulary, "event_type")


def event_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curate.distribution(table(spark, sf_dir, "events"), "event_type")


def dashboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.col("ts").alias("created_at"), (F.col("value") > 100).alias("alert"))
    return curate.dashboard(rows, F.lit("2024-01-15").cast("date"))


def reasoning_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), "event_type")
    reasons = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "lang", F.concat(F.round(F.lit(0.125) * 100).cast("long").cast("string"), F.lit("%")).alias("confidence"))
    return curate.reasoning_join(events, reasons, "id")


# ---- training text


def _labelled_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = window_signals(spark, sf_dir)
    label = F.element_at(F.array(*(F.lit(c) for c in sorted(CLASS_OF.values()))), (F.col("clip_id") % 5 + 1).cast("int"))
    return out.withColumn("sample_id", F.col("clip_id") * 1000 + F.col("start")).withColumn("label", label)


def sft_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Real window rows and synthetic rows of two labels; signals in thousandths."""
    real = _labelled_windows(spark, sf_dir)
    made = [curate.synthetic_rows(spark.range(first, first + n), label) for label, first, n in (("none", 10_000_000, 400), ("shoplifting", 20_000_000, 300))]
    columns = ["sample_id", "label", *curate.SYNTHETIC["none"]]
    rows = real.select(columns)
    for m in made:
        rows = rows.unionByName(m.select(columns))
    return rows.select("sample_id", "label", *(signals.scaled(c, 1000).alias(c) for c in columns[2:]))


def sft_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompt and response of each window."""
    rows = curate.sft_rows(_labelled_windows(spark, sf_dir))
    return rows.select("sample_id", "label", F.md5("prompt").alias("prompt_md5"), "response")


def sft_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts and responses written as JSON lines and read back."""
    folder = live.shared_folder(spark)
    sinks.write_sft(curate.sft_rows(_labelled_windows(spark, sf_dir)), folder)
    return readers.read_sft(spark, folder).groupBy("response").agg(F.count("*").alias("n"), F.countDistinct("prompt").alias("prompts"))


def sft_balanced(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", "event_type")
    out = curate.balance(rows, "event_type", "event_id")
    return out.select("event_type", "event_id", *_long(copy="copy"))


def train_val_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").cast("long").alias("label"))
    return curate.train_validation(rows, "vec_id")


def chat_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = chat.to_messages(F.col("lang"), F.col("source"), F.when(F.col("doc_id") % 2 == 0, F.lit("Own system.")))
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(m).alias("pos", "m"))
    return rows.select("doc_id", *_long(pos="pos"), F.col("m.role").alias("role"), F.col("m.content").alias("content"))


def _conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    turn = F.struct("turn", F.struct("role", F.col("text").alias("content")).alias("m"))
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(turn)), lambda t: t["m"]).alias("messages"))


def chat_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _conversations(spark, sf_dir).select("conv_id", chat.render_template("messages").alias("rendered"))


def chat_render_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _conversations(spark, sf_dir).select("conv_id", chat.render_plain("messages").alias("rendered"))


def token_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", chat.whitespace_tokens("text").alias("t"))
    return rows.select("doc_id", F.size("t").cast("long").alias("tokens"), F.md5(F.array_join("t", " ")).alias("digest"))


def _summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clips with class shares, at the default rate of frames."""
    fps = F.lit(config.DEFAULTS.default_fps)
    return _with_shares(spark, sf_dir).withColumns({"fps": fps, "duration_seconds": signals.safe_divide(F.col("sample_count"), fps)})


def multimodal_summary_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = online.summary_text()
    return _summary(spark, sf_dir).select("clip_id", lines.alias("summary"), F.md5(text.prompt(lines, "local")).alias("local_md5"), F.md5(text.prompt(lines, "hosted")).alias("hosted_md5"))


def multimodal_summary_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The summary with a line of class probabilities; those of classes that occur, by name."""
    names = ("fps", "duration_seconds", "motion_mean", "motion_std", "brightness_mean", "horizontal_posture_score", "area_change_mean", "distress_score")
    some = F.map_from_entries(F.array_sort(F.map_entries(F.map_filter("event_probs", lambda _, v: v > 0))))
    return _summary(spark, sf_dir).select("clip_id", text.summary_lines(*names, some).alias("summary"))


# ---- replies, uploads, vectors


# Replies that a model may give.
FENCE = "```"
REPLIES = (
    (1, '[{"incident_type": "shoplifting", "confidence": 0.9, "timestamp_seconds": 2, "evidence": "a", "recommended_action": "b"}]'),
    (2, '{"incident_type": "intrusion", "confidence": "0.5"}'),
    (3, f'{FENCE}\n[{{"incident_type": "violent_activity", "confidence": 0.7}}]\n{FENCE}'),
    (4, f'{FENCE}json\n{{"incident_type": "suspicious_activity"}}{FENCE}'),
    (5, '[1, {"incident_type": "odd", "confidence": 0.1}, "x", null, [2]]'),
    (6, '[{"incident_type": "shoplifting", "confidence": 1.5}]'),
    (7, "not json"),
    (8, ""),
    (9, "17"),
    (10, '[{"incident_type": "fainting", "confidence": 0.9}, {"incident_type": "none"}]'),
)


def _replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One of the ten replies for each event, by its number."""
    reply = F.element_at(F.array(*(F.lit(text) for _, text in REPLIES)), (F.col("event_id") % len(REPLIES)).cast("int") + 1)
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("reply_id"), reply.alias("reply"))


def _parsed(rows: DataFrame) -> DataFrame:
    return rows.select("reply_id", *_long(pos="pos"), "incident_type", "confidence", "timestamp_seconds", "evidence", "recommended_action")


def llm_reply_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parsed(parse_replies(_replies(spark, sf_dir), "reply_id", "reply"))


def llm_reply_parse_local(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parsed(parse_replies(_replies(spark, sf_dir), "reply_id", "reply", strip=False, default_evidence=LOCAL_EVIDENCE))


def llm_reply_parse_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reply for each event, in ten shapes by its number."""
    one = lambda c: F.concat(F.lit('{"incident_type": "'), _class_of(F.col("event_type")), F.lit('", "confidence": '), c, F.lit(', "timestamp_seconds": '), F.col("event_id").cast("string"), F.lit("}"))
    share = F.concat(F.lit("0."), F.lpad((F.col("event_id") % 100).cast("string"), 2, "0"))
    plain, k = one(share), F.col("event_id") % 10
    reply = (
        F.when(k == 0, plain)
        .when(k == 1, F.concat(F.lit("["), plain, F.lit("]")))
        .when(k == 2, F.concat(F.lit(f"{FENCE}json\n["), plain, F.lit(f"]\n{FENCE}")))
        .when(k == 3, F.concat(F.lit(f" {FENCE}"), plain, F.lit(FENCE)))
        .when(k == 4, F.concat(F.lit("[7, "), plain, F.lit(", null, "), plain, F.lit("]")))
        .when(k == 5, one(F.concat(F.lit('"'), share, F.lit('"'))))
        .when(k == 6, F.concat(F.lit("["), plain, F.lit(", "), one(F.lit("1.5")), F.lit("]")))
        .when(k == 7, F.concat(plain, F.lit(" and more")))
        .when(k == 8, F.lit('{"confidence": 0.5, "evidence": "e"}'))
        .otherwise(F.lit('[{"incident_type": "choking"}, {"incident_type": "none", "recommended_action": "a"}]'))
    )
    return _parsed(parse_replies(table(spark, sf_dir, "events").select(F.col("event_id").alias("reply_id"), reply.alias("reply")), "reply_id", "reply"))


def upload_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as uploads: the URL's path is the name, its HTML the body; every fifth page has a video's suffix."""
    path = F.regexp_replace("url", r"[?#].*$", "")
    name = F.concat(path, F.when(F.col("page_id") % 5 == 0, ".MP4").when(F.col("page_id") % 5 == 1, ".avi").otherwise(""))
    length = F.when(F.col("page_id") % 10 == 1, F.lit(0)).otherwise(F.length("html"))
    return table(spark, sf_dir, "pages").select("page_id", text.suffix(name).alias("suffix"), readers.upload_error(name, length).alias("reason"))


def suffix_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.regexp_replace("url", r"[?#].*$", "")
    return table(spark, sf_dir, "pages").select("page_id", text.suffix(path).alias("suffix"))


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").cast("long").alias("label"), F.transform("embedding", lambda x: x.cast("double")).alias("v"))


def embedding_reshape(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _vectors(spark, sf_dir).withColumn("k", vectors.reshape_keypoints("v")).withColumn("f", vectors.flatten_features("k", F.get("v", 51), F.get("v", 52)))
    return rows.select("vec_id", F.size("k").cast("long").alias("joints"), F.get(F.get("k", 16), 2).alias("last_score"), F.size("f").cast("long").alias("width"), F.element_at("f", -2).alias("motion"), F.element_at("f", -1).alias("audio"))


def keypoint_bbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _vectors(spark, sf_dir).select("vec_id", vectors.keypoint_box_area("v").alias("box_area"), vectors.vertical_span("v").alias("span"), vectors.span_posture(vectors.vertical_span("v")).alias("posture"))


def keypoint_motion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Motion between neighbouring vectors of one label, in thousandths."""
    rows = _vectors(spark, sf_dir).select(F.col("label").alias("clip_id"), "vec_id", vectors.reshape_keypoints("v").alias("keypoints"))
    out = frames.track_motion(frames.index_frames(rows, ["vec_id"]))
    return out.select("vec_id", *_long(frame_idx="frame_idx"), signals.scaled("motion", 1000).alias("motion_thousandths"))


# ---- event time, streams, model


def tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return live.tumbling(table(spark, sf_dir, "events"), "1 hour", "event_type").select(_time("start").alias("start"), "event_type", "n", "value_hundredths")


def sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return live.sliding(table(spark, sf_dir, "events"), "1 hour", "15 minutes").select(_time("start").alias("start"), "n", "value_hundredths")


def session(spark: SparkSession, sf_dir: str) -> DataFrame:
    return live.sessions(table(spark, sf_dir, "events"), SESSION_GAP, "user_id").select("user_id", _time("start").alias("start"), "n", "value_hundredths")


#: Stretches of time in which a stream's events land.
STRETCHES = 5


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


def stream_motion_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = live.replay(_events(spark, sf_dir), lambda rows: live.motion_state(rows.withColumnRenamed("user_id", "clip_id")), STRETCHES)
    return out.select("clip_id", "event_id", *_long(frame_idx="frame_idx", downscale_hundredths="downscale_hundredths", skip_stride="skip_stride"), signals.scaled("motion", 1000).alias("motion_thousandths"))


def stream_watermark_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly counts of closed hours; the last hour stays open under the watermark."""
    out = live.replay(_events(spark, sf_dir), lambda rows: live.tumbling(live.late_dropped(rows, "10 minutes"), "1 hour", "event_type"), STRETCHES)
    return out.select(_time("start").alias("start"), "event_type", "n", "value_hundredths")


def stream_static_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("user_id"), F.col("quality").cast("long").alias("quality"))
    out = live.replay(_events(spark, sf_dir), lambda rows: live.with_labels(rows.select("event_id", "user_id"), labels, "user_id"), STRETCHES)
    return out.select("event_id", "user_id", "quality")


def stream_once_each(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stretch brings the last two hours of the one before again."""
    return live.replay(_events(spark, sf_dir), lambda rows: live.once_each(rows, "event_id", "3 hours").select("event_id", "user_id"), STRETCHES, again="2 hours")


def stream_meter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a listener measured of each batch as the stream passed, in sums over the batches."""
    path = live.shared_folder(spark)
    with live.metering(spark, path):
        live.replay(_events(spark, sf_dir), lambda rows: live.metered(rows, "value").select("event_id"), STRETCHES)
    rows = live.read_meter(spark, path)
    return rows.agg(F.count("*").alias("batches"), F.sum("frames").alias("frames"), F.sum("violations").alias("violations"), signals.scaled(F.max("max_ms"), 100).alias("max_hundredths"), F.bool_and(F.col("p95_ms") <= F.col("max_ms")).alias("in_order"))


def _gray(rows: DataFrame) -> DataFrame:
    """Frames of 4 x 4 pixels as gray as their value."""
    level = F.pmod(F.floor("value"), F.lit(256)).cast("int")
    return rows.select("clip_id", "frame_idx", F.unhex(F.repeat(F.lpad(F.hex(level), 2, "0"), 16)).alias("pixels"))


def avi_frame_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clips of gray frames, one for each event, written as AVI files and read back by ranges of their bytes."""
    folder = live.shared_folder(spark)
    sinks.write_clips(_gray(_frames(spark, sf_dir).withColumn("clip_id", F.col("clip_id").cast("string"))), folder, 4, 4)
    rows = avi.read_avi(spark, folder, partitionBytes=avi.PARTITION_BYTES)
    clip = F.regexp_extract("clip_id", r"([^/]+)\.avi$", 1).cast("long")
    return rows.select(clip.alias("clip_id"), *_long(frame_idx="frame_idx", total_frames="total_frames"), signals.scaled("brightness", 1000).alias("brightness_thousandths"), signals.scaled("motion", 1000).alias("motion_thousandths"))


def live_uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What becomes of each upload of a landing folder that is read in five batches: of users' clips as AVI files, one in ten
    is a text file and one in ten isn't a clip."""
    folder = live.shared_folder(spark)
    rows = _frames(spark, sf_dir).withColumn("clip_id", F.col("clip_id").cast("string"))
    kind = F.col("clip_id").cast("long") % 10
    sinks.write_clips(_gray(rows.where(~kind.isin(3, 4))), f"{folder}/in", 4, 4)
    names = rows.where(kind.isin(3, 4)).select("clip_id").distinct()
    sinks.write_texts(names.select(F.concat("clip_id", F.when(kind == 3, ".txt").otherwise(".avi")).alias("name"), F.lit("no clip").alias("text")), f"{folder}/in")
    found = online.LiveSinks.below(f"{folder}/out")
    batch = rows.select("clip_id").distinct().count() // STRETCHES + 1
    with readers.many_files(spark):
        online.run_live(spark, f"{folder}/in", found, avi.AviDecoder(), f"{folder}/state", config.Settings(latency_target_ms=10_000_000), files=batch).awaitTermination()
    base = lambda c: F.regexp_extract(c, r"([0-9]+)\.[a-z]+$", 1).cast("long").alias("clip_id")
    reports = spark.read.schema("source_filename string").json(found.reports).select(base("source_filename"), F.lit("report").alias("outcome"))
    late = spark.read.schema("clip_id string").json(found.late).select(base("clip_id"), F.lit("late").alias("outcome"))
    rejected = spark.read.schema("path string, reason string").json(found.rejected).select(base("path"), F.col("reason").alias("outcome"))
    return reports.unionByName(late).unionByName(rejected)


def pose_event_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Right answers of a model on the validation part; features are the vectors, classes the ten labels."""
    rows = curate.train_validation(_vectors(spark, sf_dir), "vec_id")
    model = ml.train_classifier(rows.where("split = 'train'"), "v", "label")
    out = ml.predict(model, rows.where("split = 'validation'"), "v")
    return out.select("vec_id", "label", "top_event", "top_confidence")


def pose_event_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the model learns which of a vector's first two values is the larger: validation vectors judged, and 85 in 100 right."""
    rows = _vectors(spark, sf_dir).withColumn("side", F.when(F.get("v", 0) > F.get("v", 1), "first").otherwise("second"))
    rows = curate.train_validation(rows, "vec_id")
    model = ml.train_classifier(rows.where("split = 'train'"), "v", "side")
    found = ml.accuracy(ml.predict(model, rows.where("split = 'validation'"), "v"), "side")
    return found.select("n", (F.col("right") >= 0.85 * F.col("n")).alias("learned"))


def pose_event_network(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a network learns which windows move much, from their values and motion: validation windows judged, and 90 in 100 right."""
    rows = frames.motion_frames(_frames(spark, sf_dir), ORDER).select("clip_id", "frame_idx", "event_id", "motion", F.array(F.col("motion") / 10, F.col("value") / 100).cast("array<float>").alias("features"))
    cut = windows.sliding_windows(rows)
    level = cut.groupBy("clip_id", "start").agg(signals.exact_mean("motion").alias("m"))
    cut = windows.tensor_windows(cut).join(level, ["clip_id", "start"]).withColumn("label", F.when(F.col("m") > 10, "much").otherwise("little"))
    cut = cut.withColumn("sample_id", F.col("clip_id") * 1000 + F.col("start"))
    split = curate.train_validation(cut, "sample_id")
    net = network.train_network(split, "window", "label", weighted=True)
    out = network.predict_network(net, split.where("split = 'validation'"), "window")
    return out.agg(F.count("*").alias("n"), (F.avg((F.col("top_event") == F.col("label")).cast("double")) >= 0.9).alias("learned"))


def incident_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Beyond the basic set: counts by camera and type with subtotals."""
    rows = clip_incidents(spark, sf_dir).withColumn("camera", F.col("clip_id") % 10)
    return rows.rollup("camera", "incident_type").agg(F.count("*").alias("n"), F.count_if("emitted").alias("emitted"))


def segment_revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A star join at bench scale: open orders' revenue by market segment and nation, in hundredths."""
    lines = table(spark, sf_dir, "lineitem").where("l_shipdate > timestamp_ntz'1995-03-15 00:00:00'").select("l_orderkey", F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")) * 100).cast("long").alias("_r"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_nationkey")
    nations = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    joined = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(customers, F.col("o_custkey") == F.col("c_custkey")).join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.groupBy("c_mktsegment", "n_name").agg(F.count("*").alias("lines"), F.sum("_r").alias("revenue_hundredths"))


QUERIES = (
    clip_signals, camera_signals, clip_latency_summary, latency_gate, clip_incidents, clip_incidents_fastpath, incident_reports, incident_alerts, incident_evidence, incident_summary_top2, report_listing, report_order, report_point, reports_scan, alerts_scan, landed_uploads,
    frame_motion, horizontal_posture, avi_frame_scan, stride_sampled_frames, sampled_signals, signal_bundles, motion_series, pixel_motion, adaptive_controller, adaptive_controller_skipping,
    sliding_windows, window_counts, window_signals, window_incidents, head_window_pad, runtime_tensor, longest_track, frame_key_order, window_store_scan,
    label_csv_scan, annotations_scan, pose_annotations, label_join, unlabeled_docs, label_map_last_wins, label_template_join, label_vocabulary, class_counts, class_weights, event_distribution, dashboard, reasoning_join,
    sft_union, sft_rows, sft_scan, sft_balanced, train_val_split, chat_messages, chat_render, chat_render_plain, token_truncate, multimodal_summary_text, multimodal_summary_shares,
    llm_reply_parse, llm_reply_parse_local, llm_reply_parse_events, upload_validation, suffix_parse, embedding_reshape, keypoint_bbox, keypoint_motion,
    tumbling, sliding, session, stream_motion_state, stream_watermark_agg, stream_static_join, stream_once_each, stream_meter, live_uploads, pose_event_classifier, pose_event_accuracy, pose_event_network, incident_rollup, segment_revenue,
)
