import pytest
from pyspark.sql import functions as F

from tidemark import config
from tidemark.operators import classify as C
from tidemark.operators import enrich


def clip(**values):
    base = {"clip_id": 1, "motion_mean": 0.0, "motion_std": 0.0, "distress_score": 0.0, "horizontal_posture_score": 0.0, "area_change_mean": 0.0}
    return base | values


def verdict(spark, fast=None, **values):
    df = spark.createDataFrame([clip(**values)])
    if fast is not None:
        probs = F.create_map(*(F.lit(x) for kv in fast.items() for x in kv)) if fast else F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<double>"))
        df = df.withColumns({"event_probs": probs, "fast_available": F.lit(True)})
    r = C.classify(df, fast_path=fast is not None).first()
    return r.incident_type, round(r.confidence, 6)


@pytest.mark.parametrize(
    ("values", "want"),
    [
        ({"motion_mean": 0.5}, ("none", 0)),
        ({"motion_mean": 0.6}, ("shoplifting", 0.54)),
        ({"motion_mean": 9.0}, ("shoplifting", 0.8)),
        ({"motion_mean": 3.0, "distress_score": 0.3}, ("none", 0)),
        ({"motion_mean": 3.0, "horizontal_posture_score": 0.85}, ("none", 0)),
        ({"motion_mean": 10.0, "motion_std": 9.0, "distress_score": 0.36}, ("none", 0)),
        ({"motion_mean": 11.0, "motion_std": 8.0, "distress_score": 0.32}, ("none", 0)),
        ({"motion_mean": 11.0, "motion_std": 10.0, "distress_score": 0.4}, ("violent_activity", 0.65)),
        ({"motion_mean": 11.0, "motion_std": 30.0, "distress_score": 1.0}, ("violent_activity", 0.9)),
    ],
)
def test_heuristic(spark, values, want):
    assert verdict(spark, **values) == want


@pytest.mark.parametrize(
    ("fast", "values", "want"),
    [
        ({"shoplifting": 0.5, "none": 0.5}, {"motion_mean": 11.0, "distress_score": 0.9}, ("none", 0)),
        ({"shoplifting": 0.6, "none": 0.4}, {"distress_score": 0.3, "horizontal_posture_score": 0.8}, ("shoplifting", 0.6)),
        ({"shoplifting": 0.51, "none": 0.49}, {"motion_mean": 0.6}, ("shoplifting", 0.95)),
        ({"suspicious_activity": 0.6, "none": 0.4}, {}, ("suspicious_activity", 0.85)),
        ({"suspicious_activity": 0.4, "none": 0.45, "intrusion": 0.15}, {}, ("none", 0)),
        ({"suspicious_activity": 0.9, "intrusion": 0.1}, {}, ("none", 0)),
        ({}, {"motion_mean": 0.6}, ("shoplifting", 0.54)),
    ],
)
def test_fast_path(spark, fast, values, want):
    assert verdict(spark, fast, **values) == want


def test_fast_path_needs_the_model(spark):
    df = spark.createDataFrame([clip()]).withColumns({"event_probs": F.create_map(F.lit("shoplifting"), F.lit(1.0)), "fast_available": F.lit(False)})
    assert C.classify(df, True).first().incident_type == "none"


def incidents(spark, *rows):
    return spark.createDataFrame([([{"incident_type": t, "confidence": c, "timestamp_seconds": s, "evidence": "e", "recommended_action": "a"} for t, c, s in rows],)], "incidents array<struct<incident_type:string,confidence:double,timestamp_seconds:double,evidence:string,recommended_action:string>>")


def test_lists(spark):
    df = incidents(spark, ("fainting", 0.9, 2.0), ("none", 0.8, 0.0), ("violent_activity", 0.6, 1.0), ("intrusion", 0.9, 1.0), ("shoplifting", 0.6, 3.0))
    r = df.select(C.strip_types("incidents").alias("s"), C.sanitize("incidents").alias("z"), C.top_incidents("incidents").alias("t"), C.summary("incidents").alias("m"), C.timeline("incidents").alias("l")).first()
    assert [i.incident_type for i in r.s] == ["none", "violent_activity", "intrusion", "shoplifting"]
    assert (r.z[0].incident_type, r.z[0].confidence, r.z[0].timestamp_seconds, r.z[0].evidence) == ("none", 0.8, 2.0, config.SANITIZED_EVIDENCE)
    assert [i.incident_type for i in r.t] == ["fainting", "intrusion"]
    assert r.m == "Detected potential incident(s): fainting (0.90), intrusion (0.90). Local alert workflow engaged."
    assert (r.l[2].t, r.l[2].type, r.l[2].note) == (1.0, "violent_activity", "e")
    empty = incidents(spark)
    r = empty.select(C.default_if_empty("incidents").alias("d"), C.summary("incidents").alias("m")).first()
    assert (r.d[0].incident_type, r.d[0].confidence, r.d[0].recommended_action) == ("none", 0.8, "Continue monitoring.") and r.m == config.QUIET_SUMMARY


def test_alerts(spark):
    rows = [("a", "shoplifting", 0.6), ("b", "shoplifting", 0.59), ("c", "suspicious_activity", 0.99), ("d", "intrusion", 0.99), ("e", "choking", 0.7)]
    reports = None
    for i, t, c in rows:
        one = incidents(spark, (t, c, 0.0)).select(F.lit(i).alias("report_id"), F.lit("s").alias("summary"), "incidents")
        reports = one if reports is None else reports.unionByName(one)
    assert sorted(r.report_id for r in C.alerts(reports).collect()) == ["a", "e"]


def test_reports_with_a_models_evidence(spark):
    clips = spark.createDataFrame([clip(motion_mean=3.0, source_filename="x.mp4", processing_time_ms=100.0), clip(clip_id=2, source_filename="y.mp4", processing_time_ms=101.0), clip(clip_id=3, motion_mean=4.0, source_filename="z.mp4", processing_time_ms=1.0)])
    gated = C.classify(clips).where("incident_type != 'none'").withColumn("summary_text", F.col("clip_id").cast("string"))

    def client(text):
        if "\n3\n" in text:
            raise TimeoutError
        return '{"incident_type": "shoplifting", "evidence": "bag", "recommended_action": ""}'

    replies = enrich.model_evidence(gated, "clip_id", "summary_text", client)
    found = C.emit(C.classify(clips), replies=replies)
    by = {r.clip_id: r for r in C.assemble_reports(clips, found).collect()}
    one = by[1].incidents[0]
    assert one.evidence.endswith(" LLM: bag") and one.recommended_action == config.DEFAULT_ACTIONS["shoplifting"] and one.timestamp_seconds == 1.5
    assert "LLM" not in by[3].incidents[0].evidence
    assert by[2].incidents[0].incident_type == "none" and not by[2].met_latency_target and by[1].met_latency_target
    assert len({r.report_id for r in by.values()}) == 3 and len(by[1].report_id) == 36
    again = {r.report_id for r in C.assemble_reports(clips, found).collect()}
    assert again == {r.report_id for r in by.values()}
    assert enrich.model_evidence(gated, "clip_id", "summary_text", enrich.client_of(config.DEFAULTS)) is None


def test_routes(spark):
    rules = spark.createDataFrame([(1, "r"), (2, "r")], "clip_id long, who string")
    hosted = spark.createDataFrame([(2, "h")], "clip_id long, who string")
    assert sorted(map(tuple, C.choose_route(hosted, rules, "clip_id", "hosted").collect())) == [(1, "r"), (2, "h")]
    assert sorted(map(tuple, C.choose_route(hosted, rules, "clip_id", "local").collect())) == [(1, "r"), (2, "r")]


def test_reports_are_stamped_when_they_are_made(spark):
    from tidemark.operators import classify as C

    before = spark.sql("SELECT current_timestamp() AS t").first().t
    rows = spark.createDataFrame([("c", "c.mp4", 1.0, True)], "clip_id string, source_filename string, processing_time_ms double, met_target boolean")
    clips = rows.withColumns({"incident_type": F.lit("none"), "confidence": F.lit(0.9)})
    made = clips.select(*[c for c in C._report_columns(config.DEFAULTS, None, None) if not isinstance(c, str) and "created_at" in str(c)]).first()[0]
    assert before <= made <= spark.sql("SELECT current_timestamp() AS t").first().t
