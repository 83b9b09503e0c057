"""Explicit schemas of the engine's records; nothing is inferred on read."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _D, _I, _L, _B, _T = T.StringType(), T.DoubleType(), T.IntegerType(), T.LongType(), T.BooleanType(), T.TimestampType()
_DOUBLES = T.ArrayType(_D)


def record(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


CLIP = record(path=_S, modificationTime=_T, length=_L, content=T.BinaryType())
FRAME_SIGNALS = record(clip_id=_S, frame_idx=_I, brightness=_D, motion=_D, aspect_ratio=_D, area=_D, latency_ms=_D)
VIDEO = record(fps=_D, total_frames=_I, duration_seconds=_D, sample_count=_I, brightness_mean=_D, motion_mean=_D, motion_std=_D, motion_series=_DOUBLES)
POSE = record(pose_sample_count=_I, horizontal_posture_score=_D, area_change_mean=_D, horizontal_series=_DOUBLES)
AUDIO = record(distress_score=_D, audio_pipeline_status=_S)
LATENCY = record(
    target_ms=_I, frame_count_processed=_I, p50_ms=_D, p95_ms=_D, max_ms=_D, violations=_I,
    met_target=_B, downscale_final=_D, skip_stride_final=_I, total_analysis_ms=_D,
)
FAST_PATH = record(available=_B, event_probs=T.MapType(_S, _D), top_event=_S, top_confidence=_D)
SIGNALS = record(video=VIDEO, pose=POSE, audio=AUDIO, latency=LATENCY, fast_path=FAST_PATH)
INCIDENT = record(incident_type=_S, confidence=_D, timestamp_seconds=_D, evidence=_S, recommended_action=_S)
TIMELINE = record(t=_D, type=_S, confidence=_D, note=_S)
REPORT = record(
    report_id=_S, source_filename=_S, created_at=_T, processing_time_ms=_D, emergency_latency_target_ms=_I,
    met_latency_target=_B, offline_mode=_B, video_never_leaves_device=_B, summary=_S,
    incidents=T.ArrayType(INCIDENT), timeline=T.ArrayType(TIMELINE), raw_signals=SIGNALS,
)
ALERT = record(report_id=_S, summary=_S, critical_incidents=T.ArrayType(INCIDENT))
POSE_FILE = T.MapType(_S, T.MapType(_S, record(keypoints=_DOUBLES)))
LABEL_MAP = record(filename=_S, label=_S)
ANNOTATION = record(label=_S, frames=T.ArrayType(record(keypoints=T.ArrayType(_DOUBLES), motion=_D, audio_distress=_D)))
WINDOW = record(clip_id=_S, start=_I, label_id=_I, window=T.ArrayType(T.ArrayType(T.FloatType())))
SFT = record(prompt=_S, response=_S)
SFT_INPUT = record(prompt=_S, response=_S, system=_S, messages=T.ArrayType(record(role=_S, content=_S)))
EVENT = record(event_id=_L, ts=T.TimestampNTZType(), user_id=_L, event_type=_S, value=_D, props=_S)

JOINTS, FEATURES = 17, 53
