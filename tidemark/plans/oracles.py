"""DuckDB SQL for the queries, by name; queries without an entry can't be expressed in SQL."""

from __future__ import annotations

# Fixed values, stated here once more so that a wrong one in the engine is seen: classes of event types, actions, templates and texts.
CLASS_OF = {"click": "shoplifting", "purchase": "suspicious_activity", "view": "none", "error": "violent_activity", "signup": "intrusion"}
ACTIONS = {
    "shoplifting": "Track subject, notify nearby staff, and retain camera evidence.",
    "suspicious_activity": "Monitor in real-time and notify floor guard.",
    "violent_activity": "Trigger high-priority security escalation.",
    "intrusion": "Alert security team immediately.",
}
NO_ACTION = "Continue monitoring."
QUIET = "No critical event detected. Monitoring remains active."
NOTHING = "No severe event detected from current multimodal signals."
TEMPLATES = {
    "fainting": ("Person posture collapsed to near-horizontal; very low movement; possible medical emergency.", "Dispatch nearby responder immediately."),
    "choking": ("Breathing/distress pattern and abrupt upper-body instability observed.", "Issue emergency alert and request human confirmation."),
    "violent_activity": ("High-variance motion and conflict-like pose transitions detected.", "Trigger high-priority security escalation."),
    "shoplifting": ("Object interaction followed by concealment and exit-like movement pattern detected.", "Notify security team and retain timestamped evidence clip."),
    "suspicious_activity": ("Sustained movement anomaly detected around restricted area.", "Notify guard and keep tracking."),
    "intrusion": ("Unauthorized entry or perimeter breach detected.", "Notify security and verify identity."),
    "none": ("No severe event pattern found in this window; normal or ambiguous activity.", "Continue monitoring."),
}
SYSTEM = "You are a security incident reasoning model. Return strict JSON only."
TASK = "You are the primary security incident classifier. Use ONLY the multimodal summary below.\n\nRULES:\n"
ANSWER = '- Return ONLY a JSON array with exactly one object: {"incident_type", "confidence", "timestamp_seconds", "evidence", "recommended_action"}.\n'
SERVED = "Allowed incident_type: shoplifting, suspicious_activity, violent_activity, intrusion, none.\n\nMULTIMODAL SUMMARY:\n"
TRAINING = (
    f"{TASK}- Choose the SINGLE most likely incident type. Do NOT default to fainting.\n- Fainting = person collapsed (horizontal body, very low movement, medical emergency).\n"
    "- Shoplifting = concealment, item handling, retail context, person leaving without paying.\n- Use 'suspicious_activity' or 'none' for unclear or normal activity.\n"
    f"{ANSWER}Allowed incident_type: fainting, choking, violent_activity, shoplifting, suspicious_activity, intrusion, none.\n\nMULTIMODAL SUMMARY:\n"
)
CHOICE = "- Choose the SINGLE most likely incident type.\n- Focus on: shoplifting, suspicious_activity, violent_activity, or none.\n"
HOSTED = f"{TASK}{CHOICE}- Shoplifting = concealment, item handling, retail context, person leaving without paying.\n- Do NOT classify as fainting or choking.\n{ANSWER}{SERVED}"
LOCAL = f"{TASK}{CHOICE}- Shoplifting = concealment, item handling, retail context, person moving with items.\n- Do NOT classify as fainting or choking. Those are not valid.\n{ANSWER}{SERVED}"
TAIL = "\n\nJSON array:"

_CLASSES = sorted(CLASS_OF.values())


def _text(s: str) -> str:
    parts = [f"'{p}'" for p in s.replace("'", "''").split("\n")]
    return "(" + " || chr(10) || ".join(parts) + ")" if len(parts) > 1 else parts[0]


def _case(x: str, table: dict[str, str], other: str) -> str:
    return f"CASE {x} " + " ".join(f"WHEN {_text(k)} THEN {_text(v)}" for k, v in table.items()) + f" ELSE {other} END"


def _scaled(x: str, scale: int = 1000) -> str:
    return f"CAST(round(({x}) * {scale}) AS BIGINT)"


def _mean(x: str, scale: int = 1000) -> str:
    return f"(CAST(sum({_scaled(x, scale)}) AS DOUBLE) / CAST(count({x}) AS DOUBLE) / CAST({scale} AS DOUBLE))"


def _std(x: str, scale: int = 1000) -> str:
    s, n = _scaled(x, scale), f"CAST(count({x}) AS DOUBLE)"
    mean = f"(CAST(sum({s}) AS DOUBLE) / {n})"
    return f"(sqrt(greatest(CAST(0 AS DOUBLE), CAST(sum({s} * {s}) AS DOUBLE) / {n} - {mean} * {mean})) / CAST({scale} AS DOUBLE))"


def _id(*columns: str) -> str:
    h = f"sha256(concat_ws(chr(31), {', '.join(columns)}))"
    return f"(substr({h}, 1, 8) || '-' || substr({h}, 9, 4) || '-4' || substr({h}, 14, 3) || '-8' || substr({h}, 18, 3) || '-' || substr({h}, 21, 12))"


_RULE = """
  CASE WHEN motion_mean > 0.5 AND distress_score < 0.3 AND horizontal_posture_score < 0.85 THEN 'shoplifting'
       WHEN motion_mean > 10 AND motion_std > 8 THEN 'violent_activity' ELSE 'none' END AS incident_type,
  CASE WHEN motion_mean > 0.5 AND distress_score < 0.3 AND horizontal_posture_score < 0.85 THEN least(CAST(0.80 AS DOUBLE), CAST(0.50 AS DOUBLE) + motion_mean / 15)
       WHEN motion_mean > 10 AND motion_std > 8 THEN least(CAST(0.90 AS DOUBLE), CAST(0.4 AS DOUBLE) + motion_std / 40) ELSE CAST(0 AS DOUBLE) END AS confidence"""

def _frames(clip: str) -> str:
    return f"""
frames AS (
  SELECT {clip} AS clip_id, event_id, ts, event_type, value, row_number() OVER w - 1 AS frame_idx,
         value * CAST(0.2 AS DOUBLE) AS brightness, value / 50 AS aspect_ratio, value * CAST(json_extract_string(props, '$.k') AS DOUBLE) AS area
  FROM events WINDOW w AS (PARTITION BY {clip} ORDER BY ts, event_id)
), moved AS (
  SELECT *, coalesce(abs(brightness - lag(brightness) OVER v), CAST(0 AS DOUBLE)) AS motion,
         abs(area - lag(area, 1, CAST(0 AS DOUBLE)) OVER v) AS area_change,
         1 / (1 + exp(-(aspect_ratio - CAST(1.4 AS DOUBLE)) * 3)) AS horizontal
  FROM frames WINDOW v AS (PARTITION BY clip_id ORDER BY frame_idx)
)"""


FRAMES, CAMERAS = _frames("user_id"), _frames("user_id % 10")
_SUMS = f"""sums AS (
  SELECT clip_id, count(*) AS sample_count, {_mean('brightness')} AS brightness_mean, {_mean('motion')} AS motion_mean, {_std('motion')} AS motion_std,
         {_mean('horizontal', 1_000_000)} AS horizontal_posture_score, {_mean('area_change')} AS area_change_mean
  FROM moved WHERE frame_idx < 600 GROUP BY clip_id
), signals AS (
  SELECT *, greatest(CAST(0 AS DOUBLE), least(CAST(1 AS DOUBLE), motion_std / 25)) AS distress_score FROM sums
)"""
SIGNALS = f"{FRAMES}, {_SUMS}"
CLASSIFIED = f"""{SIGNALS}, ruled AS (SELECT *,{_RULE} FROM signals),
incidents AS (SELECT *, CASE WHEN incident_type = 'none' THEN 'none' ELSE 'heuristic' END AS rule, incident_type <> 'none' AND confidence >= 0.4 AS emitted FROM ruled)"""
LATENCY = """
latency AS (
  SELECT clip_id, count(*) AS frame_count_processed, round(quantile_cont(value, 0.5), 4) AS p50_ms, round(quantile_cont(value, 0.95), 4) AS p95_ms, max(value) AS max_ms,
         count(*) FILTER (value > 100) AS violations, bool_and(value <= 100) AS met_target
  FROM frames WHERE frame_idx < 600 GROUP BY clip_id
)"""
REPORTS = f"""{CLASSIFIED}, {LATENCY}, named AS (
  SELECT i.*, p95_ms AS processing_time_ms, 'clip_' || clip_id || '.mp4' AS source_filename, p95_ms <= 100 AS met FROM incidents i JOIN latency USING (clip_id)
), reports AS (
  SELECT *, {_id('clip_id', 'source_filename')} AS report_id, {_case('incident_type', ACTIONS, _text(NO_ACTION))} AS action,
         CASE WHEN emitted THEN 'Detected potential incident(s): ' || incident_type || ' (' || printf('%.2f', confidence) || '). Local alert workflow engaged.' ELSE {_text(QUIET)} END AS summary,
         CASE WHEN NOT emitted THEN {_text(NOTHING)}
              WHEN incident_type = 'shoplifting' THEN printf('Signal heuristic: person is upright (h=%.2f), moving (motion=%.1f), no distress (%.2f) — retail anomaly pattern.', horizontal_posture_score, motion_mean, distress_score)
              ELSE 'Abrupt high-variance motion pattern observed.' END AS evidence
  FROM named
)"""
WINDOWS = """
sized AS (SELECT *, count(*) OVER (PARTITION BY clip_id) AS n FROM moved),
windows AS (
  SELECT s.*, start, frame_idx - start AS pos FROM sized s, LATERAL (SELECT 8 * k AS start FROM generate_series(0, 200) g(k)) starts
  WHERE start <= frame_idx AND frame_idx < start + 32 AND start + 32 <= n
)"""
_GRAPHS = f"""{FRAMES}, {WINDOWS}, changed AS (
  SELECT *, abs(area - lag(area) OVER (PARTITION BY clip_id, start ORDER BY pos)) AS change, value / 100 AS audio FROM windows
), window_signals AS (
  SELECT clip_id, start, count(*) AS frames, {_mean('motion')} AS motion_mean, {_std('motion')} AS motion_std, {_mean('audio')} AS audio_distress,
         greatest(CAST(0 AS DOUBLE), least(CAST(1 AS DOUBLE), 1 - least(CAST(1 AS DOUBLE), {_mean('value', 1_000_000)} / 150))) AS horizontal_posture_score,
         coalesce({_mean('change')}, CAST(0 AS DOUBLE)) AS area_change_mean, count(*) / CAST(30 AS DOUBLE) AS duration_seconds
  FROM changed GROUP BY clip_id, start
)"""
_SHARES = ", ".join(f"count(*) FILTER (event_type = '{e}') / CAST(count(*) AS DOUBLE) AS {c}" for e, c in CLASS_OF.items())
_TOP = " ".join(f"WHEN {c} = greatest({', '.join(CLASS_OF.values())}) THEN '{c}'" for c in CLASS_OF.values())
_LABELLED = f"""{_GRAPHS}, labelled AS (
  SELECT *, clip_id * 1000 + start AS sample_id, CASE clip_id % 5 {' '.join(f"WHEN {k} THEN '{c}'" for k, c in enumerate(_CLASSES))} END AS label FROM window_signals
)"""
_COLUMNS = ("motion_mean", "motion_std", "horizontal_posture_score", "area_change_mean", "audio_distress")


_FAST = f"""{CLASSIFIED}, shares AS (SELECT clip_id, {_SHARES} FROM frames WHERE frame_idx < 600 GROUP BY clip_id), both_of AS (
  SELECT s.*, i.* EXCLUDE (clip_id), CASE WHEN shoplifting > CAST(1 AS DOUBLE) / 5 THEN 'shoplifting' WHEN suspicious_activity > CAST(1 AS DOUBLE) / 5 AND suspicious_activity > s."none" THEN 'suspicious_activity' END AS fast
  FROM shares s JOIN incidents i USING (clip_id)), fast_incidents AS (
  SELECT * EXCLUDE (incident_type, confidence, rule), coalesce(fast, incident_type) AS incident_type,
       CASE fast WHEN 'shoplifting' THEN least(CAST(0.95 AS DOUBLE), shoplifting + CASE WHEN distress_score < 0.3 THEN CAST(0.30 AS DOUBLE) ELSE 0 END + CASE WHEN horizontal_posture_score < 0.8 THEN CAST(0.10 AS DOUBLE) ELSE 0 END + CASE WHEN motion_mean > 0.5 THEN CAST(0.10 AS DOUBLE) ELSE 0 END)
                 WHEN 'suspicious_activity' THEN least(CAST(0.85 AS DOUBLE), suspicious_activity + CAST(0.25 AS DOUBLE)) ELSE confidence END AS confidence,
       CASE WHEN fast IS NOT NULL THEN 'fast' ELSE rule END AS rule, CASE {_TOP} END AS top_event, greatest({', '.join(CLASS_OF.values())}) AS top_confidence FROM both_of)"""


def _synthetic(label: str, first: int, n: int) -> str:
    ranges = {"none": ((5, 18), (1, 6), (0.05, 0.35), (0, 80), (0, 0.25)), "shoplifting": ((8, 22), (2, 7), (0.1, 0.45), (20, 120), (0, 0.35))}[label]
    value = lambda k, low, high: f"CAST({low} AS DOUBLE) + ((id * 7919 + {104729 * (k + 1) + 42}) % 10007) / CAST(10007 AS DOUBLE) * (CAST({high} AS DOUBLE) - CAST({low} AS DOUBLE))"
    columns = ", ".join(f"{_scaled(value(k, *r))} AS {c}" for k, (c, r) in enumerate(zip(_COLUMNS, ranges, strict=True)))
    return f"SELECT id AS sample_id, '{label}' AS label, {columns} FROM range({first}, {first + n}) t(id)"


def _template(label: str, k: int) -> str:
    return _case(label, {name: texts[k] for name, texts in TEMPLATES.items()}, _text(TEMPLATES["none"][k]))


def _confidence(label: str) -> str:
    return f"CASE WHEN {label} IN ('none', 'suspicious_activity') THEN CAST(0.85 AS DOUBLE) ELSE CAST(0.92 AS DOUBLE) END"


_TIME = "strftime({}, '%Y-%m-%d %H:%M:%S')"
_VALUE = "CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS value_hundredths"
_PAGES = "uploads AS (SELECT page_id, regexp_replace(url, '[?#].*$', '', 's') AS path, html FROM pages)"
_SUFFIX = r"lower(regexp_extract({}, '(\.[^./\\]+)$', 1))"
_CHATS = "SELECT conv_id, {} AS rendered FROM conversations GROUP BY conv_id"
_AT = "list_transform(range(0, 17), lambda j: CAST(embedding[3 * j + {}] AS DOUBLE))"
_BLOCK = "'<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10)"
_SUMMARY = """
printf('Video: fps=%.1f, duration_sec=%.1f, motion_mean=%.2f, motion_std=%.2f, brightness_mean=%.1f.', CAST({fps} AS DOUBLE), {duration}, motion_mean, motion_std, {brightness}) || chr(10) ||
printf('Body pose (TensorFlow): horizontal_posture_score=%.2f (1=lying/collapsed), area_change_mean=%.0f.', horizontal_posture_score, area_change_mean) || chr(10) ||
printf('Audio: distress_score=%.2f (high=distress/coughing).', {distress})"""
_CLIP_SUMMARY = _SUMMARY.format(fps=30, duration="sample_count / CAST(30 AS DOUBLE)", brightness="brightness_mean", distress="distress_score")
_WINDOW_SUMMARY = _SUMMARY.format(fps=30, duration="duration_seconds", brightness="CAST(100 AS DOUBLE)", distress="audio_distress")
_SHOWN = " || ".join(f"""CASE WHEN {c} > 0 THEN ',' || chr(10) || '"{c}": ' || CAST({c} AS VARCHAR) ELSE '' END""" for c in _CLASSES)
_RESPONSE = """'[{"incident_type": "' || label || '", "confidence": ' || CASE WHEN label IN ('none', 'suspicious_activity') THEN '0.85' ELSE '0.92' END || ', "timestamp_seconds": 1.0, "evidence": "' || EVIDENCE || '", "recommended_action": "' || ACTION || '"}]'"""


def _incidents(rows: list[tuple]) -> str:
    values = ", ".join(f"({i}, {p}, '{t}', CAST({c} AS DOUBLE), CAST({s} AS DOUBLE), {_text(e)}, {_text(a)})" for i, p, t, c, s, e, a in rows)
    return f"""SELECT event_id AS reply_id, CAST(pos AS BIGINT) AS pos, incident_type, confidence, timestamp_seconds, evidence, recommended_action
FROM events JOIN (VALUES {values}) v(reply, pos, incident_type, confidence, timestamp_seconds, evidence, recommended_action) ON event_id % 10 + 1 = reply"""


def _reply_rows(evidence: str, stripped: bool) -> list[tuple]:
    """What the fixed replies hold, read by hand."""
    a = NO_ACTION
    rows = [
        (1, 0, "shoplifting", 0.9, 2, "a", "b"),
        (2, 0, "intrusion", 0.5, 0, evidence, a),
        (3, 0, "violent_activity", 0.7, 0, evidence, a),
        (4, 0, "suspicious_activity", 0, 0, evidence, a),
        (5, 1, "none", 0.1, 0, evidence, a),
        (10, 1, "none", 0, 0, evidence, a),
    ]
    return rows if stripped else [*rows, (10, 0, "fainting", 0.9, 0, evidence, a)]



def _mix(x: str, seed: int) -> str:
    """31 bits of a number and a seed, by products under 2 ** 63."""
    first = f"(({x} % 2147483648) * 1540483477 + ({x} // 2147483648) % 2147483648 + {seed * 40503}) % 4294967296"
    fold = lambda y, shift, m: f"list_transform([{y}], lambda y: (xor(y, y >> {shift}) % 2147483648 * {m}) % 4294967296 + y // 2147483648)[1]"
    return f"list_transform([{fold(fold(first, 16, 668265263), 15, 374761393)}], lambda y: xor(y, y >> 16) % 2147483648)[1]"


ORACLES: dict[str, str] = {
    "clip_signals": f"WITH {SIGNALS} SELECT * FROM signals",
    "camera_signals": f"WITH {CAMERAS}, {_SUMS} SELECT * FROM signals",
    "clip_latency_summary": f"WITH {FRAMES}, {LATENCY} SELECT * FROM latency",
    "latency_gate": f"WITH {FRAMES}, {LATENCY} SELECT clip_id, CASE WHEN met_target THEN 'pass' ELSE 'quarantine' END AS gate, max_ms, violations FROM latency",
    "clip_incidents": f"WITH {CLASSIFIED} SELECT clip_id, incident_type, confidence, rule, emitted FROM incidents",
    "clip_incidents_fastpath": f"WITH {_FAST} SELECT clip_id, incident_type, confidence, rule, top_event, top_confidence FROM fast_incidents",
    "incident_evidence": f"""WITH {_FAST} SELECT clip_id, incident_type, CASE
    WHEN rule = 'fast' AND incident_type = 'shoplifting' THEN printf('TF pose detector: shoplifting=%.1f%%, suspicious=%.1f%%, none=%.1f%%. Signal boost applied (distress=%.2f, horizontal=%.2f, motion=%.1f).', shoplifting * 100, suspicious_activity * 100, "none" * 100, distress_score, horizontal_posture_score, motion_mean)
    WHEN rule = 'fast' THEN printf('TF pose detector flagged suspicious activity (%.1f%%).', suspicious_activity * 100)
    WHEN incident_type = 'shoplifting' THEN printf('Signal heuristic: person is upright (h=%.2f), moving (motion=%.1f), no distress (%.2f) — retail anomaly pattern.', horizontal_posture_score, motion_mean, distress_score)
    ELSE 'Abrupt high-variance motion pattern observed.' END AS evidence, {_case('incident_type', ACTIONS, _text(NO_ACTION))} AS recommended_action
FROM fast_incidents WHERE incident_type <> 'none' AND confidence >= 0.4""",
    "incident_reports": f"""WITH {REPORTS} SELECT clip_id, report_id, source_filename, processing_time_ms, met AS met_latency_target, true AS offline_mode, CAST(100 AS BIGINT) AS emergency_latency_target_ms,
  CAST(1 AS BIGINT) AS incidents, CAST(1 AS BIGINT) AS timeline, incident_type, CASE WHEN emitted THEN confidence ELSE CAST(0.8 AS DOUBLE) END AS confidence,
  CASE WHEN emitted THEN CAST(1.5 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS timestamp_seconds, action AS recommended_action FROM reports""",
    "incident_alerts": f"WITH {REPORTS} SELECT report_id, incident_type, confidence, action AS recommended_action FROM reports WHERE emitted AND incident_type IN ('violent_activity', 'shoplifting') AND confidence >= 0.6",
    "incident_summary_top2": f"""WITH {CLASSIFIED}, top AS (SELECT clip_id % 10 AS camera, clip_id, incident_type, confidence, row_number() OVER (PARTITION BY clip_id % 10 ORDER BY confidence DESC, clip_id) AS k FROM incidents WHERE emitted),
lines AS (SELECT camera, string_agg(incident_type || ' (' || printf('%.2f', confidence) || ')', ', ' ORDER BY k) AS line FROM top WHERE k <= 2 GROUP BY camera)
SELECT camera, CASE WHEN line IS NULL THEN {_text(QUIET)} ELSE 'Detected potential incident(s): ' || line || '. Local alert workflow engaged.' END AS summary FROM (SELECT DISTINCT user_id % 10 AS camera FROM events) LEFT JOIN lines USING (camera)""",
    "report_listing": f"WITH {REPORTS} SELECT report_id, source_filename, CAST(emitted AS BIGINT) AS shown_incidents, CASE WHEN met THEN 'Yes' ELSE 'No' END AS target_met FROM reports",
    "report_order": f"WITH {REPORTS} SELECT report_id, clip_id, row_number() OVER (ORDER BY report_id DESC) - 1 AS listed, row_number() OVER (ORDER BY clip_id % 50 DESC, report_id DESC) - 1 AS shown FROM reports",
    "report_point": f"WITH {REPORTS} SELECT report_id, clip_id, source_filename, summary FROM reports WHERE clip_id = 7",
    "reports_scan": f"""WITH {REPORTS} SELECT report_id, source_filename, processing_time_ms, met AS met_latency_target, summary, '2024-02-01 00:00:00' AS created_at, CASE WHEN emitted THEN incident_type ELSE 'none' END AS incident_type,
  CASE WHEN emitted THEN confidence ELSE CAST(0.8 AS DOUBLE) END AS confidence, evidence AS note FROM reports""",
    "alerts_scan": f"WITH {REPORTS} SELECT report_id, summary, incident_type, confidence FROM reports WHERE emitted AND incident_type IN ('violent_activity', 'shoplifting') AND confidence >= 0.6",
    "landed_uploads": f"""WITH {_PAGES} SELECT page_id, '20240203T040506Z_' || md5(path || ':' || length(html)) || CASE WHEN {_SUFFIX.format('path')} = '' THEN '.mp4' ELSE {_SUFFIX.format('path')} END AS landed_name FROM uploads""",
    "frame_motion": f"WITH {FRAMES} SELECT clip_id, frame_idx, {_scaled('motion')} AS motion_thousandths, {_scaled('area_change', 100)} AS area_change_hundredths FROM moved",
    "horizontal_posture": f"WITH {FRAMES} SELECT clip_id, frame_idx, {_scaled('horizontal', 1_000_000)} AS posture_millionths, {_scaled('greatest(CAST(0 AS DOUBLE), least(CAST(1 AS DOUBLE), aspect_ratio))', 10_000)} AS clamped_ratio FROM moved",
    "stride_sampled_frames": f"""WITH {FRAMES}, n AS (SELECT clip_id, greatest(1, count(*) // 10) AS s FROM frames GROUP BY clip_id)
SELECT clip_id, count(*) AS samples, max(frame_idx) AS last_frame FROM frames JOIN n USING (clip_id) WHERE frame_idx % s = 0 GROUP BY clip_id""",
    "sampled_signals": f"""WITH {FRAMES}, n AS (SELECT clip_id, greatest(1, count(*) // 20) AS s FROM frames GROUP BY clip_id),
kept AS (SELECT frames.* FROM frames JOIN n USING (clip_id) WHERE frame_idx % s = 0),
changed AS (SELECT *, abs(brightness - lag(brightness) OVER v) AS m, abs(area - lag(area) OVER v) AS a, 1 / (1 + exp(-(aspect_ratio - CAST(1.4 AS DOUBLE)) * 3)) AS h FROM kept WINDOW v AS (PARTITION BY clip_id ORDER BY frame_idx))
SELECT clip_id, count(*) AS sample_count, coalesce({_mean('m')}, CAST(0 AS DOUBLE)) AS motion_mean, coalesce({_std('m')}, CAST(0 AS DOUBLE)) AS motion_std, {_mean('h', 1_000_000)} AS horizontal_posture_score,
  {_mean('aspect_ratio', 10_000)} AS aspect_ratio_mean, coalesce({_mean('a')}, CAST(0 AS DOUBLE)) AS area_change_mean FROM changed GROUP BY clip_id""",
    "signal_bundles": f"""WITH {SIGNALS}, {LATENCY} SELECT clip_id, motion_mean, distress_score, met_target, false AS fast_available, frame_count_processed AS frames, CAST(100 AS BIGINT) AS target_ms FROM signals JOIN latency USING (clip_id)""",
    "avi_frame_scan": """WITH f AS (SELECT user_id AS clip_id, row_number() OVER w - 1 AS frame_idx, CAST(floor(value) AS BIGINT) % 256 AS v, lag(CAST(floor(value) AS BIGINT) % 256) OVER w AS b, count(*) OVER (PARTITION BY user_id) AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT clip_id, frame_idx, n AS total_frames, v * 1000 AS brightness_thousandths, coalesce(abs(v - b), 0) * 1000 AS motion_thousandths FROM f WHERE frame_idx < 600""",
    "motion_series": f"WITH {CAMERAS} SELECT clip_id, count(*) AS n, string_agg(CAST({_scaled('motion')} AS VARCHAR), ',' ORDER BY frame_idx) AS series FROM moved WHERE frame_idx < 120 GROUP BY clip_id",
    "pixel_motion": """WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(round(CAST(x AS DOUBLE) * 1000) AS BIGINT)) AS g FROM embeddings),
l AS (SELECT *, lag(g) OVER (PARTITION BY label ORDER BY vec_id) AS b FROM v)
SELECT vec_id, CASE WHEN b IS NULL THEN 0 ELSE CAST(list_sum(list_transform(range(1, 65), lambda j: abs(g[j] - b[j]))) AS BIGINT) END AS moved FROM l""",
    "adaptive_controller": f"""WITH {FRAMES} SELECT clip_id, greatest(25, 50 - 10 * v) AS downscale_hundredths, least(4, 1 + v) AS skip_stride_final, n AS frames_processed, v AS violations
FROM (SELECT clip_id, count(*) AS n, count(*) FILTER (value > 100) AS v FROM frames WHERE frame_idx < 600 GROUP BY clip_id)""",
    "adaptive_controller_skipping": f"""WITH RECURSIVE {CAMERAS.strip()}, last_frame AS (SELECT clip_id, count(*) AS total FROM frames GROUP BY clip_id), walk AS (
  SELECT clip_id, CAST(0 AS BIGINT) AS i, CAST(50 AS BIGINT) AS d, CAST(1 AS BIGINT) AS s, CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS v FROM last_frame
  UNION ALL
  SELECT w.clip_id, i + 1, CASE WHEN i % s = 0 AND n < 600 AND value > 100 THEN greatest(25, d - 10) ELSE d END, CASE WHEN i % s = 0 AND n < 600 AND value > 100 THEN least(4, s + 1) ELSE s END,
         CASE WHEN i % s = 0 AND n < 600 THEN n + 1 ELSE n END, CASE WHEN i % s = 0 AND n < 600 AND value > 100 THEN v + 1 ELSE v END
  FROM walk w JOIN frames f ON f.clip_id = w.clip_id AND f.frame_idx = w.i)
SELECT clip_id, d AS downscale_hundredths, s AS skip_stride_final, n AS frames_processed, v AS violations FROM walk JOIN last_frame USING (clip_id) WHERE i = total""",
    "sliding_windows": f"WITH {FRAMES}, {WINDOWS} SELECT clip_id, start, count(*) AS frames, min(event_id) AS first_event, max(event_id) AS last_event FROM windows GROUP BY clip_id, start",
    "window_counts": "SELECT user_id AS clip_id, count(*) AS frames, CASE WHEN count(*) >= 32 THEN (count(*) - 32) // 8 + 1 ELSE 0 END AS windows FROM events GROUP BY user_id",
    "window_signals": f"WITH {_GRAPHS} SELECT * FROM window_signals",
    "window_incidents": f"""WITH {FRAMES}, {WINDOWS}, sums AS (SELECT clip_id, start, {_mean('motion')} AS motion_mean, {_std('motion')} AS motion_std, {_mean('horizontal', 1_000_000)} AS horizontal_posture_score FROM windows GROUP BY clip_id, start),
signals AS (SELECT *, least(CAST(1 AS DOUBLE), motion_std / 25) AS distress_score FROM sums) SELECT clip_id, start,{_RULE} FROM signals""",
    "head_window_pad": f"WITH {FRAMES} SELECT clip_id, CAST(64 AS BIGINT) AS n, 64 - count(*) FILTER (value <> 0) AS zeros, CAST(sum({_scaled('value', 100)}) AS BIGINT) AS total_hundredths FROM frames WHERE frame_idx < 64 GROUP BY clip_id",
    "runtime_tensor": f"""WITH {FRAMES} SELECT clip_id, CAST(32 AS BIGINT) AS rows, CAST(53 AS BIGINT) AS width, CAST(sum({_scaled('motion')}) AS BIGINT) AS motion_sum, CAST(sum({_scaled('value')}) AS BIGINT) AS audio_sum, CAST(0 AS BIGINT) AS other_sum
FROM moved WHERE frame_idx < 32 GROUP BY clip_id""",
    "longest_track": """SELECT user_id, day, n FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, day) AS k FROM (
  SELECT user_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS n FROM events GROUP BY 1, 2)) WHERE k = 1""",
    "frame_key_order": f"""WITH {FRAMES} SELECT clip_id, count(*) AS n, md5(string_agg(CAST(frame_idx AS VARCHAR), ',' ORDER BY CAST(frame_idx AS VARCHAR))) AS as_text, md5(string_agg(CAST(frame_idx AS VARCHAR), ',' ORDER BY frame_idx)) AS as_numbers
FROM frames GROUP BY clip_id""",
    "window_store_scan": f"""WITH {FRAMES}, {WINDOWS}, names AS (SELECT event_type AS label, row_number() OVER (ORDER BY f) - 1 AS label_id FROM (SELECT event_type, min((ts, event_id)) AS f FROM events GROUP BY event_type))
SELECT CAST(clip_id AS VARCHAR) AS clip_id, start, clip_id % 5 AS label_id, count(*) AS frames, CAST(sum({_scaled('CAST(CAST(value AS FLOAT) AS DOUBLE)', 10)}) AS BIGINT) AS sum_1, any_value(label) AS label
FROM windows JOIN names ON label_id = clip_id % 5 GROUP BY clip_id, start""",
    "label_csv_scan": "SELECT 'u' || user_id AS filename, event_type AS label FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS k FROM events) WHERE k = 1",
    "annotations_scan": f"""SELECT 'c' || label AS label, count(*) AS n, CAST(sum({_scaled('CAST(embedding[52] AS DOUBLE)')}) AS BIGINT) AS motion_thousandths,
  CAST(sum(list_sum(list_transform(range(0, 17), lambda j: {_scaled('CAST(embedding[3 * j + 1] AS DOUBLE)')}))) AS BIGINT) AS x_thousandths FROM embeddings GROUP BY label""",
    "pose_annotations": f"""WITH v AS (SELECT vec_id // 40 AS clip, CAST(vec_id % 40 AS VARCHAR) AS key, {_AT.format(1)} AS x, {_AT.format(2)} AS y, count(*) OVER (PARTITION BY vec_id // 40) AS n FROM embeddings),
l AS (SELECT *, lag(x) OVER w AS bx, lag(y) OVER w AS by_ FROM v WINDOW w AS (PARTITION BY clip ORDER BY key))
SELECT 'l' || clip % 5 AS label, count(*) AS frames, CAST(sum({_scaled('CASE WHEN bx IS NULL THEN CAST(0 AS DOUBLE) ELSE list_sum(list_transform(range(1, 18), lambda j: sqrt((x[j] - bx[j]) * (x[j] - bx[j]) + (y[j] - by_[j]) * (y[j] - by_[j])))) / 17 END')}) AS BIGINT) AS motion_thousandths
FROM l WHERE n >= 32 AND clip % 7 <> 0 GROUP BY 1""",
    "label_join": "SELECT doc_id, trim(lang) AS lang, n_chars, CAST(quality AS BIGINT) AS quality, CAST(toxic AS BIGINT) AS toxic FROM documents JOIN labels USING (doc_id)",
    "unlabeled_docs": "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "label_map_last_wins": "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS k FROM events) WHERE k = 1",
    "label_template_join": f"""SELECT event_id, label, {_template('label', 0)} AS evidence, {_template('label', 1)} AS action, {_confidence('label')} AS confidence,
  {_case('label', ACTIONS, _text(NO_ACTION))} AS default_action
FROM (SELECT event_id, {_case('event_type', {e: c for e, c in CLASS_OF.items() if e != 'view'}, "'unknown'")} AS label FROM events)""",
    "label_vocabulary": "SELECT event_type, row_number() OVER (ORDER BY f) - 1 AS label_id FROM (SELECT event_type, min((ts, event_id)) AS f FROM events GROUP BY event_type)",
    "class_counts": "SELECT event_type, n, max(n) OVER () AS most FROM (SELECT event_type, count(*) AS n FROM events GROUP BY event_type)",
    "class_weights": """WITH counts AS (SELECT event_type, count(*) AS n FROM events GROUP BY event_type UNION ALL SELECT 'never', 1)
SELECT event_type, n, CAST((SELECT sum(n) FROM counts) AS DOUBLE) / CAST((SELECT count(*) FROM counts) * n AS DOUBLE) AS weight FROM counts""",
    "event_distribution": """SELECT event_type, n, CAST(sum(n) OVER () AS BIGINT) AS total, CAST(floor(n * 100 / CAST(sum(n) OVER () AS DOUBLE) + CAST(0.5 AS DOUBLE)) AS BIGINT) AS percent
FROM (SELECT event_type, count(*) AS n FROM events GROUP BY event_type)""",
    "dashboard": "SELECT count(*) AS total_incidents, count(*) FILTER (CAST(ts AS DATE) = DATE '2024-01-15' AND value > 100) AS alerts_today FROM events",
    "reasoning_join": "SELECT event_id AS id, event_type, lang, CASE WHEN doc_id IS NOT NULL THEN '13%' END AS confidence FROM events LEFT JOIN documents ON event_id = doc_id",
    "sft_union": f"""WITH {_LABELLED} SELECT sample_id, label, {', '.join(f'{_scaled(c)} AS {c}' for c in _COLUMNS)} FROM labelled
UNION ALL {_synthetic('none', 10_000_000, 400)} UNION ALL {_synthetic('shoplifting', 20_000_000, 300)}""",
    "sft_rows": f"""WITH {_LABELLED} SELECT sample_id, label, md5({_text(TRAINING)} || {_WINDOW_SUMMARY} || {_text(TAIL)}) AS prompt_md5, {_RESPONSE.replace('EVIDENCE', _template('label', 0)).replace('ACTION', _template('label', 1))} AS response FROM labelled""",
    "sft_scan": f"""WITH {_LABELLED} SELECT {_RESPONSE.replace('EVIDENCE', _template('label', 0)).replace('ACTION', _template('label', 1))} AS response, count(*) AS n, count(DISTINCT {_WINDOW_SUMMARY}) AS prompts FROM labelled GROUP BY 1""",
    "sft_balanced": f"""WITH coded AS (SELECT event_type, event_id, {_mix('event_id', 0)} AS code FROM events),
ranked AS (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY code, event_id) - 1 AS r, count(*) OVER (PARTITION BY event_type) AS n FROM coded),
short AS (SELECT event_type, n, (SELECT max(n) FROM ranked) - n AS m FROM ranked GROUP BY 1, 2),
draws AS (SELECT event_type, n, unnest(range(m)) AS j FROM short),
taken AS (SELECT event_type, ({_mix('j', 84)} * 2147483648 + {_mix('j', 85)}) % n AS r, count(*) AS times FROM draws GROUP BY 1, 2)
SELECT event_type, event_id, unnest(range(coalesce(times, 0) + 1)) AS copy FROM ranked LEFT JOIN taken USING (event_type, r)""",
    "train_val_split": f"""WITH coded AS (SELECT vec_id, CAST(label AS BIGINT) AS label, {_mix('vec_id', 0)} AS code, count(*) OVER () AS n FROM embeddings),
ranked AS (SELECT *, CAST(floor(sqrt(n)) AS BIGINT) + 1 AS a, row_number() OVER (ORDER BY code, vec_id) - 1 AS x FROM coded),
sized AS (SELECT *, (n + a - 1) // a AS b FROM ranked),
walk AS (
  WITH RECURSIVE w AS (
    SELECT vec_id, n, a, b, x AS y, 0 AS k FROM sized
    UNION ALL SELECT vec_id, n, a, b, (high2 * a + low2) AS y, k + 1 FROM (
      SELECT *, (high1 + {_mix('low2', 171)}) % b AS high2 FROM (
        SELECT *, (low1 + {_mix('high1', 170)}) % a AS low2 FROM (
          SELECT *, (y // a + {_mix('low1', 169)}) % b AS high1 FROM (
            SELECT *, (y % a + {_mix('(y // a)', 168)}) % a AS low1 FROM w WHERE k = 0 OR y >= n))))
  ) SELECT vec_id, y AS place FROM w WHERE k > 0 AND y < n
)
SELECT vec_id, label, place, CASE WHEN place < floor(n * CAST(0.85 AS DOUBLE)) THEN 'train' ELSE 'validation' END AS split FROM sized JOIN walk USING (vec_id)""",
    "chat_messages": f"""SELECT doc_id, CAST(0 AS BIGINT) AS pos, 'system' AS role, CASE WHEN doc_id % 2 = 0 THEN 'Own system.' ELSE {_text(SYSTEM)} END AS content FROM documents
UNION ALL SELECT doc_id, 1, 'user', trim(lang) FROM documents UNION ALL SELECT doc_id, 2, 'assistant', trim(source) FROM documents""",
    "chat_render": _CHATS.format(f"CASE WHEN arg_min(role, turn) <> 'system' THEN '<|im_start|>system' || chr(10) || 'You are a helpful assistant.<|im_end|>' || chr(10) ELSE '' END || string_agg({_BLOCK}, '' ORDER BY turn)"),
    "chat_render_plain": _CHATS.format("string_agg(upper(role) || ': ' || text, chr(10) ORDER BY turn)"),
    "token_truncate": r"""SELECT doc_id, CAST(len(t) AS BIGINT) AS tokens, md5(array_to_string(t, ' ')) AS digest
FROM (SELECT doc_id, list_filter(string_split_regex(text, '[ \t\n\r\f\x0B]+'), lambda x: x <> '')[1:1024] AS t FROM documents)""",
    "multimodal_summary_text": f"""WITH {SIGNALS} SELECT clip_id, summary, md5({_text(LOCAL)} || summary || {_text(TAIL)}) AS local_md5, md5({_text(HOSTED)} || summary || {_text(TAIL)}) AS hosted_md5
FROM (SELECT clip_id, {_CLIP_SUMMARY} AS summary FROM signals)""",
    "multimodal_summary_shares": f"""WITH {_FAST} SELECT clip_id, {_CLIP_SUMMARY} || chr(10) || 'Fast detector probs: {{' || substr({_SHOWN}, 2) || chr(10) || '}}.' AS summary FROM fast_incidents""",
    "llm_reply_parse": _incidents(_reply_rows("Model reasoning", True)),
    "llm_reply_parse_local": _incidents(_reply_rows("Local model reasoning", False)),
    "llm_reply_parse_events": f"""WITH r AS (SELECT event_id, event_id % 10 AS k, {_case('event_type', CLASS_OF, 'NULL')} AS t, CAST('0.' || lpad(CAST(event_id % 100 AS VARCHAR), 2, '0') AS DOUBLE) AS c FROM events)
SELECT event_id AS reply_id, CAST(pos AS BIGINT) AS pos, CASE WHEN k >= 8 THEN 'none' ELSE t END AS incident_type, CASE k WHEN 8 THEN CAST(0.5 AS DOUBLE) WHEN 9 THEN CAST(0 AS DOUBLE) ELSE c END AS confidence,
  CASE WHEN k >= 8 THEN CAST(0 AS DOUBLE) ELSE CAST(event_id AS DOUBLE) END AS timestamp_seconds, CASE k WHEN 8 THEN 'e' ELSE 'Model reasoning' END AS evidence, CASE k WHEN 9 THEN 'a' ELSE {_text(NO_ACTION)} END AS recommended_action
FROM r, LATERAL (SELECT unnest(CASE k WHEN 4 THEN [1, 3] WHEN 9 THEN [1] WHEN 6 THEN [] WHEN 7 THEN [] ELSE [0] END) AS pos)""",
    "upload_validation": f"""WITH {_PAGES}, named AS (SELECT page_id, path || CASE page_id % 5 WHEN 0 THEN '.MP4' WHEN 1 THEN '.avi' ELSE '' END AS name, CASE WHEN page_id % 10 = 1 THEN 0 ELSE length(html) END AS size FROM uploads)
SELECT page_id, {_SUFFIX.format('name')} AS suffix, CASE WHEN coalesce(name, '') = '' THEN 'missing name' WHEN {_SUFFIX.format('name')} NOT IN ('.mp4', '.mov', '.avi', '.mkv') THEN 'unsupported type' WHEN coalesce(size, 0) <= 0 THEN 'empty file' END AS reason FROM named""",
    "suffix_parse": f"WITH {_PAGES} SELECT page_id, {_SUFFIX.format('path')} AS suffix FROM uploads",
    "embedding_reshape": "SELECT vec_id, CAST(17 AS BIGINT) AS joints, CAST(embedding[51] AS DOUBLE) AS last_score, CAST(53 AS BIGINT) AS width, CAST(embedding[52] AS DOUBLE) AS motion, CAST(embedding[53] AS DOUBLE) AS audio FROM embeddings",
    "keypoint_bbox": f"""SELECT vec_id, (list_max(x) - list_min(x)) * (list_max(y) - list_min(y)) AS box_area, span, greatest(CAST(0 AS DOUBLE), least(CAST(1 AS DOUBLE), 1 - least(CAST(1 AS DOUBLE), span / 150))) AS posture
FROM (SELECT vec_id, {_AT.format(1)} AS x, {_AT.format(2)} AS y, abs((CAST(embedding[17] AS DOUBLE) + CAST(embedding[20] AS DOUBLE)) / 2 - (CAST(embedding[35] AS DOUBLE) + CAST(embedding[38] AS DOUBLE)) / 2) AS span FROM embeddings)""",
    "keypoint_motion": f"""WITH v AS (SELECT vec_id, label, {_AT.format(1)} AS x, {_AT.format(2)} AS y FROM embeddings),
l AS (SELECT *, row_number() OVER w - 1 AS frame_idx, lag(x) OVER w AS bx, lag(y) OVER w AS by_ FROM v WINDOW w AS (PARTITION BY label ORDER BY vec_id))
SELECT vec_id, frame_idx, {_scaled('CASE WHEN bx IS NULL THEN CAST(0 AS DOUBLE) ELSE list_sum(list_transform(range(1, 18), lambda j: sqrt((x[j] - bx[j]) * (x[j] - bx[j]) + (y[j] - by_[j]) * (y[j] - by_[j])))) / 17 END')} AS motion_thousandths FROM l""",
    "tumbling": f"SELECT {_TIME.format('h')} AS start, event_type, count(*) AS n, {_VALUE} FROM (SELECT *, time_bucket(INTERVAL 1 HOUR, ts) AS h FROM events) GROUP BY h, event_type",
    "sliding": f"""SELECT {_TIME.format('s')} AS start, count(*) AS n, {_VALUE}
FROM (SELECT value, time_bucket(INTERVAL 15 MINUTE, ts) - k * INTERVAL 15 MINUTE AS s FROM events, range(0, 4) g(k)) GROUP BY s""",
    "session": f"""WITH marked AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
numbered AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM marked)
SELECT user_id, {_TIME.format('min(ts)')} AS start, count(*) AS n, {_VALUE} FROM numbered GROUP BY user_id, s""",
    "stream_motion_state": f"""WITH {FRAMES}, seen AS (SELECT *, count(*) FILTER (value > 100) OVER (PARTITION BY clip_id ORDER BY frame_idx) AS v FROM moved)
SELECT clip_id, event_id, frame_idx, greatest(25, 50 - 10 * v) AS downscale_hundredths, least(4, 1 + v) AS skip_stride, {_scaled('motion')} AS motion_thousandths FROM seen""",
    "stream_watermark_agg": f"""SELECT {_TIME.format('h')} AS start, event_type, count(*) AS n, {_VALUE} FROM (SELECT *, time_bucket(INTERVAL 1 HOUR, ts) AS h FROM events)
WHERE h + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE GROUP BY h, event_type""",
    "stream_static_join": "SELECT event_id, user_id, CAST(quality AS BIGINT) AS quality FROM events LEFT JOIN labels ON user_id = doc_id",
    "stream_once_each": "SELECT event_id, user_id FROM events",
    "stream_meter": "SELECT CAST(5 AS BIGINT) AS batches, count(*) AS frames, count(*) FILTER (value > 100) AS violations, CAST(round(max(value) * 100) AS BIGINT) AS max_hundredths, true AS in_order FROM events",
    "live_uploads": "SELECT DISTINCT user_id AS clip_id, CASE user_id % 10 WHEN 3 THEN 'unsupported type' WHEN 4 THEN 'unreadable' ELSE 'report' END AS outcome FROM events",
    "pose_event_accuracy": "SELECT n - CAST(floor(n * CAST(0.85 AS DOUBLE)) AS BIGINT) AS n, true AS learned FROM (SELECT count(*) AS n FROM embeddings)",
    "pose_event_network": "SELECT n - CAST(floor(n * CAST(0.85 AS DOUBLE)) AS BIGINT) AS n, true AS learned FROM (SELECT CAST(sum(CASE WHEN n >= 32 THEN (n - 32) // 8 + 1 ELSE 0 END) AS BIGINT) AS n FROM (SELECT count(*) AS n FROM events GROUP BY user_id))",
    "incident_rollup": f"WITH {CLASSIFIED} SELECT clip_id % 10 AS camera, incident_type, count(*) AS n, count(*) FILTER (emitted) AS emitted FROM incidents GROUP BY ROLLUP (clip_id % 10, incident_type)",
    "segment_revenue": """SELECT c_mktsegment, n_name, count(*) AS lines, CAST(sum(CAST(round(l_extendedprice * (1 - l_discount) * 100) AS BIGINT)) AS BIGINT) AS revenue_hundredths
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE l_shipdate > TIMESTAMP '1995-03-15' GROUP BY 1, 2""",
}
