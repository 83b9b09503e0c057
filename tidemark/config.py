"""Settings and fixed thresholds of the engine."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, fields


@dataclass(frozen=True)
class Settings:
    """Read once on the driver; unknown keys of a source are ignored."""

    latency_target_ms: int = 100
    max_frames: int = 600
    series_cap: int = 120
    window: int = 32
    stride: int = 8
    default_fps: float = 30.0
    initial_downscale: float = 0.5
    downscale_step: float = 0.1
    min_downscale: float = 0.25
    max_stride: int = 4
    min_confidence: float = 0.4
    alert_confidence: float = 0.6
    train_fraction: float = 0.85
    max_tokens: int = 1024
    llm_endpoint: str = ""
    llm_model: str = ""
    hosted_endpoint: str = ""
    hosted_key: str = ""
    offline_mode: bool = True
    media_stays_local: bool = True
    alert_host: str = ""
    alert_port: int = 587
    alert_user: str = ""
    alert_password: str = ""
    alert_to: str = ""
    alert_from: str = ""

    @classmethod
    def load(cls, values: Mapping[str, str] | None = None, prefix: str = "TIDEMARK_") -> Settings:
        """From a mapping of strings (default: the environment), keys in upper case after the prefix."""
        values = os.environ if values is None else values
        kinds = {"int": int, "float": float, "str": str, "bool": lambda x: x.strip().lower() in ("1", "true", "yes", "on")}
        return cls(**{f.name: kinds[f.type](values[key]) for f in fields(cls) if (key := prefix + f.name.upper()) in values})

    @classmethod
    def from_file(cls, path: str, prefix: str = "TIDEMARK_") -> Settings:
        """From KEY=VALUE lines; blank lines and comments are skipped."""
        with open(path, encoding="utf-8") as f:
            pairs = (line.split("=", 1) for line in map(str.strip, f) if "=" in line and not line.startswith("#"))
            return cls.load({k.strip(): v.strip().strip("\"'") for k, v in pairs}, prefix)

    def llm_available(self) -> bool:
        return bool(self.llm_endpoint and self.llm_model)

    def mail_available(self) -> bool:
        return bool(self.alert_host and self.alert_to and self.alert_user and self.alert_password)


DEFAULTS = Settings()

# The allow-list of incident types and the groups the rules use.
INCIDENT_TYPES = ("fainting", "choking", "violent_activity", "shoplifting", "suspicious_activity", "intrusion", "none")
STRIPPED_TYPES = ("fainting", "choking")
SEVERE_TYPES = ("fainting", "choking", "violent_activity", "shoplifting")
#: Characters of a report's id that name its partition.
REPORT_PART = 2
VIDEO_SUFFIXES = (".mp4", ".mov", ".avi", ".mkv")

# Action texts by incident type.
DEFAULT_ACTIONS = {
    "shoplifting": "Track subject, notify nearby staff, and retain camera evidence.",
    "suspicious_activity": "Monitor in real-time and notify floor guard.",
    "violent_activity": "Trigger high-priority security escalation.",
    "intrusion": "Alert security team immediately.",
}
FALLBACK_ACTION = "Continue monitoring."

# The row for a clip without incidents, and the two summary texts.
NONE_CONFIDENCE = 0.8
NONE_EVIDENCE = "No severe event detected from current multimodal signals."
SANITIZED_EVIDENCE = "No critical event (pipeline is shoplifting-only)."
QUIET_SUMMARY = "No critical event detected. Monitoring remains active."
SUMMARY_HEAD, SUMMARY_TAIL = "Detected potential incident(s): ", ". Local alert workflow engaged."
INCIDENT_SECONDS = 1.5

# Evidence and action of training targets by label.
LABEL_TEMPLATES = {
    "fainting": ("Person posture collapsed to near-horizontal; very low movement; possible medical emergency.", "Dispatch nearby responder immediately."),
    "choking": ("Breathing/distress pattern and abrupt upper-body instability observed.", "Issue emergency alert and request human confirmation."),
    "violent_activity": ("High-variance motion and conflict-like pose transitions detected.", "Trigger high-priority security escalation."),
    "shoplifting": ("Object interaction followed by concealment and exit-like movement pattern detected.", "Notify security team and retain timestamped evidence clip."),
    "suspicious_activity": ("Sustained movement anomaly detected around restricted area.", "Notify guard and keep tracking."),
    "intrusion": ("Unauthorized entry or perimeter breach detected.", "Notify security and verify identity."),
    "none": ("No severe event pattern found in this window; normal or ambiguous activity.", "Continue monitoring."),
}

# The prompts, {} standing for what each is about. Rules differ between training, the hosted and the local model.
PROMPTS = {
    "training": (
        "You are the primary security incident classifier. Use ONLY the multimodal summary below.\n"
        "\n"
        "RULES:\n"
        "- Choose the SINGLE most likely incident type. Do NOT default to fainting.\n"
        "- Fainting = person collapsed (horizontal body, very low movement, medical emergency).\n"
        "- Shoplifting = concealment, item handling, retail context, person leaving without paying.\n"
        "- Use 'suspicious_activity' or 'none' for unclear or normal activity.\n"
        '- Return ONLY a JSON array with exactly one object: {"incident_type", "confidence", "timestamp_seconds", "evidence", "recommended_action"}.\n'
        "Allowed incident_type: fainting, choking, violent_activity, shoplifting, suspicious_activity, intrusion, none.\n"
        "\n"
        "MULTIMODAL SUMMARY:\n"
        "{}\n"
        "\n"
        "JSON array:"
    ),
    "hosted": (
        "You are the primary security incident classifier. Use ONLY the multimodal summary below.\n"
        "\n"
        "RULES:\n"
        "- Choose the SINGLE most likely incident type.\n"
        "- Focus on: shoplifting, suspicious_activity, violent_activity, or none.\n"
        "- Shoplifting = concealment, item handling, retail context, person leaving without paying.\n"
        "- Do NOT classify as fainting or choking.\n"
        '- Return ONLY a JSON array with exactly one object: {"incident_type", "confidence", "timestamp_seconds", "evidence", "recommended_action"}.\n'
        "Allowed incident_type: shoplifting, suspicious_activity, violent_activity, intrusion, none.\n"
        "\n"
        "MULTIMODAL SUMMARY:\n"
        "{}\n"
        "\n"
        "JSON array:"
    ),
    "local": (
        "You are the primary security incident classifier. Use ONLY the multimodal summary below.\n"
        "\n"
        "RULES:\n"
        "- Choose the SINGLE most likely incident type.\n"
        "- Focus on: shoplifting, suspicious_activity, violent_activity, or none.\n"
        "- Shoplifting = concealment, item handling, retail context, person moving with items.\n"
        "- Do NOT classify as fainting or choking. Those are not valid.\n"
        '- Return ONLY a JSON array with exactly one object: {"incident_type", "confidence", "timestamp_seconds", "evidence", "recommended_action"}.\n'
        "Allowed incident_type: shoplifting, suspicious_activity, violent_activity, intrusion, none.\n"
        "\n"
        "MULTIMODAL SUMMARY:\n"
        "{}\n"
        "\n"
        "JSON array:"
    ),
    "refine": (
        "You are a local emergency reasoning model.\n"
        "Given multimodal input and baseline detections, return ONLY JSON array.\n"
        "Fields: incident_type, confidence, timestamp_seconds, evidence, recommended_action.\n"
        "Allowed incident_type: fainting, choking, violent_activity, shoplifting, suspicious_activity, intrusion, none.\n"
        "\n"
        "signals={}\n"
        "baseline={}\n"
    ),
}

# Lines of the summary of a clip's signals; places of decimals follow the colon.
SUMMARY_LINES = (
    "Video: fps={:1}, duration_sec={:1}, motion_mean={:2}, motion_std={:2}, brightness_mean={:1}.",
    "Body pose (TensorFlow): horizontal_posture_score={:2} (1=lying/collapsed), area_change_mean={:0}.",
    "Audio: distress_score={:2} (high=distress/coughing).",
)
SUMMARY_PROBABILITIES = "Fast detector probs: {}."
# Evidence of the rules.
EVIDENCE = {
    "heuristic": {
        "shoplifting": "Signal heuristic: person is upright (h={:2}), moving (motion={:1}), no distress ({:2}) — retail anomaly pattern.",
        "violent_activity": "Abrupt high-variance motion pattern observed.",
    },
    "fast": {
        "shoplifting": "TF pose detector: shoplifting={:1}%, suspicious={:1}%, none={:1}%. Signal boost applied (distress={:2}, horizontal={:2}, motion={:1}).",
        "suspicious_activity": "TF pose detector flagged suspicious activity ({:1}%).",
    },
}
# Lines of a history entry.
INSIGHT_LATENCY = "Frame latency p95 {:1}ms, max {:1}ms, violations {}."
INSIGHT_UPLOAD = "Upload analysis latency {:1}ms."
INSIGHT_TARGET = "Latency target met: {}."
INSIGHT_INCIDENT = "{} ({}%) at {:1}s: {}"
INSIGHT_QUIET = "No critical incidents detected."
SYSTEM_TURN = "You are a security incident reasoning model. Return strict JSON only."
TEMPLATE_SYSTEM_TURN = "You are a helpful assistant."
CHAT_START, CHAT_END = "<|im_start|>", "<|im_end|>"
