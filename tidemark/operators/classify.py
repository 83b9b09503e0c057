"""Signals to incidents, reports and alerts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import config
from tidemark.config import DEFAULTS, Settings
from tidemark.functions.signals import get_or, uniform_prior
from tidemark.functions.text import fill, label_render, stable_id
from tidemark.operators.ranking import numbered

# Thresholds of the two rules.
MOVING, CALM, UPRIGHT, UPRIGHT_FAST = 0.5, 0.3, 0.85, 0.8
VIOLENT_MEAN, VIOLENT_STD = 10.0, 8.0
BOOSTS = {"calm": 0.30, "upright": 0.10, "moving": 0.10}


def _verdict(kind: Column | str, confidence: Column) -> Column:
    return F.struct((F.lit(kind) if isinstance(kind, str) else kind).alias("type"), confidence.alias("confidence"))


def heuristic_rule() -> Column:
    """(type, confidence) from motion_mean, motion_std, distress_score and horizontal_posture_score."""
    mean, std = F.col("motion_mean"), F.col("motion_std")
    taking = (mean > MOVING) & (F.col("distress_score") < CALM) & (F.col("horizontal_posture_score") < UPRIGHT)
    violent = (mean > VIOLENT_MEAN) & (std > VIOLENT_STD)
    return (
        F.when(taking, _verdict("shoplifting", F.least(F.lit(0.80), 0.50 + mean / 15)))
        .when(violent, _verdict("violent_activity", F.least(F.lit(0.90), 0.4 + std / 40)))
        .otherwise(_verdict("none", F.lit(0.0)))
    )


def fast_path_rule(probabilities: Column | str = "event_probs", available: Column | str = "fast_available") -> Column:
    """(type, confidence) from class probabilities, boosted by signals; `none` where the model isn't there or nothing exceeds the uniform prior."""
    p = F.col(probabilities) if isinstance(probabilities, str) else probabilities
    there = F.col(available) if isinstance(available, str) else available
    taking, suspicious, none = get_or(p, "shoplifting", 0.0), get_or(p, "suspicious_activity", 0.0), get_or(p, "none", 1.0)
    prior = uniform_prior(p)
    boost = lambda when, amount: F.when(when, amount).otherwise(0.0)
    raised = taking + boost(F.col("distress_score") < CALM, BOOSTS["calm"]) + boost(F.col("horizontal_posture_score") < UPRIGHT_FAST, BOOSTS["upright"]) + boost(F.col("motion_mean") > MOVING, BOOSTS["moving"])
    found = (
        F.when(taking > prior, _verdict("shoplifting", F.least(F.lit(0.95), raised)))
        .when((suspicious > prior) & (suspicious > none), _verdict("suspicious_activity", F.least(F.lit(0.85), suspicious + 0.25)))
        .otherwise(_verdict("none", F.lit(0.0)))
    )
    return F.when(there, found).otherwise(_verdict("none", F.lit(0.0)))


def classify(clips: DataFrame, fast_path: bool = False) -> DataFrame:
    """clips with incident_type, confidence and rule (fast, heuristic or none)."""
    rows = clips.withColumn("_h", heuristic_rule())
    if fast_path:
        rows = rows.withColumn("_f", fast_path_rule())
        fast = F.col("_f.type") != "none"
        rows = rows.withColumn("_v", F.when(fast, F.col("_f")).otherwise(F.col("_h"))).withColumn("rule", F.when(fast, "fast").when(F.col("_h.type") != "none", "heuristic").otherwise("none"))
    else:
        rows = rows.withColumn("_v", F.col("_h")).withColumn("rule", F.when(F.col("_h.type") != "none", "heuristic").otherwise("none"))
    return rows.withColumns({"incident_type": F.col("_v.type"), "confidence": F.col("_v.confidence")}).drop("_h", "_f", "_v")


def choose_route(hosted: DataFrame, rules: DataFrame, key: str, mode: str) -> DataFrame:
    """Incidents of the hosted model where it gave any (mode `hosted`), of the rules elsewhere and in all other modes."""
    if mode != "hosted":
        return rules
    return hosted.unionByName(rules.join(hosted.select(key).distinct(), key, "left_anti"))


def evidence(fast_path: bool = False) -> Column:
    """Evidence text of a classified row."""
    slow, fast = config.EVIDENCE["heuristic"], config.EVIDENCE["fast"]
    taking = fill(slow["shoplifting"], "horizontal_posture_score", "motion_mean", "distress_score")
    text = F.when(F.col("incident_type") == "shoplifting", taking).when(F.col("incident_type") == "violent_activity", slow["violent_activity"])
    if not fast_path:
        return text
    share = lambda name, default: get_or("event_probs", name, default) * 100
    found = fill(fast["shoplifting"], share("shoplifting", 0.0), share("suspicious_activity", 0.0), share("none", 1.0), "distress_score", "horizontal_posture_score", "motion_mean")
    flagged = fill(fast["suspicious_activity"], share("suspicious_activity", 0.0))
    return F.when(F.col("rule") == "fast", F.when(F.col("incident_type") == "shoplifting", found).otherwise(flagged)).otherwise(text)


def default_action(kind: Column | str) -> Column:
    """Action by incident type, with a constant for the rest."""
    kind = F.col(kind) if isinstance(kind, str) else kind
    actions = F.create_map(*(F.lit(x) for kv in config.DEFAULT_ACTIONS.items() for x in kv))
    return F.coalesce(F.try_element_at(actions, kind), F.lit(config.FALLBACK_ACTION))


def emit(classified: DataFrame, settings: Settings = DEFAULTS, fast_path: bool = False, replies: DataFrame | None = None, key: str = "clip_id") -> DataFrame:
    """Incidents: rows with a type and enough confidence, with evidence and action.

    replies (key, llm_evidence, llm_action) adds a model's evidence where it gave any, and
    its action instead of the default; the model is asked after this gate, see
    tidemark.operators.enrich.
    """
    rows = classified.where((F.col("incident_type") != "none") & (F.col("confidence") >= settings.min_confidence))
    parts = [evidence(fast_path)]
    action = default_action("incident_type")
    if replies is not None:
        rows = rows.join(replies, key, "left")
        parts.append(F.when(F.coalesce(F.col("llm_evidence"), F.lit("")) != "", F.concat(F.lit("LLM: "), "llm_evidence")))
        action = F.coalesce(F.nullif(F.col("llm_action"), F.lit("")), action)
    return rows.withColumns({"timestamp_seconds": F.lit(config.INCIDENT_SECONDS), "evidence": F.concat_ws(" ", *parts), "recommended_action": action})


# ---- incident lists


def incident(kind="incident_type", confidence="confidence", seconds="timestamp_seconds", text="evidence", action="recommended_action") -> Column:
    c = lambda x: F.col(x) if isinstance(x, str) else x
    return F.struct(c(kind).alias("incident_type"), c(confidence).alias("confidence"), c(seconds).alias("timestamp_seconds"), c(text).alias("evidence"), c(action).alias("recommended_action"))


def none_incident(seconds: Column | None = None, text: str = config.NONE_EVIDENCE) -> Column:
    return incident(F.lit("none"), F.lit(config.NONE_CONFIDENCE), F.lit(0.0) if seconds is None else seconds, F.lit(text), F.lit(config.FALLBACK_ACTION))


def strip_types(incidents: Column | str) -> Column:
    return F.filter(incidents, lambda i: ~i["incident_type"].isin(*config.STRIPPED_TYPES))


def default_if_empty(incidents: Column | str) -> Column:
    return F.when(F.size(incidents) == 0, F.array(none_incident())).otherwise(F.col(incidents) if isinstance(incidents, str) else incidents)


def sanitize(incidents: Column | str) -> Column:
    """A last guard: a stripped type that got here becomes `none` at its time."""
    return F.transform(incidents, lambda i: F.when(i["incident_type"].isin(*config.STRIPPED_TYPES), none_incident(i["timestamp_seconds"], config.SANITIZED_EVIDENCE)).otherwise(i))


def timeline(incidents: Column | str) -> Column:
    return F.transform(incidents, lambda i: F.struct(i["timestamp_seconds"].alias("t"), i["incident_type"].alias("type"), i["confidence"].alias("confidence"), i["evidence"].alias("note")))


def top_incidents(incidents: Column | str, most: int = 2) -> Column:
    """The most confident that aren't `none`, earlier ones first among equals."""
    ranked = F.transform(F.filter(incidents, lambda i: i["incident_type"] != "none"), lambda i, k: F.struct((-i["confidence"]).alias("c"), k.alias("k"), i.alias("i")))
    return F.transform(F.slice(F.array_sort(ranked), 1, most), lambda r: r["i"])


def summary(incidents: Column | str) -> Column:
    top = top_incidents(incidents)
    return F.when(F.size(top) == 0, config.QUIET_SUMMARY).otherwise(F.concat(F.lit(config.SUMMARY_HEAD), label_render(top), F.lit(config.SUMMARY_TAIL)))


def valid_incident(confidence: Column | str = "confidence", seconds: Column | str = "timestamp_seconds") -> Column:
    c = F.col(confidence) if isinstance(confidence, str) else confidence
    t = F.col(seconds) if isinstance(seconds, str) else seconds
    return F.coalesce(c.between(0, 1) & (t >= 0), F.lit(False))


def _report_columns(settings: Settings, created_at: Column | None, signals: Column | None) -> list[Column | str]:
    target = settings.latency_target_ms
    columns = [
        "clip_id",
        stable_id("clip_id", "source_filename").alias("report_id"),
        "source_filename",
        (F.current_timestamp() if created_at is None else created_at).alias("created_at"),
        "processing_time_ms",
        F.lit(target).alias("emergency_latency_target_ms"),
        (F.col("processing_time_ms") <= target).alias("met_latency_target"),
        F.lit(settings.offline_mode).alias("offline_mode"),
        F.lit(settings.media_stays_local).alias("video_never_leaves_device"),
        summary("incidents").alias("summary"),
        "incidents",
        timeline("incidents").alias("timeline"),
    ]
    return columns + ([signals.alias("raw_signals")] if signals is not None else [])


def assemble_reports(clips: DataFrame, incidents: DataFrame, settings: Settings = DEFAULTS, created_at: Column | None = None, signals: Column | None = None) -> DataFrame:
    """One report for each clip (clip_id, source_filename, processing_time_ms, ...) with its incidents.

    report_id is derived from the clip, so a second run writes the same reports.
    """
    lists = incidents.groupBy("clip_id").agg(F.sort_array(F.collect_list(incident())).alias("incidents"))
    rows = clips.join(lists, "clip_id", "left")
    rows = rows.withColumn("incidents", strip_types(F.coalesce("incidents", F.array().cast(lists.schema["incidents"].dataType))))
    rows = rows.withColumn("incidents", sanitize(default_if_empty("incidents")))
    return rows.select(*_report_columns(settings, created_at, signals))


def clip_reports(classified: DataFrame, settings: Settings = DEFAULTS, created_at: Column | None = None, signals: Column | None = None, fast_path: bool = False) -> DataFrame:
    """The same for classified clips whose one incident, if any, is in their own row: no join and no grouping."""
    there = (F.col("incident_type") != "none") & (F.col("confidence") >= settings.min_confidence)
    own = incident(seconds=F.lit(config.INCIDENT_SECONDS), text=F.coalesce(evidence(fast_path), F.lit("")), action=default_action("incident_type"))
    rows = classified.withColumn("incidents", F.when(there, F.array(own)).otherwise(F.array(none_incident())))
    rows = rows.withColumn("incidents", sanitize(default_if_empty(strip_types("incidents")))).drop("incident_type", "confidence")
    return rows.select(*_report_columns(settings, created_at, signals))


def alerts(reports: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """(report_id, summary, critical_incidents) of reports with a severe incident of enough confidence."""
    severe = F.filter("incidents", lambda i: i["incident_type"].isin(*config.SEVERE_TYPES) & (i["confidence"] >= settings.alert_confidence))
    return reports.select("report_id", "summary", severe.alias("critical_incidents")).where(F.size("critical_incidents") > 0)


def list_reports(reports: DataFrame, recent_first: bool = False) -> DataFrame:
    """By report_id downwards, as files are listed, or the newest first."""
    return reports.orderBy(F.col("created_at").desc(), F.col("report_id").desc()) if recent_first else reports.orderBy(F.col("report_id").desc())


def listing_places(reports: DataFrame, into: str, recent_first: bool = False) -> DataFrame:
    """reports with each one's place from 0 in the order of list_reports; ids begin with hexadecimal digits.

    Places are numbered in buckets of one order: the first digits of ids, or the hours of created_at.
    """
    digits = F.conv(F.substring("report_id", 1, 3), 16, 10).cast("int")
    if recent_first:
        return numbered(reports, into, -F.floor(F.unix_timestamp("created_at") / 3600), [F.col("created_at").desc(), F.col("report_id").desc()])
    return numbered(reports, into, -digits, [F.col("report_id").desc()])


def report_by_id(reports: DataFrame, report_id: str) -> DataFrame:
    return reports.where(F.col("report_id") == report_id)


def history(reports: DataFrame) -> DataFrame:
    """Entries for a history list, newest first: reports without `none` incidents' noise."""
    shown = F.slice(F.filter("incidents", lambda i: i["incident_type"] != "none"), 1, 4)
    return list_reports(reports.withColumn("shown_incidents", shown), recent_first=True)
