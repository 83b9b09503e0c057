"""Curation of training tables: joins with labels, balancing, splitting, and text targets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark import config
from tidemark.functions.text import json_text, number, prompt, summary_lines
from tidemark.operators import sampling


def last_wins(rows: DataFrame, key: str, position: Column | str) -> DataFrame:
    """One row for each key, the last in position."""
    at = F.col(position) if isinstance(position, str) else position
    newest = F.max_by(F.struct(*rows.columns), at)
    return rows.groupBy(F.col(key).alias("_key")).agg(newest.alias("_r")).select("_r.*")


def label_join(items: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """Inner join with a label map; items without a label drop out. The map's size picks the plan."""
    return items.join(labels, key, "inner")


def without_label(items: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """Beyond the inner join: the items that it drops."""
    return items.join(labels.select(key), key, "left_anti")


def label_templates(label: Column | str, part: str) -> Column:
    """Evidence or action of a label, those of `none` for an unknown one."""
    k = {"evidence": 0, "action": 1}[part]
    label = F.col(label) if isinstance(label, str) else label
    table = F.create_map(*(F.lit(x) for name, texts in config.LABEL_TEMPLATES.items() for x in (name, texts[k])))
    return F.coalesce(F.try_element_at(table, label), F.lit(config.LABEL_TEMPLATES["none"][k]))


def target_confidence(label: Column | str) -> Column:
    label = F.col(label) if isinstance(label, str) else label
    return F.when(label.isin("none", "suspicious_activity"), 0.85).otherwise(0.92)


def target_json(label: Column | str, confidence: Column | None = None) -> Column:
    """The response: a JSON list of one incident, with a space after commas and colons."""
    fields = {
        "incident_type": json_text(label),
        "confidence": number(target_confidence(label) if confidence is None else confidence),
        "timestamp_seconds": number(F.lit(1.0)),
        "evidence": json_text(label_templates(label, "evidence")),
        "recommended_action": json_text(label_templates(label, "action")),
    }
    return F.concat(F.lit("[{"), F.concat_ws(", ", *(F.concat(F.lit(f'"{name}": '), value) for name, value in fields.items())), F.lit("}]"))


def sft_rows(signals: DataFrame, confidence: Column | None = None) -> DataFrame:
    """(sample_id, label, prompt, response) of labelled window signals."""
    text = summary_lines(F.lit(30.0), F.coalesce("duration_seconds", F.lit(1.0)), "motion_mean", "motion_std", F.lit(100.0), "horizontal_posture_score", "area_change_mean", "audio_distress")
    return signals.select("sample_id", "label", prompt(text).alias("prompt"), target_json("label", confidence).alias("response"))


# Ranges of the synthetic rows' signals.
SYNTHETIC = {
    "none": {"motion_mean": (5, 18), "motion_std": (1, 6), "horizontal_posture_score": (0.05, 0.35), "area_change_mean": (0, 80), "audio_distress": (0, 0.25)},
    "shoplifting": {"motion_mean": (8, 22), "motion_std": (2, 7), "horizontal_posture_score": (0.1, 0.45), "area_change_mean": (20, 120), "audio_distress": (0, 0.35)},
}
SYNTHETIC_CONFIDENCE = 0.88


def synthetic_rows(ids: DataFrame, label: str, seed: int = 42) -> DataFrame:
    """A row of signals for each id: values spread over the label's ranges by arithmetic on the id, so any engine makes the same."""
    columns = []
    for k, (name, (low, high)) in enumerate(SYNTHETIC[label].items()):
        part = F.pmod(F.col("id") * 7919 + F.lit(104729 * (k + 1) + seed), F.lit(10007)) / F.lit(10007.0)
        columns.append((F.lit(float(low)) + part * F.lit(float(high) - float(low))).alias(name))
    return ids.select(F.col("id").alias("sample_id"), F.lit(label).alias("label"), F.lit(1.0).alias("duration_seconds"), *columns)


def class_counts(rows: DataFrame, label: str) -> DataFrame:
    return rows.groupBy(label).agg(F.count("*").alias("n"))


def class_weights(rows: DataFrame, vocabulary: DataFrame, label: str) -> DataFrame:
    """total / (K * count) for each label of a vocabulary; a count of 0 becomes 1 before totalling."""
    counts = vocabulary.select(label).join(class_counts(rows, label), label, "left").withColumn("n", F.greatest(F.coalesce("n", F.lit(0)), F.lit(1)))
    total = counts.agg(F.sum("n").alias("_total"), F.count("*").alias("_k"))
    out = counts.join(F.broadcast(total))  # one row
    return out.select(label, "n", (F.col("_total") / (F.col("_k") * F.col("n"))).alias("weight"))


def balance(rows: DataFrame, label: str, key: str, seed: int = 42) -> DataFrame:
    """Every label raised to the largest count by drawing its rows with replacement, with copy (0 for the row itself)."""
    drawn = sampling.with_replacement(rows, key, label, seed)
    return drawn.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies")))).drop("copies")


def shuffled(rows: DataFrame, key: str, into: str = "place", seed: int = 42, count: int | None = None) -> DataFrame:
    """Each row's place in a seeded permutation of all places; count: the rows, if they are counted already."""
    n = rows.count() if count is None else count
    ranked = sampling.hash_ranked(rows, "_rank", key)
    return ranked.withColumn(into, sampling.permuted(F.col("_rank"), n, seed).cast("long")).drop("_rank")


def train_validation(rows: DataFrame, key: str, fraction: float = config.DEFAULTS.train_fraction, seed: int = 42) -> DataFrame:
    """rows with place and split: the first floor(fraction n) train, the rest validation; without a rest, all are both."""
    total = rows.count()
    placed, cut = shuffled(rows, key, seed=seed, count=total), int(total * fraction)
    split = F.array(F.lit("train"), F.lit("validation")) if cut >= total else F.when(F.col("place") < cut, F.array(F.lit("train"))).otherwise(F.array(F.lit("validation")))
    return placed.withColumn("split", F.explode(split))


def distribution(rows: DataFrame, label: str) -> DataFrame:
    """Counts by label, the total, and whole percentages, halves up. The window without a key sees a row for each label, as few as there are."""
    counts = class_counts(rows, label)
    total = F.sum("n").over(Window.partitionBy(F.lit(0)))
    return counts.select(label, "n", total.alias("total"), F.floor(F.col("n") * 100 / total + 0.5).cast("long").alias("percent"))


def dashboard(incidents: DataFrame, day: Column) -> DataFrame:
    """(total_incidents, alerts_today) of incidents with created_at and alert."""
    today = F.to_date("created_at") == day
    return incidents.agg(F.count("*").alias("total_incidents"), F.count_if(today & F.col("alert")).alias("alerts_today"))


def reasoning_join(timeline: DataFrame, reasoning: DataFrame, key: str = "id") -> DataFrame:
    """Each incident with its reasoning, null where there is none."""
    return timeline.join(reasoning, key, "left")
