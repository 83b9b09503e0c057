"""Tolerant reading of a language model's JSON reply."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import config
from tidemark.functions.text import strip_code_fence

# Defaults of missing fields, and the two readers' evidence defaults.
HOSTED_EVIDENCE, LOCAL_EVIDENCE = "Model reasoning", "Local model reasoning"


def _field(item: Column, name: str, kind: str, default) -> Column:
    return F.coalesce(F.try_variant_get(item, f"$.{name}", kind), F.lit(default))


def parse_replies(replies: DataFrame, key: str, text: str, strip: bool = True, default_evidence: str = HOSTED_EVIDENCE) -> DataFrame:
    """(key, pos, incident) for each incident in each reply.

    An object counts as a list of one, other roots as none; items that aren't objects
    are skipped; missing fields get defaults, unknown types `none`; quoted numbers are
    read. Text that isn't JSON gives nothing, and neither does a reply with a number
    that can't be read, a confidence outside 0 to 1 or a negative time. strip drops the
    stripped types.
    """
    bare = strip_code_fence(text)
    rows = replies.select(F.col(key), F.try_parse_json(bare).alias("_root"), bare.alias("_text")).where("_root is not null")
    is_object = F.schema_of_variant("_root").startswith("OBJECT")
    is_list = F.schema_of_variant("_root").startswith("ARRAY")
    rows = rows.where(is_object | is_list).select(key, F.when(is_object, F.try_parse_json(F.concat(F.lit("["), "_text", F.lit("]")))).otherwise(F.col("_root")).alias("_list"))
    items = rows.lateralJoin(rows.sparkSession.tvf.variant_explode(F.col("_list").outer())).select(key, "pos", "value")
    items = items.where(F.schema_of_variant("value").startswith("OBJECT"))
    raw = _field(F.col("value"), "incident_type", "string", "none")
    present = lambda name: F.try_variant_get("value", f"$.{name}", "variant").isNotNull()
    number = lambda name: F.when(present(name), F.try_variant_get("value", f"$.{name}", "double")).otherwise(0.0)
    items = items.select(
        key,
        "pos",
        F.when(raw.isin(*config.INCIDENT_TYPES), raw).otherwise("none").alias("incident_type"),
        number("confidence").alias("confidence"),
        number("timestamp_seconds").alias("timestamp_seconds"),
        _field(F.col("value"), "evidence", "string", default_evidence).alias("evidence"),
        _field(F.col("value"), "recommended_action", "string", config.FALLBACK_ACTION).alias("recommended_action"),
    )
    kept = items.where(~F.col("incident_type").isin(*config.STRIPPED_TYPES)) if strip else items
    bad = ~F.coalesce(F.col("confidence").between(0, 1) & (F.col("timestamp_seconds") >= 0), F.lit(False))
    broken = kept.where(bad).select(key).distinct()
    return kept.join(broken, key, "left_anti")


def first_reply(incidents: DataFrame, key: str) -> DataFrame:
    """(key, evidence, action) of each reply's first incident, the only one that is used."""
    best = F.min_by(F.struct("evidence", "recommended_action"), "pos")
    return incidents.groupBy(key).agg(best.alias("_r")).select(key, F.col("_r.evidence").alias("llm_evidence"), F.col("_r.recommended_action").alias("llm_action"))
