"""Text functions: formats, insight lines, prompts and parsing of names."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark import config
from tidemark.functions.signals import col


def fixed(x: Column | str, places: int, ties_up: bool = False) -> Column:
    """A number with so many decimals, rounded from its exact binary value, halves to even (or up).

    format_string rounds the shortest decimal that reads as the number, which differs at
    values such as 2.675. Here the number times a power of two is a whole number, so the
    quotient and its rest are exact in decimals. Numbers of 10 ** 12 and more are printed whole.
    """
    power = lambda n: F.call_function("shiftleft", F.lit(1).cast("long"), n).cast("decimal(20,0)")

    def digits(v: Column) -> Column:
        return _let(F.abs(v), lambda size: _let((53 - F.floor(F.log2(F.greatest(size, F.lit(1e-6))))).cast("int"), lambda k: quotient(size, k)))

    def quotient(size: Column, k: Column) -> Column:
        scaled = (size * F.pow(F.lit(2.0), k)).cast("long").cast("decimal(20,0)") * F.lit(10**places).cast("decimal(10,0)")
        whole = power(F.least(F.greatest(k, F.lit(0)), F.lit(62))) * power(F.greatest(k - 62, F.lit(0)))
        return _let(F.struct(scaled.alias("s"), whole.alias("w")), lambda v: _let(F.struct(v["s"].alias("s"), v["w"].alias("w"), (v["s"] % v["w"]).alias("r")), rounded))

    def rounded(v: Column) -> Column:
        def up(down: Column) -> Column:
            half = F.lit(True) if ties_up else down % 2 == 1
            return (down + ((v["r"] * 2 > v["w"]) | ((v["r"] * 2 == v["w"]) & half)).cast("long")).cast("string")

        return _let(((v["s"] - v["r"]) / v["w"]).cast("long"), up)

    def shown(d: Column) -> Column:
        if not places:
            return d
        whole = lambda t: F.concat(F.substr(t, F.lit(1), F.length(t) - places), F.lit("."), F.right(t, F.lit(places)))
        return _let(F.lpad(d, F.greatest(F.length(d), F.lit(places + 1)), F.lit("0")), whole)

    def one(v: Column) -> Column:
        exact = F.concat(F.when(v < 0, "-").otherwise(""), _let(digits(v), shown))
        large, tiny = F.format_string(f"%.{places}f", v), F.lit(f"{0:.{places}f}")
        return F.when(v.isNull(), F.lit(None).cast("string")).when(F.isnan(v), "nan").when(F.abs(v) >= 1e12, large).when(F.abs(v) < 1e-6, tiny).otherwise(exact)

    return _let(col(x).cast("double"), one)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is worked out once, however often it stands there."""
    return F.get(F.transform(F.array(value), body), 0)


def number(x: Column | str) -> Column:
    """A double's shortest text as JSON has it: 0.0001, but 1e-05; for numbers under ten million."""
    plain = col(x).cast("double").cast("string")
    digits = F.regexp_replace(F.regexp_replace(plain, r"E.*$", ""), r"\.0$", "")
    power = F.regexp_extract(plain, r"E-(\d+)$", 1)
    small = F.concat(digits, F.lit("e-"), F.lpad(power, 2, "0"))
    places = F.concat(F.regexp_extract(plain, "^-?", 0), F.lit("0.000"), F.regexp_replace(digits, r"[-.]", ""))
    return F.when(power == "", plain).when(power == "4", places).otherwise(small)


def fill(template: str, *values: Column | str, ties_up: bool = False) -> Column:
    """A template's text with {} and {:places} replaced by the values in turn; a missing number counts as 0."""
    parts = re.split(r"\{(:?\d*)\}", template)
    out = [F.lit(parts[0])]
    for value, places, after in zip(values, parts[1::2], parts[2::2], strict=True):
        out += [fixed(F.coalesce(col(value), F.lit(0.0)), int(places[1:]), ties_up) if places else col(value).cast("string"), F.lit(after)]
    return F.concat(*out)


def percent(x: Column | str) -> Column:
    """One decimal and a percent sign."""
    return F.concat(fixed(col(x) * 100, 1), F.lit("%"))


def whole_percent(x: Column | str) -> Column:
    """A share as a whole percentage, halves up."""
    return F.floor(col(x) * 100 + 0.5).cast("long")


def confidence_percent(x: Column | str) -> Column:
    return F.concat(F.round(col(x) * 100).cast("long").cast("string"), F.lit("%"))


def label_render(incidents: Column | str) -> Column:
    """`type (0.00)` of each incident, joined by ", "."""
    return F.array_join(F.transform(col(incidents), lambda i: fill("{} ({:2})", i["incident_type"], i["confidence"])), ", ")


def suffix(path: Column | str) -> Column:
    """Lower-cased extension with its dot, or an empty text."""
    return F.lower(F.regexp_extract(col(path), r"(\.[^./\\]+)$", 1))


def stamp(ts: Column | str) -> Column:
    return F.date_format(col(ts), "yyyyMMdd'T'HHmmss'Z'")


def local_stamp(ts: Column | str) -> Column:
    """A readable timestamp in the session's time zone."""
    return F.date_format(col(ts), "M/d/yyyy, h:mm:ss a")


def stable_id(*columns: Column | str) -> Column:
    """A v4-shaped id from a record's contents, so that a repeated write hits the same key."""
    h = F.sha2(F.concat_ws("\x1f", *(col(c).cast("string") for c in columns)), 256)
    part = lambda a, n: F.substring(h, a, n)
    return F.concat_ws("-", part(1, 8), part(9, 4), F.concat(F.lit("4"), part(14, 3)), F.concat(F.lit("8"), part(18, 3)), part(21, 12))


def random_id() -> Column:
    return F.uuid() if hasattr(F, "uuid") else F.expr("uuid()")


def upload_name(ts: Column, unique: Column, path: Column | str) -> Column:
    """UTC stamp, id and original suffix (default .mp4) of a landed upload."""
    own = suffix(path)
    return F.concat(stamp(ts), F.lit("_"), F.regexp_replace(unique, "-", ""), F.when(own == "", ".mp4").otherwise(own))


def strip_code_fence(text: Column | str) -> Column:
    """Trimmed; a text that starts with three backticks loses them at both ends, then a leading `json`."""
    whole = F.regexp_replace(col(text), r"^\s+|\s+$", "")
    inside = F.regexp_replace(whole, "^`+|`+$", "")
    tagged = F.lower(F.substring(inside, 1, 4)) == "json"
    inner = F.when(tagged, F.regexp_replace(F.substr(inside, F.lit(5), F.length(inside)), r"^\s+|\s+$", "")).otherwise(inside)
    return F.when(whole.startswith("```"), inner).otherwise(whole)


def summary_lines(fps, duration, motion_mean, motion_std, brightness, horizontal, area_change, distress, probabilities: Column | None = None) -> Column:
    """The three-line summary of a clip's signals, and a fourth with class probabilities if there are any."""
    values = [[fps, duration, motion_mean, motion_std, brightness], [horizontal, area_change], [distress]]
    lines = [fill(line, *v) for line, v in zip(config.SUMMARY_LINES, values, strict=True)]
    if probabilities is not None:
        pairs = F.transform(F.map_entries(probabilities), lambda e: F.concat(json_text(e["key"]), F.lit(": "), number(e["value"])))
        shown = fill(config.SUMMARY_PROBABILITIES, F.concat(F.lit("{\n"), F.array_join(pairs, ",\n"), F.lit("\n}")))
        lines.append(F.when(F.size(probabilities) > 0, shown))
    return F.concat_ws("\n", *lines)


def json_text(x: Column | str) -> Column:
    """A string as JSON: what to_json makes of it in an object, without the object."""
    whole = F.to_json(F.struct(col(x).alias("x")))
    return F.substr(whole, F.lit(6), F.length(whole) - 6)


def prompt(summary: Column | str, kind: str = "training") -> Column:
    before, after = config.PROMPTS[kind].rsplit("{}", 1)
    return F.concat(F.lit(before), col(summary), F.lit(after))


def refine_prompt(signals: Column, baseline: Column) -> Column:
    """What the local model is asked about a clip's signals and the rules' incidents, both as JSON."""
    first, second, rest = config.PROMPTS["refine"].split("{}")
    return F.concat(F.lit(first), F.to_json(signals), F.lit(second), F.to_json(baseline), F.lit(rest))


def insight_line(incident: Column) -> Column:
    return fill(config.INSIGHT_INCIDENT, incident["incident_type"], whole_percent(incident["confidence"]), incident["timestamp_seconds"], incident["evidence"], ties_up=True)


def insights(incidents: Column | str, latency: Column, processing_ms: Column, met: Column, most: int = 4) -> Column:
    """Lines for a history entry: latency, target, and up to four incidents that aren't `none`."""
    shown = F.slice(F.filter(col(incidents), lambda i: i["incident_type"] != "none"), 1, most)
    line = fill(config.INSIGHT_LATENCY, latency["p95_ms"], latency["max_ms"], F.coalesce(latency["violations"], F.lit(0)), ties_up=True)
    first = F.when(latency.isNotNull(), line).otherwise(fill(config.INSIGHT_UPLOAD, processing_ms, ties_up=True))
    target = fill(config.INSIGHT_TARGET, F.when(met, "Yes").otherwise("No"))
    found = F.when(F.size(shown) > 0, F.transform(shown, insight_line)).otherwise(F.array(F.lit(config.INSIGHT_QUIET)))
    return F.concat(F.array(first, target), found)


def copy_text(summary: Column | str, lines: Column | str) -> Column:
    return F.array_join(F.concat(F.array(col(summary)), col(lines)), "\n\n")


# Display style by status.
STATUS_STYLES = {"Normal": "calm", "Monitoring": "watch", "ALERT": "alarm"}


def status_style(status: Column | str) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in STATUS_STYLES.items() for x in kv)), col(status))
