"""Asking a language model about clips, after the gate that keeps calls few."""

from __future__ import annotations

import json
import time
import urllib.request
from collections import deque
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.config import Settings
from tidemark.functions.llm_json import HOSTED_EVIDENCE, LOCAL_EVIDENCE, first_reply, parse_replies
from tidemark.functions.text import prompt, refine_prompt
from tidemark.operators.classify import incident


def http_generate(endpoint: str, model: str, timeout: float = 15.0, temperature: float = 0.1) -> Callable[[str], str]:
    """A client of a generate endpoint that answers {"response": text}."""

    def ask(text: str) -> str:
        body = json.dumps({"model": model, "prompt": text, "stream": False, "options": {"temperature": temperature}}).encode()
        request = urllib.request.Request(endpoint, body, {"Content-Type": "application/json"}, method="POST")
        with urllib.request.urlopen(request, timeout=timeout) as reply:
            return str(json.load(reply).get("response", "")).strip()

    return ask


def http_hosted(endpoint: str, key: str, timeout: float = 15.0, temperature: float = 0.1) -> Callable[[str], str]:
    """A client of a hosted content endpoint: parts of text in, candidates with parts of text out."""

    def ask(text: str) -> str:
        body = json.dumps({"contents": [{"parts": [{"text": text}]}], "generationConfig": {"temperature": temperature}}).encode()
        request = urllib.request.Request(endpoint, body, {"Content-Type": "application/json", "x-goog-api-key": key}, method="POST")
        with urllib.request.urlopen(request, timeout=timeout) as reply:
            found = json.load(reply).get("candidates") or [{}]
            return "".join(str(part.get("text", "")) for part in found[0].get("content", {}).get("parts", []))

    return ask


@dataclass(frozen=True)
class Calls:
    """How a task calls a model: calls in flight, tries for each, the first pause between them (it doubles), and seconds for all of a partition's."""

    in_flight: int = 8
    tries: int = 3
    pause: float = 0.5
    deadline: float = 3600.0


def answers(texts: Iterator[str], client: Callable[[str], str], calls: Calls) -> Iterator[str]:
    """The reply to each text, in order, with at most in_flight calls at once and as many texts read ahead.

    A call that fails is tried again after a pause; after its last try, or past the
    deadline, the reply is empty.
    """
    end = time.monotonic() + calls.deadline

    def one(text: str) -> str:
        for k in range(calls.tries):
            if time.monotonic() >= end:
                return ""
            try:
                return client(text)
            except Exception:  # noqa: BLE001 - the model is optional
                if k < calls.tries - 1:
                    time.sleep(max(0.0, min(calls.pause * 2**k, end - time.monotonic())))
        return ""

    with ThreadPoolExecutor(calls.in_flight) as pool:
        waiting: deque = deque()
        for text in texts:
            waiting.append(pool.submit(one, text))
            if len(waiting) >= calls.in_flight:
                yield waiting.popleft().result()
        while waiting:
            yield waiting.popleft().result()


def ask_model(rows: DataFrame, key: str, text: str, client: Callable[[str], str], calls: Calls = Calls()) -> DataFrame:  # noqa: B008 - it is frozen
    """(key, reply) for each row; a failed call is an empty reply. Filter rows before: Spark won't move a filter below this."""
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keys: deque = deque()

        def texts() -> Iterator[str]:
            for batch in batches:
                keys.extend(batch[key])
                yield from batch[text]

        done: list[str] = []
        for reply in answers(texts(), client, calls):
            done.append(reply)
            if len(done) >= 256:
                yield pd.DataFrame({key: [keys.popleft() for _ in done], "reply": done})
                done = []
        if done:
            yield pd.DataFrame({key: [keys.popleft() for _ in done], "reply": done})

    return rows.select(key, text).mapInPandas(run, f"`{key}` {kind}, reply string")


def model_evidence(rows: DataFrame, key: str, summary: str, client: Callable[[str], str] | None) -> DataFrame | None:
    """(key, llm_evidence, llm_action) of gated rows, or None without a client."""
    if client is None:
        return None
    asked = rows.withColumn("_prompt", prompt(summary, "local"))
    replies = ask_model(asked, key, "_prompt", client)
    return first_reply(parse_replies(replies, key, "reply", strip=False, default_evidence=LOCAL_EVIDENCE), key)


def hosted_incidents(rows: DataFrame, key: str, summary: str, client: Callable[[str], str] | None) -> DataFrame | None:
    """(key, incident fields) that a hosted model finds in clips' summaries, without the stripped types; None without a client."""
    if client is None:
        return None
    replies = ask_model(rows.withColumn("_prompt", prompt(summary, "hosted")), key, "_prompt", client)
    return parse_replies(replies, key, "reply", strip=True, default_evidence=HOSTED_EVIDENCE)


#: Seconds that a refining call may take.
REFINE_TIMEOUT = 8.0


def refined(baseline: DataFrame, clips: DataFrame, key: str, signals: Column, client: Callable[[str], str] | None) -> DataFrame:
    """The baseline's incidents (key, incident fields), replaced where a model that sees them and the clip's signals gives any.

    A clip without incidents is asked about too, with an empty list; a failed call, an
    unreadable reply or an empty one leaves the baseline.
    """
    if client is None:
        return baseline
    lists = baseline.groupBy(key).agg(F.sort_array(F.collect_list(incident())).alias("_baseline"))
    empty = F.array().cast(lists.schema["_baseline"].dataType)
    asked = clips.join(lists, key, "left").withColumn("_prompt", refine_prompt(signals, F.coalesce("_baseline", empty)))
    replies = parse_replies(ask_model(asked, key, "_prompt", client), key, "reply", strip=False, default_evidence=LOCAL_EVIDENCE)
    return refine(baseline, replies, key)


def refine_client_of(settings: Settings) -> Callable[[str], str] | None:
    return http_generate(settings.llm_endpoint, settings.llm_model, REFINE_TIMEOUT) if settings.llm_available() else None


def hosted_client_of(settings: Settings) -> Callable[[str], str] | None:
    """The hosted model's client, where it is named, has a key, and the session may go online."""
    there = settings.hosted_endpoint and settings.hosted_key and not settings.offline_mode
    return http_hosted(settings.hosted_endpoint, settings.hosted_key) if there else None


def client_of(settings: Settings) -> Callable[[str], str] | None:
    return http_generate(settings.llm_endpoint, settings.llm_model) if settings.llm_available() else None


def refine(baseline: DataFrame, replies: DataFrame, key: str) -> DataFrame:
    """The model's incidents where it gave any, else the baseline's; both have (key, incident fields)."""
    columns = [key, "incident_type", "confidence", "timestamp_seconds", "evidence", "recommended_action"]
    own = replies.select(columns)
    return own.unionByName(baseline.select(columns).join(own.select(key).distinct(), key, "left_anti"))
