import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import _words, quality

SF = "/root/testdata/sf0.01"


def x_of(*texts):
    return np.concatenate([quality.features(w) for _, _, w in _words.words_of(pa.array(texts, pa.string()), _words.NOT_SPACE, _words.SAME)])


def test_features_are_of_the_text_alone():
    texts = ["a b b", "", None, "Ünï Öde!! A1 | |\n\n", "x" * 40]
    together = x_of(*texts)
    for t, row in zip(texts, together, strict=True):
        assert np.allclose(x_of(t)[0], row)
    f = dict(zip(quality.FEATURES, together[0], strict=True))
    assert np.isclose(f["same_as_before"], 1 / 3) and np.isclose(f["distinct"], 2 / 3) and f["one_byte_words"] == 1
    assert together[1].tolist() == together[2].tolist() == [0] * (len(quality.FEATURES) - 1) + [1]


def test_held_out_accuracy(spark):
    out = quality.op5_quality_classifier(spark, SF)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = out.join(labels, "doc_id").select("doc_id", "held_out", "score", "predicted", "quality").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    test = [r for r in rows if r.held_out]
    assert len(test) > 50
    assert np.mean([r.predicted == r.quality for r in test]) >= 0.97
    assert out.count() == spark.read.parquet(f"{SF}/documents.parquet").count()


def test_held_out_labels_are_not_learned(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    lies = labels.withColumn("quality", F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = quality.train(docs, labels).parameters, quality.train(docs, lies).parameters
    assert all((a[k] == b[k]).all() for k in a)


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, "a b c", 0.3, "k"), (None, None, 0.1, None), (1, "a b c", 0.3, "k"), (2, "", None, "k")], "doc_id long, text string, score double, label string")
    labels = spark.createDataFrame([(1, 1), (1, None), (None, 1), (9, 0)], "doc_id long, quality int")
    out = quality.score(docs, quality.train(docs, labels))
    assert out.count() == 4 and set(out.columns) == {"doc_id", "text", "label", "score"}
    assert all(0 <= r.score <= 1 for r in out.collect())
    nothing = quality.train(docs, labels.limit(0))
    assert {r.score for r in quality.score(docs, nothing).collect()} == {0.5}
    assert quality.score(docs.limit(0), nothing).collect() == []


def test_only_label_1_and_unlabelled_texts_are_learned(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    a, b = quality.train(docs, labels).parameters, quality.train(docs, labels.where("quality = 1")).parameters
    assert all((a[k] == b[k]).all() for k in a)
    rows = quality.score(docs, quality.train(docs, labels.where("quality = 1"))).join(labels, "doc_id").where(quality.held_out(F.col("doc_id"))).collect()
    assert np.mean([(r.score >= 0.7) == (r.quality == 1) for r in rows]) >= 0.97
    # documents without a label are in U
    some = quality.train(docs.join(labels, "doc_id", "left_semi"), labels).parameters
    assert any((a[k] != some[k]).any() for k in a)


def test_class_prior_from_positives_and_unlabelled():
    rng = np.random.default_rng(3)
    for share in (0.3, 0.86):
        p = rng.normal(2, 1, (2000, 3))
        n = rng.normal(-2, 1, (4000, 3))
        u = np.where(rng.random((4000, 1)) < share, rng.normal(2, 1, (4000, 3)), n)
        z, is_p = np.concatenate([p, u]), np.arange(6000) < 2000
        assert abs(quality.class_prior(z, is_p, ~is_p, rng.random(6000) < 0.5) - share) < 0.04


def plain_risk(logits, positive, unlabelled, prior):
    """R+(P) times the prior, and R-(U) less prior times R-(P), by the formula."""
    loss = lambda x, sign: math.log1p(math.exp(-sign * x))
    mean = lambda xs: sum(xs) / len(xs)
    p = [x for x, m in zip(logits, positive, strict=True) if m]
    u = [x for x, m in zip(logits, unlabelled, strict=True) if m]
    return prior * mean([loss(x, 1) for x in p]), mean([loss(x, -1) for x in u]) - prior * mean([loss(x, -1) for x in p])


@pytest.mark.parametrize(("prior", "fires"), [(0.4, False), (0.95, True)])
def test_step_is_the_gradient_of_the_non_negative_risk(prior, fires):
    rng = np.random.default_rng(5)
    positive, unlabelled = np.arange(30) < 12, np.arange(30) >= 8  # four rows are in both
    logits = np.where(positive, 3.0, -2.0 if fires else 0.5) + rng.normal(0, 0.1, 30)
    of_p, of_u = quality._share(positive), quality._share(unlabelled)
    step, went_against = quality.risk_slope(logits, of_p, of_u, prior)
    plus, minus = plain_risk(logits, positive, unlabelled, prior)
    assert went_against == fires == (minus < 0)
    for k in range(30):
        up, down = logits.copy(), logits.copy()
        up[k] += 1e-5
        down[k] -= 1e-5
        (a, b), (c, d) = plain_risk(up, positive, unlabelled, prior), plain_risk(down, positive, unlabelled, prior)
        slope = -(b - d) / 2e-5 if fires else (a + b - c - d) / 2e-5
        assert math.isclose(step[k], slope, abs_tol=1e-6)


def test_the_clip_fires_while_fitting(spark, monkeypatch):
    seen = []
    real = quality.risk_slope
    monkeypatch.setattr(quality, "risk_slope", lambda *a: seen.append(real(*a)[1]) or real(*a))
    quality.train(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    assert any(seen) and not all(seen)


def test_labels_0_are_never_read(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    unknown = labels.withColumn("quality", F.when(F.col("quality") == 1, 1))
    a, b = quality.train(docs, labels).parameters, quality.train(docs, unknown).parameters
    assert all((a[k] == b[k]).all() for k in a)


def test_scores_match_plain_python(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    model = quality.train(docs, spark.read.parquet("/root/testdata/sf0.001/labels.parquet"))
    p = model.parameters
    for r in quality.score(docs, model).collect():
        z = [max(-8, min(8, (x - m) / s)) for x, m, s in zip(plain_features(r.text or ""), p["mean"], p["scale"], strict=True)]
        hidden = [max(0, sum(v * w[k] for v, w in zip(z, p["w1"], strict=True)) + p["b1"][k]) for k in range(len(p["b1"]))]
        logit = sum(h * w for h, w in zip(hidden, p["w2"], strict=True)) + p["b2"][0]
        assert math.isclose(r.score, 1 / (1 + math.exp(-max(-40, min(40, logit)))), abs_tol=1e-9)


def plain_features(text):
    raw = text.encode()
    words = re.findall(rb"[^\x20\x09-\x0D]+", raw)
    if not words:
        return [0.0] * (len(quality.FEATURES) - 1) + [1.0]
    count = lambda chars: sum(raw.count(bytes([c])) for c in chars)
    upper, lower, digits, stops = (bytes(range(a, b)) for a, b in ((65, 91), (97, 123), (48, 58), (0, 0)))
    stops = b".,;:'\"?-()"
    symbols = bytes(c for c in range(33, 127) if c not in upper + lower + digits + stops)
    n, pairs = len(words), list(zip(words, words[1:], strict=False))
    return [
        math.log1p(n), sum(map(len, words)) / n, sum(len(w) > 15 for w in words) / n, sum(len(w) == 1 for w in words) / n,
        count(upper) / max(1, count(upper) + count(lower)), count(digits) / len(raw), count(stops) / n, count(symbols) / n, sum(c >= 128 for c in raw) / len(raw), raw.count(b"\n") / n,
        sum(a == b for a, b in pairs) / n, len(set(words)) / n, 1 - len(set(pairs)) / max(1, len(pairs)), sum(w[0] in upper for w in words) / n, sum(w[-1] in symbols for w in words) / n, 0.0,
    ]


def test_very_long_text_and_repeated_labelled_rows(spark):
    docs = spark.createDataFrame([(1, "a b c. " * 1_500_000)] + [(3, "the same text")] * 500 + [(4, "x" * 5_000_000)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (3, 1)], "doc_id long, quality int")
    out = quality.score(docs, quality.train(docs, labels, sample=50)).collect()
    assert len(out) == 502 and all(0 <= r.score <= 1 for r in out)


def test_columns_in_any_case_stay(spark):
    rows = [(k, f"some words of text {k}", "mine", 1.5) for k in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, Text string, Score string, SCORE_ double")
    got = quality.keep_good(docs, quality.Model(None), accept=0.5)
    assert got.columns == docs.columns and sorted(map(tuple, got.collect())) == rows
    assert quality.score(docs, quality.Model(None)).columns == ["doc_id", "Text", "SCORE_", "score"]
