"""Quality classifier by positive-unlabelled learning.

Trusted positives are documents labelled 1; the unlabelled texts are a sample of all
documents, labelled or not, by a hash of their ids. No other label is read. The class
prior, the share of positives among the unlabelled, is estimated from the two sets
(best bin estimation, Garg et al., 2021): networks that tell P from U, each scoring the
half that it wasn't fitted on, put them in order; above a cut that holds positives
alone, U's share over P's share is the prior. A small network over features of the
text alone minimises the non-negative unbiased risk

    prior * R+(P) + max(0, R-(U) - prior * R-(P))

with logistic losses, so its output estimates the probability of label 1. Where the
second term falls below zero, the step goes against it, as the estimator's authors
(Kiryo et al., 2017) do. Fitting sees at most `SAMPLE` positives, the ones with the
least hashes of their ids, and about `SAMPLE` unlabelled texts; held-out documents are
in neither. Scoring reads every whole text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm import _words
from tidemark.llm._spark import column_index, new_name, table

#: Positive rows that a model is fitted on, at most, and the unlabelled rows that the hash sample aims at.
SAMPLE = 20_000
#: Steps of the networks behind the class prior, and how often its bound may fail.
PRIOR_EPOCHS, PRIOR_DELTA = 100, 0.1
HIDDEN, EPOCHS, RATE, DECAY = 24, 400, 0.02, 1e-4

_UPPER = np.zeros(256, np.float32)
_UPPER[0x41:0x5B] = 1
_LOWER = np.zeros(256, np.float32)
_LOWER[0x61:0x7B] = 1
_DIGIT = np.zeros(256, np.float32)
_DIGIT[0x30:0x3A] = 1
_STOPS = np.zeros(256, np.float32)
_STOPS[[ord(c) for c in ".,;:'\"?-()"]] = 1
_SYMBOL = np.zeros(256, np.float32)
_SYMBOL[0x21:0x7F] = 1
_SYMBOL -= _UPPER + _LOWER + _DIGIT + _STOPS
_SYMBOL[0x80:] = 0
_LINE = np.zeros(256, np.float32)
_LINE[0x0A] = 1
_WIDE = np.zeros(256, np.float32)
_WIDE[0x80:] = 1

FEATURES = ("words", "word_bytes", "long_words", "one_byte_words", "upper", "digit", "stops", "symbol", "wide", "lines", "same_as_before", "distinct", "repeated_pairs", "capital_words", "symbol_words", "empty")


def _by_doc(w: _words.Words, weights: np.ndarray) -> np.ndarray:
    return np.bincount(w.doc, weights=weights, minlength=len(w.starts))


def _distinct(doc: np.ndarray, h: np.ndarray, n: int) -> np.ndarray:
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return np.bincount(doc[new], minlength=n)


def features(w: _words.Words) -> np.ndarray:
    """One row of FEATURES for each document; an empty text has zeros and `empty`."""
    docs = len(w.starts)
    size = np.maximum(w.ends - w.starts, 1)
    full = np.flatnonzero(w.ends > w.starts)

    def bytes_in(table: np.ndarray) -> np.ndarray:
        out = np.zeros(docs)
        if len(full):
            out[full] = np.add.reduceat(table[w.data], w.starts[full])
        return out

    n = np.maximum(w.count, 1)
    length = (w.end - w.begin).astype(np.float64)
    first, last = (w.data[w.begin], w.data[w.end - 1]) if len(w.begin) else (np.zeros(0, np.uint8),) * 2
    same = np.zeros(len(w.hash), bool)
    same[1:] = (w.hash[1:] == w.hash[:-1]) & (w.doc[1:] == w.doc[:-1])
    pairs = np.flatnonzero(w.room() >= 2) if len(w.doc) else np.zeros(0, np.int64)
    n_pairs = np.bincount(w.doc[pairs], minlength=docs) if len(pairs) else np.zeros(docs)
    distinct_pairs = _distinct(w.doc[pairs], _words.rolling(w.hash, 2)[pairs], docs) if len(pairs) else np.zeros(docs)
    letters = np.maximum(bytes_in(_UPPER) + bytes_in(_LOWER), 1)
    columns = [
        np.log1p(w.count),
        _by_doc(w, length) / n,
        _by_doc(w, length > 15) / n,
        _by_doc(w, length == 1) / n,
        bytes_in(_UPPER) / letters,
        bytes_in(_DIGIT) / size,
        bytes_in(_STOPS) / n,
        bytes_in(_SYMBOL) / n,
        bytes_in(_WIDE) / size,
        bytes_in(_LINE) / n,
        _by_doc(w, same) / n,
        _distinct(w.doc, w.hash, docs) / n,
        1 - distinct_pairs / np.maximum(n_pairs, 1),
        _by_doc(w, _UPPER[first]) / n,
        _by_doc(w, _SYMBOL[last]) / n,
        w.count == 0,
    ]
    out = np.stack([np.asarray(c, np.float64) for c in columns], 1)
    out[w.count == 0, :-1] = 0
    return out


# ---- the model


class Model:
    """Standardised features, one hidden layer, one logit. Without parameters every score is 0.5."""

    def __init__(self, parameters: dict[str, np.ndarray] | None):
        self.parameters = parameters

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.parameters is None:
            return np.full(len(x), 0.5)
        p = self.parameters
        z = np.clip((x - p["mean"]) / p["scale"], -8, 8)
        logit = np.maximum(z @ p["w1"] + p["b1"], 0) @ p["w2"] + p["b2"]
        return 1 / (1 + np.exp(-np.clip(logit, -40, 40)))


def _logits(z: np.ndarray, p: dict[str, np.ndarray]) -> np.ndarray:
    return np.maximum(z @ p["w1"] + p["b1"], 0) @ p["w2"] + p["b2"]


def _descend(z: np.ndarray, slope: Callable[[np.ndarray], np.ndarray], epochs: int, seed: int) -> dict[str, np.ndarray]:
    """A network by Adam, slope being the risk's gradient by the logits."""
    rng = np.random.default_rng(seed)
    p = {"w1": rng.normal(0, (2 / z.shape[1]) ** 0.5, (z.shape[1], HIDDEN)), "b1": np.zeros(HIDDEN), "w2": rng.normal(0, HIDDEN**-0.5, HIDDEN), "b2": np.zeros(1)}
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in p.items()}
    for step in range(1, epochs + 1):
        hidden = z @ p["w1"] + p["b1"]
        active = np.maximum(hidden, 0)
        g = slope(active @ p["w2"] + p["b2"])
        back = np.outer(g, p["w2"]) * (hidden > 0)
        grads = {"w2": active.T @ g + DECAY * p["w2"], "b2": np.array([g.sum()]), "w1": z.T @ back + DECAY * p["w1"], "b1": back.sum(0)}
        for k, d in grads.items():
            m, v = moments[k]
            m += 0.1 * (d - m)
            v += 0.001 * (d * d - v)
            p[k] = p[k] - RATE * (1 - step / (epochs + 1)) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
    return p


def _share(of: np.ndarray) -> np.ndarray:
    return of / max(1, of.sum())


def _up(logit: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(logit, -40, 40)))


def class_prior(z: np.ndarray, positive: np.ndarray, unlabelled: np.ndarray, half: np.ndarray, seed: int = 7) -> float:
    """The share of positives among the unlabelled rows, from P and U alone."""
    order = np.zeros(len(z))
    for h in (False, True):
        seen = half != h
        of_p, of_u = _share(positive[seen]), _share(unlabelled[seen])
        order[~seen] = _logits(z[~seen], _descend(z[seen], lambda x: _up(x) * of_u - (1 - _up(x)) * of_p, PRIOR_EPOCHS, seed))
    p, u = np.sort(order[positive]), np.sort(order[unlabelled])
    cuts = np.unique(p)
    p_above = 1 - np.searchsorted(p, cuts) / len(p)
    u_above = 1 - np.searchsorted(u, cuts) / len(u)
    slack = (np.log(4 / PRIOR_DELTA) / 2) ** 0.5 * (len(p) ** -0.5 + len(u) ** -0.5)
    best = np.argmin((u_above + slack) / p_above)
    return float(min(1, u_above[best] / p_above[best]))


def risk_slope(logit: np.ndarray, of_p: np.ndarray, of_u: np.ndarray, prior: float) -> tuple[np.ndarray, bool]:
    """(gradient of a step by the logits, whether the second term was below zero and the step goes against it)."""
    up = _up(logit)
    minus = (np.logaddexp(0, logit) * (of_u - prior * of_p)).sum()
    # gradients of the losses by the logit: -(1 - up) for label 1, up for label 0
    g_minus = up * (of_u - prior * of_p)
    return (-(1 - up) * prior * of_p + g_minus, False) if minus >= 0 else (-g_minus, True)


def fit(x: np.ndarray, positive: np.ndarray, unlabelled: np.ndarray, half: np.ndarray, seed: int = 7) -> Model:
    """Non-negative unbiased risk over the rows of x that are in P, in U or in both; half splits them for the class prior."""
    if not positive.any() or not unlabelled.any():
        return Model(None)
    mean, scale = x[unlabelled].mean(0), x[unlabelled].std(0) + 1e-6
    z = np.clip((x - mean) / scale, -8, 8)
    prior = class_prior(z, positive, unlabelled, half, seed)
    of_p, of_u = _share(positive), _share(unlabelled)
    return Model(_descend(z, lambda logit: risk_slope(logit, of_p, of_u, prior)[0], EPOCHS, seed) | {"mean": mean, "scale": scale})


# ---- on tables


def held_out(doc_id: Column) -> Column:
    """Rows whose label is never learned: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, w in _words.words_of(batch.column("text"), _words.NOT_SPACE, _words.SAME):
            x = features(w)
            rows = pa.ListArray.from_arrays(pa.array(np.arange(hi - lo + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))
            yield pa.record_batch([*(batch.column(c).slice(lo, hi - lo) for c in ("p", "u", "half", "key")), rows], ["p", "u", "half", "key", "x"])


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE) -> Model:
    """Fit on at most `sample` documents labelled 1 and a hash sample of about `sample` documents, whatever their label; none is held out.

    Rows without an id, labels that are null or repeated and labels of no document are
    not learned from. Rows that share an id and a text count once, and never more than
    four times `sample` rows reach the driver, as features: those of the least hashes.
    Without a positive or without documents every score is 0.5.
    """
    marked = labels.where((F.col(label) == 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select(F.col("doc_id").cast("long").alias("_id")).distinct()
    chosen = marked.orderBy(F.xxhash64("_id"), "_id").limit(sample).withColumn("p", F.lit(True))
    open_docs = docs.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select(F.col("doc_id").cast("long").alias("_id"), F.col("text").cast("string").alias("text"))
    every = max(1, open_docs.count())
    draw = F.pmod(F.xxhash64(F.lit("unlabelled"), "_id"), F.lit(every).cast("long")) < sample
    rows = open_docs.join(F.broadcast(chosen), "_id", "left").select(F.coalesce("p", F.lit(False)).alias("p"), draw.alias("u"), (F.xxhash64(F.lit("half"), "_id") < 0).alias("half"), F.xxhash64("_id", "text").alias("key"), "text").where("p or u")
    rows = rows.mapInArrow(_feature_rows, "p boolean, u boolean, half boolean, key long, x array<double>").dropDuplicates(["key"])
    rows = rows.orderBy("key").limit(4 * sample).toArrow()
    if not len(rows):
        return Model(None)
    x = np.array(rows["x"].combine_chunks().flatten()).reshape(len(rows), len(FEATURES))
    p, u, half = (rows[c].to_numpy() for c in ("p", "u", "half"))
    order = np.lexsort((*x.T, half, u, p))  # the same model whatever the order of tasks
    return fit(x[order], p[order], u[order], half[order])


def score(docs: DataFrame, model: Model, column: str = "score") -> DataFrame:
    """docs with a column of scores, in place of one of that name.

    All rows and other columns stay, null ids and repeated rows too; null and empty texts
    are scored as empty texts, very long ones whole, in one task; an empty table stays empty.
    The text's column may be spelled in any case.
    """
    docs, at = docs.drop(column), column_index(docs.drop(column), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [model.scores(features(w)) for _, _, w in _words.words_of(batch.column(at), _words.NOT_SPACE, _words.SAME)]
            scores = np.concatenate(parts) if parts else np.zeros(0)
            yield pa.record_batch([*batch.columns, pa.array(scores)], [*batch.schema.names, column])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(column, T.DoubleType())]))


#: Scores from here on are label 1.
ACCEPT = 0.7


def keep_good(docs: DataFrame, model: Model, accept: float = ACCEPT) -> DataFrame:
    """The rows of docs with a score of `accept` and more, with all their columns, whatever these are called."""
    name = new_name(docs, "score")
    return score(docs, model, name).where(F.col(name) >= accept).select(docs.columns)


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= ACCEPT, 1).otherwise(0).alias("predicted"))
