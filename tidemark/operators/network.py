"""The window classifier: a small convolutional network, fitted and applied on the executors.

Two convolutions of 64 channels over three frames, a maximum of two, one of 128, the mean
over time, 128 units, dropout and a softmax. Fitting reads all windows: they are kept as
blocks of arrays on the executors, each step sends the parameters out and sums up the
gradients of its batch in a tree, and the driver holds parameters and their moments
alone. Prediction reads all rows, in Arrow batches.
"""

from __future__ import annotations

import io
import json
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

#: Rows of a block, and batches of an epoch over a table: a batch is that share of its rows, whatever their number.
BLOCK_ROWS, STEPS = 4096, 10
#: Windows whose gradients are computed at once, so that their arrays stay in a processor's cache.
GRADIENT_ROWS = 64
# Channels, units, dropout, learning rate, batch, epochs and patience.
CHANNELS, UNITS, DROPOUT, RATE, BATCH, EPOCHS, PATIENCE = (64, 64, 128), 128, 0.2, 1e-3, 64, 25, 5


def _around(x: np.ndarray) -> np.ndarray:
    """Each frame with the ones before and after it, zeros beyond the ends."""
    padded = np.pad(x, ((0, 0), (1, 1), (0, 0)))
    return np.concatenate([padded[:, :-2], padded[:, 1:-1], padded[:, 2:]], 2)


def _gathered(g: np.ndarray) -> np.ndarray:
    """The gradient of `_around`'s input."""
    before, own, after = np.split(g, 3, 2)
    out = own.copy()
    out[:, :-1] += before[:, 1:]
    out[:, 1:] += after[:, :-1]
    return out


class Network:
    """Parameters and labels; windows are (n, frames, features) floats."""

    def __init__(self, parameters: dict[str, np.ndarray], labels: list[str]):
        self.parameters, self.labels = parameters, labels

    @classmethod
    def fresh(cls, features: int, labels: list[str], seed: int = 42) -> Network:
        rng = np.random.default_rng(seed)
        sizes = {"c1": (3 * features, CHANNELS[0]), "c2": (3 * CHANNELS[0], CHANNELS[1]), "c3": (3 * CHANNELS[1], CHANNELS[2]), "d1": (CHANNELS[2], UNITS), "d2": (UNITS, len(labels))}
        p: dict[str, np.ndarray] = {}
        for name, (a, b) in sizes.items():
            limit = (6 / (a + b)) ** 0.5
            p[name], p[f"{name}b"] = rng.uniform(-limit, limit, (a, b)).astype(np.float32), np.zeros(b, np.float32)
        return cls(p, labels)

    def _forward(self, x: np.ndarray, drop: np.ndarray | None = None) -> dict[str, np.ndarray]:
        p, s = self.parameters, {}
        s["x1"] = _around(x.astype(p["c1"].dtype))
        s["y1"] = np.maximum(s["x1"] @ p["c1"] + p["c1b"], 0)
        s["x2"] = _around(s["y1"])
        s["y2"] = np.maximum(s["x2"] @ p["c2"] + p["c2b"], 0)
        half = s["y2"].shape[1] // 2
        s["pairs"] = s["y2"][:, : 2 * half].reshape(len(x), half, 2, -1)
        s["x3"] = _around(s["pairs"].max(2))
        s["y3"] = np.maximum(s["x3"] @ p["c3"] + p["c3b"], 0)
        s["x4"] = s["y3"].mean(1)
        s["y4"] = np.maximum(s["x4"] @ p["d1"] + p["d1b"], 0)
        s["x5"] = s["y4"] if drop is None else s["y4"] * drop
        z = s["x5"] @ p["d2"] + p["d2b"]
        z = np.exp(z - z.max(1, keepdims=True))
        s["out"] = z / z.sum(1, keepdims=True)
        return s

    def predict(self, x: np.ndarray) -> np.ndarray:
        parts = [self._forward(x[k : k + 1024])["out"] for k in range(0, len(x), 1024)]
        return np.concatenate(parts) if parts else np.zeros((0, len(self.labels)), np.float32)

    def gradients(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray, drop: np.ndarray | None = None) -> dict[str, np.ndarray]:
        """Of the mean weighted cross-entropy."""
        p, s, g = self.parameters, self._forward(x, drop), {}

        def layer(name: str, inputs: np.ndarray, d: np.ndarray) -> np.ndarray:
            g[name] = inputs.reshape(-1, inputs.shape[-1]).T @ d.reshape(-1, d.shape[-1])
            g[f"{name}b"] = d.reshape(-1, d.shape[-1]).sum(0)
            return d @ p[name].T

        d = s["out"].copy()
        d[np.arange(len(y)), y] -= 1
        d = layer("d2", s["x5"], d * (weight / len(y)).astype(d.dtype)[:, None])
        d = layer("d1", s["x4"], (d if drop is None else d * drop) * (s["y4"] > 0))
        d = np.repeat(d[:, None] / s["y3"].shape[1], s["y3"].shape[1], 1)
        d = _gathered(layer("c3", s["x3"], d * (s["y3"] > 0)))
        best = s["pairs"].argmax(2)[:, :, None] == np.arange(2)[None, None, :, None]
        back = np.zeros_like(s["y2"])
        back[:, : 2 * d.shape[1]] = (best * d[:, :, None]).reshape(len(x), 2 * d.shape[1], -1)
        d = _gathered(layer("c2", s["x2"], back * (s["y2"] > 0)))
        layer("c1", s["x1"], d * (s["y1"] > 0))
        return g


def class_weights(y: np.ndarray, classes: int) -> np.ndarray:
    """total / (classes * count), a count of 0 becoming 1 before totalling."""
    n = np.maximum(np.bincount(y, minlength=classes), 1).astype(np.float64)
    return n.sum() / (classes * n)


def fit(x: np.ndarray, y: np.ndarray, x_check: np.ndarray, y_check: np.ndarray, labels: list[str], weighted: bool = False, epochs: int = EPOCHS, patience: int = PATIENCE, seed: int = 42) -> Network:
    """Adam over batches; stops once the check rows' accuracy hasn't grown for `patience` epochs, with the best epoch's parameters."""
    if not len(x):
        raise ValueError("no windows to fit on")
    if not len(x_check):
        x_check, y_check = x, y
    net, rng = Network.fresh(x.shape[2], labels, seed), np.random.default_rng(seed)
    weight = class_weights(y, len(labels)) if weighted else np.ones(len(labels))
    moments = fresh_moments(net)
    best, kept, since, step = -1.0, net.parameters, 0, 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for k in range(0, len(x), BATCH):
            at, step = order[k : k + BATCH], step + 1
            drop = (rng.random((len(at), UNITS)) >= DROPOUT).astype(np.float32) / (1 - DROPOUT)
            adam(net, moments, net.gradients(x[at], y[at], weight[y[at]], drop), step)
        right = float((net.predict(x_check).argmax(1) == y_check).mean())
        if right > best:
            best, kept, since = right, dict(net.parameters), 0
        else:
            since += 1
            if since >= patience:
                break
    return Network(kept, labels)


def fresh_moments(net: Network) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    return {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.parameters.items()}


def adam(net: Network, moments: dict[str, tuple[np.ndarray, np.ndarray]], gradients: dict[str, np.ndarray], step: int) -> None:
    """Move the parameters by one step."""
    for name, d in gradients.items():
        m, v = moments[name]
        m += 0.1 * (d - m)
        v += 0.001 * (d * d - v)
        net.parameters[name] = net.parameters[name] - (RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-7)).astype(m.dtype)


# ---- on tables


class Block(NamedTuple):
    """Windows of some rows, their labels' numbers, hashes of both, and whether they are for checking."""

    x: np.ndarray
    y: np.ndarray
    key: np.ndarray
    check: np.ndarray


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _drawn(key: np.ndarray, *more: int) -> np.ndarray:
    """64 bits of each key for some purpose; the same wherever its row lies."""
    for k in more:
        key = _mixed(key + np.uint64((k + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
    return key


def blocks_of(rows: DataFrame, window: str, label: str, labels: list[str]) -> RDD:
    """An RDD of Blocks of the labelled rows, kept on the executors; what is lost of it is made again."""
    held = rows.where(F.col(label).isNotNull()).select(F.flatten(window).cast("array<float>").alias("x"), F.size(window).alias("n"), F.col(label).cast("string").alias("y"), (F.col("split") == "validation").alias("check"))
    held = held.withColumn("key", F.xxhash64("x", "y"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, len(batch), BLOCK_ROWS):
                part = batch.slice(lo, BLOCK_ROWS)
                x = np.asarray(part.column("x").flatten(), np.float32)
                y = np.searchsorted(labels, part.column("y").to_pylist()).astype(np.int64)
                key, check = part.column("key").to_numpy(), part.column("check").to_numpy(zero_copy_only=False)
                yield pa.record_batch([pa.array([v], t) for v, t in ((x.tobytes(), pa.binary()), (part.column("n")[0].as_py(), pa.int32()), (y.tobytes(), pa.binary()), (key.tobytes(), pa.binary()), (check.tobytes(), pa.binary()))], ["x", "n", "y", "key", "check"])

    def unpack(r: Row) -> Block:
        y = np.frombuffer(r.y, np.int64)
        return Block(np.frombuffer(r.x, np.float32).reshape(len(y), r.n, -1), y, np.frombuffer(r.key, np.int64).view(np.uint64), np.frombuffer(r.check, bool))

    return held.mapInArrow(pack, "x binary, n int, y binary, key binary, check binary").rdd.map(unpack).persist(StorageLevel.MEMORY_AND_DISK)


def _added(a: tuple, b: tuple) -> tuple:
    if a[0] is None or b[0] is None:
        return b if a[0] is None else a
    return {k: v + b[0][k] for k, v in a[0].items()}, a[1] + b[1]


def train_network(rows: DataFrame, window: str, label: str, weighted: bool = False, epochs: int = EPOCHS, patience: int = PATIENCE, steps: int = STEPS, seed: int = 42) -> Network:
    """Fit on all rows: windows of one size, a label, and split (train or validation, see `curate.train_validation`).

    An epoch deals the training rows into `steps` batches by hashes of the rows. Dropout
    is drawn by them too. Blocks are computed in single precision and summed in doubles,
    so partitions change a result by rounding alone. It stops once the accuracy over the validation rows (without any,
    over all) hasn't grown for `patience` epochs, with the best epoch's parameters.
    """
    spark = rows.sparkSession
    counts = rows.where(F.col(label).isNotNull()).groupBy(F.col(label).cast("string").alias("y"), F.col("split")).count().collect()  # as many as labels
    labels = sorted({r.y for r in counts})
    n = np.array([sum(r["count"] for r in counts if r.y == c and r.split != "validation") for c in labels], np.int64)
    if not n.sum():
        raise ValueError("no windows to fit on")
    any_check = any(r.split == "validation" for r in counts)
    weight = np.maximum(n, 1).sum() / (len(labels) * np.maximum(n, 1)) if weighted else np.ones(len(labels))
    blocks = blocks_of(rows, window, label, labels)
    try:
        width = blocks.map(lambda b: b.x.shape[2]).first()
        net = Network.fresh(width, labels, seed)
        net.parameters = {k: v.astype(np.float64) for k, v in net.parameters.items()}
        single = lambda: {k: v.astype(np.float32) for k, v in net.parameters.items()}  # noqa: E731 - what blocks are computed with
        moments, best, kept, since, step = fresh_moments(net), -1.0, net.parameters, 0, 0
        for epoch in range(epochs):
            for k in range(steps):
                sent = spark.sparkContext.broadcast(single())

                def of_block(total: tuple, b: Block, sent=sent, epoch=epoch, k=k) -> tuple:
                    mine = np.flatnonzero(~b.check & (_drawn(b.key, seed, epoch) % np.uint64(steps) == k))
                    own = Network(sent.value, labels)
                    for lo in range(0, len(mine), GRADIENT_ROWS):
                        at = mine[lo : lo + GRADIENT_ROWS]
                        units = _drawn(b.key[at, None] + np.arange(UNITS, dtype=np.uint64)[None], seed, epoch, 1)
                        drop = (units >= np.uint64(int(DROPOUT * 2**64))) * np.float32(1 / (1 - DROPOUT))
                        g = own.gradients(b.x[at], b.y[at], weight[b.y[at]], drop)
                        total = _added(total, ({name: d.astype(np.float64) * len(at) for name, d in g.items()}, len(at)))
                    return total

                total, m = blocks.treeAggregate((None, 0), of_block, _added)
                sent.destroy()
                if m:
                    step += 1
                    adam(net, moments, {name: d / m for name, d in total.items()}, step)
            sent = spark.sparkContext.broadcast(single())

            def judged(b: Block, sent=sent) -> tuple[int, int]:
                at = np.flatnonzero(b.check) if any_check else np.arange(len(b.y))
                return int((Network(sent.value, labels).predict(b.x[at]).argmax(1) == b.y[at]).sum()), len(at)

            right, m = blocks.map(judged).treeReduce(lambda a, b: (a[0] + b[0], a[1] + b[1]))
            sent.destroy()
            if right / m > best:
                best, kept, since = right / m, dict(net.parameters), 0
            else:
                since += 1
                if since >= patience:
                    break
    finally:
        blocks.unpersist()
    return Network({k: v.astype(np.float32) for k, v in kept.items()}, labels)


def predict_network(net: Network, rows: DataFrame, window: str) -> DataFrame:
    """rows with event_probs (label to probability), top_event (the first of equals) and top_confidence."""
    width = net.parameters["c1"].shape[0] // 3

    @F.pandas_udf("array<float>")
    def run(x: pd.Series) -> pd.Series:
        return pd.Series(list(net.predict(np.stack(x.to_numpy()).reshape(len(x), -1, width))) if len(x) else [], dtype=object)

    out = rows.withColumn("_p", run(F.flatten(window).cast("array<float>")))
    labels = F.array(*(F.lit(x) for x in net.labels))
    return out.withColumns({
        "event_probs": F.map_from_arrays(labels, F.transform("_p", lambda p: p.cast("double"))),
        "top_confidence": F.array_max("_p").cast("double"),
        "top_event": F.element_at(labels, F.array_position("_p", F.array_max("_p")).cast("int")),
    }).drop("_p")


def save_network(spark: SparkSession, net: Network, path: str) -> None:
    """One row: the parameters as an archive, and the labels as JSON, wherever the path is."""
    body = io.BytesIO()
    np.savez(body, **net.parameters)
    spark.createDataFrame([(bytearray(body.getvalue()), json.dumps(net.labels))], "parameters binary, labels string").coalesce(1).write.mode("overwrite").parquet(path)


def load_network(spark: SparkSession, path: str) -> Network | None:
    """The network, or None where there is none or it can't be read."""
    try:
        row = spark.read.parquet(path).first()
        with np.load(io.BytesIO(bytes(row.parameters)), allow_pickle=False) as data:
            return Network({k: data[k] for k in data.files}, json.loads(row.labels))
    except Exception:  # noqa: BLE001 - a missing model isn't fatal
        return None
