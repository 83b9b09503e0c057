import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import network


def toy(n, seed=0):
    rng = np.random.default_rng(seed)
    y = rng.integers(0, 3, n)
    x = rng.normal(0, 1, (n, 32, 5)).astype(np.float32)
    x[np.arange(n), 4 + 10 * y, y] += 6  # a peak whose place and column tell the class
    return x, y


def test_gradients_are_those_of_the_loss():
    x, y = toy(4)
    net = network.Network.fresh(5, ["a", "b", "c"], 3)
    net.parameters = {k: v.astype(np.float64) for k, v in net.parameters.items()}
    weight = np.array([1.0, 2.0, 0.5, 1.5])
    loss = lambda: float(-(weight * np.log(net._forward(x)["out"][np.arange(4), y])).mean())
    got = net.gradients(x, y, weight)
    rng = np.random.default_rng(1)
    for name, value in net.parameters.items():
        for _ in range(4):
            at = tuple(rng.integers(0, n) for n in value.shape)
            old = value[at]
            value[at] = old + 1e-5
            high = loss()
            value[at] = old - 1e-5
            low = loss()
            value[at] = old
            assert got[name][at] == pytest.approx((high - low) / 2e-5, abs=2e-4)


def test_it_learns_and_stops_early():
    x, y = toy(900)
    net = network.fit(x[:700], y[:700], x[700:], y[700:], ["a", "b", "c"], weighted=True, epochs=12)
    assert (net.predict(x[700:]).argmax(1) == y[700:]).mean() > 0.9
    calls = []
    real = network.Network.predict
    try:
        network.Network.predict = lambda self, x: calls.append(1) or np.zeros((len(x), 3))
        network.fit(x[:64], y[:64], x[:64], y[:64], ["a", "b", "c"], patience=2)
    finally:
        network.Network.predict = real
    assert len(calls) == 3
    with pytest.raises(ValueError):
        network.fit(x[:0], y[:0], x, y, ["a"])
    assert network.class_weights(np.array([0, 0, 0, 1]), 3).tolist() == pytest.approx([5 / 9, 5 / 3, 5 / 3])


def test_on_tables(spark, tmp_path):
    x, y = toy(300)
    rows = spark.createDataFrame([(k, a.tolist(), "abc"[b], "validation" if k % 5 == 0 else "train") for k, (a, b) in enumerate(zip(x, y))], "id long, window array<array<float>>, label string, split string")
    net = network.train_network(rows, "window", "label", epochs=8)
    network.save_network(spark, net, str(tmp_path / "n"))
    again = network.load_network(spark, str(tmp_path / "n"))
    assert network.load_network(spark, str(tmp_path / "none")) is None and again.labels == ["a", "b", "c"]
    got = {r.id: r for r in network.predict_network(again, rows, "window").collect()}
    want = net.predict(x)
    for k in range(300):
        assert [got[k].event_probs[c] for c in "abc"] == pytest.approx(want[k].tolist(), abs=1e-5)
        assert got[k].top_event == "abc"[int(want[k].argmax())]
    assert rows.limit(0).transform(lambda d: network.predict_network(net, d, "window")).select(F.size("event_probs")).collect() == []


def test_partitions_change_rounding_alone(spark):
    x, y = toy(120)
    rows = spark.createDataFrame([(k, a.tolist(), "abc"[b], "validation" if k % 5 == 0 else "train") for k, (a, b) in enumerate(zip(x, y))], "id long, window array<array<float>>, label string, split string")
    one, eight = (network.train_network(rows.repartition(p), "window", "label", weighted=True, epochs=2, steps=3) for p in (1, 8))
    for name, value in one.parameters.items():
        assert eight.parameters[name] == pytest.approx(value, abs=1e-4)
    with pytest.raises(ValueError):
        network.train_network(rows.limit(0), "window", "label")


def test_any_model_in_batches(spark):
    from tidemark.operators.model import batch_model_udf

    sums = batch_model_udf(lambda: lambda x: x.sum(2), [2, 3], 2)
    rows = spark.createDataFrame([(k, [float(k)] * 6) for k in range(5)], "k long, v array<float>")
    assert [r.s for r in rows.select("k", sums("v").alias("s")).orderBy("k").collect()] == [[3.0 * k, 3.0 * k] for k in range(5)]


def test_blocks_are_computed_in_single_precision(spark, monkeypatch):
    x, y = toy(40)
    rows = spark.createDataFrame([(k, a.tolist(), "abc"[b], "train") for k, (a, b) in enumerate(zip(x, y))], "id long, window array<array<float>>, label string, split string")
    real, sent = spark.sparkContext.broadcast, []
    monkeypatch.setattr(spark.sparkContext, "broadcast", lambda v: sent.append({p.dtype for p in v.values()}) or real(v))
    network.train_network(rows, "window", "label", epochs=1, steps=1)
    assert sent == [{np.dtype(np.float32)}] * 2
