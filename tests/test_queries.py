"""Each query against its SQL on the smallest tables, and known counts."""

from collections import Counter

import duckdb
import pytest

from tidemark.plans import queries as Q
from tidemark.plans.oracles import ORACLES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
KINDS = {"bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("query", [q for q in Q.QUERIES if q.__name__ in ORACLES], ids=lambda q: q.__name__)
def test_query_equals_sql(spark, duck, query):
    df = query(spark, SF)
    names = sorted(df.columns)
    result = duck.execute(ORACLES[query.__name__])
    described = {d[0]: str(d[1]) for d in result.description}
    rows = result.fetchall()
    order = list(described)
    assert sorted(order) == names
    assert {c: KINDS[t] for c, t in df.dtypes} == described
    got = sorted((tuple(r) for r in df.select(names).collect()), key=str)
    assert got == sorted((tuple(r[order.index(c)] for c in names) for r in rows), key=str)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= {q.__name__ for q in Q.QUERIES}


@pytest.mark.parametrize(
    ("query", "sf", "counts"),
    [
        (Q.clip_incidents, "sf0.001", (1, 6, 8)),
        (Q.clip_incidents, "sf0.01", (29, 53, 68)),
        (Q.window_incidents, "sf0.001", (26, 33, 14)),
        (Q.window_incidents, "sf0.01", (242, 294, 197)),
    ],
)
def test_known_counts(spark, query, sf, counts):
    seen = Counter(r.incident_type for r in query(spark, f"/root/testdata/{sf}").collect())
    assert (seen["shoplifting"], seen["violent_activity"], seen["none"]) == counts


def test_the_model_predicts(spark):
    rows = Q.pose_event_classifier(spark, SF).collect()
    assert len(rows) == 75 and all(0 <= r.top_confidence <= 1 for r in rows)


def test_predictions_match_plain_arithmetic(spark):
    import numpy as np

    from tidemark.operators import curate
    from tidemark.operators import model as ml

    rows = curate.train_validation(Q._vectors(spark, SF), "vec_id")
    model = ml.train_classifier(rows.where("split = 'train'"), "v", "label")
    index, scaler, net = model.stages[:3]
    got = {r.vec_id: (r.top_event, r.top_confidence) for r in ml.predict(model, rows, "v").collect()}
    held = rows.collect()
    x = (np.array([r.v for r in held]) - scaler.mean.toArray()) / scaler.std.toArray()
    weights, at = net.weights.toArray(), 0
    layers = net.getLayers()
    for k, (a, b) in enumerate(zip(layers, layers[1:])):
        w = weights[at : at + a * b].reshape(b, a, order="F").T
        x = x @ w + weights[at + a * b : at + (a + 1) * b]
        at += (a + 1) * b
        x = 1 / (1 + np.exp(-x)) if k < len(layers) - 2 else np.exp(x - x.max(1, keepdims=True)) / np.exp(x - x.max(1, keepdims=True)).sum(1, keepdims=True)
    for r, p in zip(held, x):
        top, confidence = got[r.vec_id]
        assert confidence == pytest.approx(p.max(), abs=1e-9) and p[index.labels.index(top)] == pytest.approx(p.max(), abs=1e-9)


def test_the_model_learns_what_can_be_learned(spark, tmp_path):
    from pyspark.sql import functions as F

    from tidemark.operators import model as ml

    far = spark.range(200).select("id", F.array(*((F.col("id") % 4 == k).cast("double") + F.rand(k) * 0.2 for k in range(4))).alias("v"), F.concat(F.lit("c"), (F.col("id") % 4).cast("string")).alias("label")).cache()
    model = ml.train_classifier(far, "v", "label", hidden=(8,), epochs=60)
    ml.save_model(model, str(tmp_path / "m"))
    out = ml.predict(ml.load_model(str(tmp_path / "m")), far, "v")
    r = ml.accuracy(out, "label").first()
    assert r.n == 200 and r.right >= 190
    assert sorted(out.first().event_probs) == ["c0", "c1", "c2", "c3"]
    assert ml.load_model(str(tmp_path / "nothing")) is None and ml.labels_file(str(tmp_path / "nothing")) is None


def test_streams_over_files_in_no_order(spark, tmp_path, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(Q, "STRETCHES", 2)  # five of them are held against SQL

    events = spark.read.parquet(f"{SF}/events.parquet")
    events.repartition(3, F.hash("event_id")).sortWithinPartitions(F.desc("ts")).write.parquet(str(tmp_path / "events.parquet"))
    rows = lambda q, sf: sorted(map(tuple, q(spark, sf).collect()))
    for query in (Q.stream_once_each, Q.stream_motion_state, Q.stream_watermark_agg):
        assert rows(query, str(tmp_path)) == rows(query, SF)
