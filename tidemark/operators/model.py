"""A classifier over window vectors: pyspark.ml for training, batched prediction for any model."""

from __future__ import annotations

import json
import os
from collections.abc import Callable

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import MultilayerPerceptronClassifier
from pyspark.ml.feature import IndexToString, StandardScaler, StringIndexer
from pyspark.ml.functions import array_to_vector, predict_batch_udf, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType


def train_classifier(train: DataFrame, features: str, label: str, hidden: tuple[int, ...] = (64,), epochs: int = 25, seed: int = 42) -> PipelineModel:
    """Scaled features through a perceptron with a softmax; labels are text, indexed in order of their names."""
    rows = train.select(array_to_vector(F.transform(features, lambda x: x.cast("double"))).alias("_raw"), F.col(label).cast("string").alias("_label"))
    width = len(rows.first()._raw)
    index = StringIndexer(inputCol="_label", outputCol="_y", stringOrderType="alphabetAsc", handleInvalid="skip").fit(rows)
    layers = [width, *hidden, max(2, len(index.labels))]
    stages = [
        index,
        StandardScaler(inputCol="_raw", outputCol="_x", withMean=True),
        MultilayerPerceptronClassifier(featuresCol="_x", labelCol="_y", layers=layers, maxIter=epochs, seed=seed, probabilityCol="_p", predictionCol="_k", rawPredictionCol="_s"),
        IndexToString(inputCol="_k", outputCol="top_event", labels=index.labels),
    ]
    return Pipeline(stages=stages).fit(rows)


def predict(model: PipelineModel, rows: DataFrame, features: str) -> DataFrame:
    """rows with event_probs (label to probability), top_event and top_confidence."""
    labels = model.stages[0].labels
    ready = rows.withColumn("_raw", array_to_vector(F.transform(features, lambda x: x.cast("double")))).withColumn("_label", F.lit(labels[0]))
    out = model.transform(ready).withColumn("_p", vector_to_array("_p"))
    probabilities = F.map_from_arrays(F.array(*(F.lit(x) for x in labels)), F.slice("_p", 1, len(labels)))
    out = out.withColumns({"event_probs": probabilities, "top_confidence": F.array_max("_p")})
    return out.drop("_raw", "_label", "_y", "_x", "_p", "_k", "_s")


def accuracy(predicted: DataFrame, label: str) -> DataFrame:
    right = (F.col("top_event") == F.col(label).cast("string")).cast("int")
    return predicted.agg(F.count("*").alias("n"), F.sum(right).cast("long").alias("right"))


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel | None:
    """The model, or None where there is none or it can't be read."""
    try:
        return PipelineModel.load(path)
    except Exception:  # noqa: BLE001 - a missing model isn't fatal
        return None


def batch_model_udf(load: Callable[[], Callable], shape: list[int], batch_size: int = 256):
    """A column function of float arrays, each a tensor of `shape`, for any model: load runs once in each worker and returns arrays to arrays."""
    return predict_batch_udf(load, return_type=ArrayType(FloatType()), batch_size=batch_size, input_tensor_shapes=[shape])


def labels_file(path: str) -> list[str] | None:
    """A JSON list of labels, or None."""
    if not os.path.exists(path):
        return None
    with open(path, encoding="utf-8") as f:
        return [str(x) for x in json.load(f)]
