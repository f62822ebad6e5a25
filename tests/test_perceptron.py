"""The perceptron's own sums of gradients against Spark's fit."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.ml.classification import MultilayerPerceptronClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from custlens.functions.stages import new_path
from custlens.operators import models, perceptron
from custlens.operators.splits import fitting_rows


def rows_of(spark, n, width=5):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(n, width))
    y = (x[:, 0] - x[:, 1] * x[:, 2] + rng.normal(0, 0.5, n) > 0).astype(float)
    df = spark.createDataFrame([(i, [float(v) for v in a], float(b)) for i, (a, b) in enumerate(zip(x, y))], "customer_id long, x array<double>, label double")
    return df.select("customer_id", array_to_vector("x").alias("features"), "label")


def test_fit_is_that_of_spark(spark, monkeypatch):
    monkeypatch.setattr(perceptron, "TASK_ROWS", 100)  # 15 tasks for 8 partitions of rows
    with fitting_rows(rows_of(spark, 1500)) as train:
        for steps in (0, 1, 15):
            got = perceptron.fit_perceptron(train, [6, 4], steps, seed=3)
            want = MultilayerPerceptronClassifier(layers=[5, 6, 4, 2], maxIter=steps, seed=3, blockSize=64).fit(train)
            assert np.allclose(got.weights.toArray(), want.weights.toArray(), atol=1e-7)
        assert got.getMaxIter() == 15 and not got.isSet("initialWeights")
        path = new_path(spark, "perceptron")
        models.save_model(got, path)
        again = models.load_model(spark, path)
        p = [m.transform(train).orderBy("customer_id").select(vector_to_array("probability")[1]).toPandas().to_numpy() for m in (again, want)]
        assert np.allclose(*p, atol=1e-7)


def test_rows_are_dealt_over_more_tasks_than_their_partitions(spark, monkeypatch):
    """The fit's time is its arithmetic: with tasks as many as the partitions of a fit it grew on a cluster of any size."""
    seen = []
    dealt = perceptron.packed

    def packed(*args):
        out = dealt(*args)
        seen.append(out)
        return out

    monkeypatch.setattr(perceptron, "packed", packed)
    with fitting_rows(rows_of(spark, 700), 3) as train:
        models.CHURN_MODELS["churn_mlp"].fit(train.limit(64), train)
        pieces = dealt(train, 5, 2).select(F.length("y") / 8, "share").collect()
    assert len(seen) == 1
    assert sum(n for n, _ in pieces) == 700 and all(share in (1 / 64, 1 / n) for n, share in pieces)


def test_gradient_is_the_slope_of_the_loss():
    rng = np.random.default_rng(0)
    layers = [3, 4, 2]
    w = rng.normal(size=3 * 4 + 4 + 4 * 2 + 2)
    x, y = rng.normal(size=(600, 3)), rng.integers(0, 2, 600)
    sums = perceptron.block_sums(w, layers, x, y, 1 / 64)
    assert sums[-1] == pytest.approx(600 / 64)
    for j in range(len(w)):
        e = np.eye(len(w))[j] * 1e-6
        slope = (perceptron.block_sums(w + e, layers, x, y, 1 / 64)[-2] - perceptron.block_sums(w - e, layers, x, y, 1 / 64)[-2]) / 2e-6
        assert sums[j] == pytest.approx(slope, abs=1e-6)


def test_null_and_unknown_labels_are_errors(spark):
    train = rows_of(spark, 20)
    for label in (None, 2.0):
        with pytest.raises(Exception, match="labels a class|float"):
            perceptron.fit_perceptron(train.withColumn("label", F.when(F.col("customer_id") != 9, F.col("label")).otherwise(F.lit(label))), [3], 2, seed=1)
