"""Churn and lifetime-value model fits with Spark ML."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import SparkContext
from pyspark.ml.classification import (
    DecisionTreeClassifier, GBTClassifier, LogisticRegression, RandomForestClassifier,
)
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.ml.util import DefaultParamsReader
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from custlens.functions.stages import new_path
from custlens.operators.perceptron import fit_perceptron
from custlens.operators.splits import FIT_PARTITIONS, SEED, class_weights
from custlens.operators.trees import TreeEnsemble, load_ensemble

PATIENCE = 30


@dataclass(frozen=True)
class Spec:
    """A model: how to fit it, whether inputs are scaled, weighted or log-targeted."""

    fit: Callable[[DataFrame, DataFrame], object]
    scaled: bool = False
    log_target: bool = False
    partitions: int = FIT_PARTITIONS  # of the training rows; a few hundred for large tables


def best_round(losses: list[float], patience: int = PATIENCE) -> int:
    """Number of rounds up to the lowest validation loss before ``patience`` rounds without a lower one."""
    best = 0
    for i, loss in enumerate(losses):
        if loss < losses[best]:
            best = i
        elif i - best >= patience:
            break
    return best + 1


def first_trees(model, n: int):
    """A boosted model of the first ``n`` trees: what a fit with so many rounds and the same seed gives."""
    if n >= len(model.treeWeights):
        return model
    java, gateway = model._java_obj, SparkContext._gateway
    trees = gateway.new_array(gateway.jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel, n)
    weights = gateway.new_array(gateway.jvm.double, n)
    for i in range(n):
        trees[i], weights[i] = java.trees()[i], java.treeWeights()[i]
    more = [java.numFeatures(), java.numClasses()] if hasattr(model, "numClasses") else [java.numFeatures()]
    return type(model)(_java_class(model)(java.uid(), trees, weights, *more))


def _java_class(model):
    kind = SparkContext._gateway.jvm
    for part in model._java_obj.getClass().getName().split("."):
        kind = getattr(kind, part)
    return kind


AUC_BINS = 1 << 14


def auc_by_round(ensemble: TreeEnsemble, rows: DataFrame) -> list[float]:
    """The area under the curve on ``rows`` (features, label) after every round.

    Tasks count rows by round, class and the score's bin; rows in one bin count as equal.
    """
    rounds = len(ensemble.scale)

    def count(batches):
        for pdf in batches:
            margins = np.cumsum(ensemble.outputs(np.stack(pdf["x"])) * ensemble.scale, axis=1)
            bins = np.minimum((AUC_BINS / (1.0 + np.exp(-margins))).astype(np.int64), AUC_BINS - 1)
            keys = (np.arange(rounds) * AUC_BINS + bins) * 2 + pdf["label"].to_numpy().astype(np.int64)[:, None]
            found, n = np.unique(keys, return_counts=True)
            yield pd.DataFrame({"round": found // (2 * AUC_BINS), "bin": found // 2 % AUC_BINS, "positive": found % 2, "n": n})

    counted = rows.select(vector_to_array("features").alias("x"), "label").mapInPandas(count, "round bigint, bin bigint, positive bigint, n bigint")
    bins = counted.groupBy("round", "bin").agg(
        F.sum(F.col("n") * F.col("positive")).alias("p"), F.sum(F.col("n") * (1 - F.col("positive"))).alias("q"))
    below = Window.partitionBy("round").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)  # at most AUC_BINS rows
    ranked = bins.withColumn("below", F.coalesce(F.sum("q").over(below), F.lit(0)))
    areas = ranked.groupBy("round").agg(
        (F.sum(F.col("p") * (F.col("below") + F.col("q") / 2.0)) / (F.sum("p") * F.sum("q"))).alias("auc")).orderBy("round").collect()
    return [r["auc"] if r["auc"] is not None else 0.5 for r in areas]


def _boosted(estimator, train: DataFrame, val: DataFrame, stop: str = "loss"):
    """Boosting with early stopping: one fit with all rounds, cut to those up to the best on the validation rows.

    Spark's own stop has no patience. ``stop`` is "loss" or "auc".
    """
    model = estimator.fit(train)
    if stop == "auc":
        path = new_path(train.sparkSession, "boosted")
        save_model(model, path)
        losses = [-a for a in auc_by_round(load_ensemble(train.sparkSession, model, path), val)]
    else:
        losses = model.evaluateEachIteration(val)
    return first_trees(model, best_round(losses))


def _logistic(train: DataFrame, val: DataFrame):
    # C = 1 on summed losses; Spark averages by the weight sum.
    weight_sum = train.agg(F.sum("weight")).first()[0]
    return LogisticRegression(
        elasticNetParam=0.0, regParam=1.0 / weight_sum, standardization=False, maxIter=1000, weightCol="weight"
    ).fit(train)


def _gbt(weighted: bool, stop: str):
    def fit(train: DataFrame, val: DataFrame):
        options = {"weightCol": "weight"} if weighted else {}
        est = GBTClassifier(
            maxIter=300, stepSize=0.03, maxDepth=4, subsamplingRate=0.8, featureSubsetStrategy="0.8", seed=SEED, **options
        )
        return _boosted(est, train, val, stop)

    return fit


def _network(train: DataFrame, val: DataFrame):
    return fit_perceptron(train, [128, 64, 32], max_iter=80, seed=SEED)


CHURN_MODELS: dict[str, Spec] = {
    "churn_lr": Spec(_logistic, scaled=True),
    "churn_tree": Spec(lambda t, v: DecisionTreeClassifier(
        maxDepth=5, minInstancesPerNode=10, weightCol="weight", seed=SEED).fit(t)),
    "churn_rf": Spec(lambda t, v: RandomForestClassifier(
        numTrees=200, maxDepth=7, minInstancesPerNode=5, weightCol="weight", seed=SEED).fit(t)),
    "churn_gbt": Spec(_gbt(weighted=False, stop="auc")),
    "churn_gbt_weighted": Spec(_gbt(weighted=True, stop="loss")),
    "churn_mlp": Spec(_network, scaled=True),
}


def _ridge(train: DataFrame, val: DataFrame, alpha: float = 100.0):
    # Spark scales the penalty by the label deviation and averages the loss.
    row = train.agg(F.count(F.lit(1)).alias("n"), F.stddev_pop("label").alias("sd")).first()
    return LinearRegression(
        elasticNetParam=0.0, regParam=alpha / row.n * row.sd, standardization=False, solver="normal"
    ).fit(train)


def _gbt_regressor(train: DataFrame, val: DataFrame):
    return GBTRegressor(
        maxIter=250, stepSize=0.03, maxDepth=5, subsamplingRate=0.8, featureSubsetStrategy="0.8", seed=SEED
    ).fit(train)


CLV_MODELS: dict[str, Spec] = {
    "clv_ridge": Spec(_ridge, scaled=True),
    "clv_rf": Spec(lambda t, v: RandomForestRegressor(
        numTrees=150, maxDepth=6, minInstancesPerNode=5, seed=SEED).fit(t)),
    "clv_gbt": Spec(_gbt_regressor),
    "clv_gbt_log": Spec(_gbt_regressor, log_target=True),
}


def training_rows(rows: DataFrame, columns: list[str], target: str, log_target: bool = False) -> DataFrame:
    """(customer_id, split, features, label, weight) ready for a fit."""
    label = F.col(target).cast("double")
    prepared = rows.fillna(0, subset=columns).withColumn("label", F.log1p(label) if log_target else label)
    vectors = VectorAssembler(inputCols=columns, outputCol="features").transform(prepared)
    if target == "churn":
        weights = class_weights(vectors.filter("split = 'train'"), "label").drop("n")
        weighted = vectors.join(F.broadcast(weights), "label", "left")  # one row per class
        return weighted.select("customer_id", "split", "features", "label", "weight")
    return vectors.select("customer_id", "split", "features", "label")


def fit_model(rows: DataFrame, spec: Spec):
    return spec.fit(rows.filter("split = 'train'"), rows.filter("split = 'val'"))


def save_model(model, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(spark: SparkSession, path: str):
    """A saved model of any kind; its class is in the metadata beside it."""
    return DefaultParamsReader.loadParamsInstance(path, spark.sparkContext)


def churn_probability(model, df: DataFrame) -> DataFrame:
    """Adds ``probability`` of churn as a double."""
    names = {"rawPrediction", "prediction", "probability"}
    scored = model.transform(df.drop(*names))
    return scored.withColumn("probability", vector_to_array("probability")[1]).drop("rawPrediction", "prediction")
