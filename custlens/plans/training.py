"""Fits, evaluates and stores the models of a folder of tables."""

from __future__ import annotations

import json
from dataclasses import dataclass
from datetime import datetime
from functools import reduce

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, functions as F

from custlens.functions.stages import input_version, new_path, stage, written
from custlens.operators import models, runlog
from custlens.operators.metrics import classifier_metrics, regressor_metrics
from custlens.operators.neighbours import distance_vote, nearest_neighbours
from custlens.operators.splits import Scaler, assign_splits, fit_scaler, fitting_rows, in_parallel, model_inputs
from custlens.plans import tables

SPECS = {**models.CHURN_MODELS, **models.CLV_MODELS}

#: The models in production, named by a run log of the past; reports and scoring fit these and no other.
PRODUCTION_CHURN, PRODUCTION_CLV = "churn_gbt_weighted", "clv_ridge"


@dataclass
class Fitted:
    model: object
    path: str
    spec: models.Spec
    target: str


_fitted: dict[tuple, Fitted] = {}
_scalers: dict[tuple, Scaler] = {}


def _key(spark: SparkSession, folder: str, name: str) -> tuple:
    return (spark.sparkContext.applicationId, folder, input_version(spark, folder), name)


def target_of(name: str) -> str:
    return "churn" if name in models.CHURN_MODELS or name == "churn_knn" else "clv_next_90d"


def splits(spark: SparkSession, folder: str, target: str) -> DataFrame:
    return stage(spark, folder, f"split_{target}", lambda: assign_splits(tables.features(spark, folder), target))


def columns(spark: SparkSession, folder: str) -> list[str]:
    return model_inputs(tables.features(spark, folder))


def scaler(spark: SparkSession, folder: str, target: str) -> Scaler:
    key = _key(spark, folder, f"scaler_{target}")
    if key not in _scalers:
        train = splits(spark, folder, target).filter("split = 'train'")
        _scalers[key] = fit_scaler(train, columns(spark, folder))
    return _scalers[key]


def model_rows(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Vectors and labels as the model wants them, written once per kind."""
    spec, target = SPECS[name], target_of(name)
    kind = f"{target}_{'scaled' if spec.scaled else 'plain'}{'_log' if spec.log_target else ''}"

    def build() -> DataFrame:
        rows = splits(spark, folder, target)
        if spec.scaled:
            rows = scaler(spark, folder, target).apply(rows)
        return models.training_rows(rows, columns(spark, folder), target, spec.log_target)

    return stage(spark, folder, f"rows_{kind}", build)


def fitted(spark: SparkSession, folder: str, name: str) -> Fitted:
    """The model, fitted and saved at its first use in the application."""
    key = _key(spark, folder, name)
    if key not in _fitted:
        with fitting_rows(model_rows(spark, folder, name), SPECS[name].partitions) as rows:
            model = models.fit_model(rows, SPECS[name])
        path = new_path(spark, name)
        models.save_model(model, path)
        _fitted[key] = Fitted(model, path, SPECS[name], target_of(name))
    return _fitted[key]


def predictions(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """(customer_id, split, label, probability or prediction) on all rows."""
    f = fitted(spark, folder, name)
    out = f.model.transform(model_rows(spark, folder, name))
    if f.target == "churn":
        return out.select("customer_id", "split", "label", vector_to_array("probability")[1].alias("probability"))
    label = F.expm1("label") if f.spec.log_target else F.col("label")
    return out.select("customer_id", "split", label.alias("label"), "prediction")


def knn_inputs(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Scaled query rows (validation and test) and training rows."""
    names = columns(spark, folder)
    rows = scaler(spark, folder, "churn").apply(splits(spark, folder, "churn")).select(
        F.col("customer_id").alias("id"), "split", F.array(*names).alias("x"), F.col("churn").cast("double").alias("y")
    )
    rows = stage(spark, folder, "knn_rows", lambda: rows)
    queries = rows.filter("split <> 'train'").select(F.col("id").alias("qid"), "split", "x", "y")
    train = rows.filter("split = 'train'").select(F.col("id").alias("tid"), "x", "y")
    return queries, train


def knn_predictions(spark: SparkSession, folder: str) -> DataFrame:
    def build() -> DataFrame:
        queries, train = knn_inputs(spark, folder)
        votes = distance_vote(nearest_neighbours(queries, train))
        return queries.join(votes, "qid").select(
            F.col("qid").alias("customer_id"), "split", F.col("y").alias("label"), "probability"
        )

    return stage(spark, folder, "knn_predictions", build)


def evaluation(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Metrics on validation and test rows, one row each, from the run log."""
    def build() -> DataFrame:
        rows = knn_predictions(spark, folder) if name == "churn_knn" else predictions(spark, folder, name)
        rows = written(rows.filter("split <> 'train'"), "evaluated")
        parts = []
        for part in ("val", "test"):
            chosen = rows.filter(F.col("split") == part)
            measured = (
                classifier_metrics(chosen, "label") if target_of(name) == "churn" else
                regressor_metrics(chosen, "label", is_log=SPECS[name].log_target)
            )
            parts.append(measured.select(F.lit(name).alias("model"), F.lit(part).alias("split"), "*"))
        return parts[0].unionByName(parts[1])

    return stage(spark, folder, f"run_{name}", build)


def run_log(spark: SparkSession, folder: str, target: str, names: tuple[str, ...] = ()) -> DataFrame:
    """Evaluation rows of all models of a target, or of the named ones."""
    every = (*models.CHURN_MODELS, "churn_knn") if target == "churn" else tuple(models.CLV_MODELS)
    names = names or every
    # Shared inputs first, so that the threads do not build them twice.
    columns(spark, folder)
    splits(spark, folder, target)
    for name in names:
        if name in SPECS:
            model_rows(spark, folder, name)
    return reduce(DataFrame.unionByName, in_parallel(lambda n: evaluation(spark, folder, n), names))


def log_runs(
    spark: SparkSession, folder: str, log: str, version: int, trained_at: datetime, target: str, names: tuple[str, ...] = (),
) -> None:
    """Adds the runs of a target's models to the run log in the folder ``log``; the models are stored beside it."""
    for measured in run_log(spark, folder, target, names).filter("split = 'test'").collect():  # one row per model
        name = measured["model"]
        place = f"{log}_models/v{version}"
        if name in SPECS:
            models.save_model(fitted(spark, folder, name).model, f"{place}/{name}")
        rows = spark.createDataFrame([measured.asDict()])
        runlog.append(runlog.run_rows(
            rows, target, version, trained_at, place, parameters_of(spark, folder, name), len(columns(spark, folder))), log)


def parameters_of(spark: SparkSession, folder: str, name: str) -> str:
    """The parameters that a fit was given, as text in order of their names."""
    if name not in SPECS:
        return json.dumps({"neighbours": 15})
    model = fitted(spark, folder, name).model
    given = {p.name: v for p, v in model.extractParamMap().items() if isinstance(v, (int, float, str, bool)) and not p.name.endswith("Col")}
    if hasattr(model, "treeWeights"):
        given["trees"] = len(model.treeWeights)
    return json.dumps(given, sort_keys=True)


def comparison(spark: SparkSession, folder: str, target: str, names: tuple[str, ...] = ()) -> DataFrame:
    """Models by test quality, best first: AUC then recall, or R2."""
    test = run_log(spark, folder, target, names).filter("split = 'test'")
    order = ["roc_auc", "recall"] if target == "churn" else ["r2"]
    return test.orderBy(*[F.desc(c) for c in order], "model")


def picked(spark: SparkSession, folder: str, target: str, names: tuple[str, ...] = ()) -> str:
    """Name of the best model (among ``names``): one row of the small run log."""
    return comparison(spark, folder, target, names).first()["model"]
