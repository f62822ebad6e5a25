"""Stored scoring bundles: all that scoring needs, in one folder that any application can load.

A bundle is a folder ``<bundles>/<version>`` with the fitted models, the personas as a table, and a manifest that names the
inputs in order, the scalers, the cuts and how the value model was fitted. The manifest is written last and never changed, so
a folder without one is a fit that did not end; a version is stored once. Loading needs nothing but the folder.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.ml.feature import PCAModel, VectorAssembler
from pyspark.sql import DataFrame, SparkSession, functions as F

from custlens.functions import files
from custlens.operators import anomaly, models, segments
from custlens.operators.metrics import spend_prediction
from custlens.operators.splits import Scaler, scaled_vectors
from custlens.operators.trees import load_ensemble, with_tree_factors

MANIFEST = "manifest.json"
FORMAT = 1
Scorer = Callable[[DataFrame], DataFrame]


def scaler_entry(scaler: Scaler | None) -> dict | None:
    """The order of the columns is that of the fitted models, so they are a list."""
    if scaler is None:
        return None
    return {"columns": scaler.columns, "means": [scaler.means[c] for c in scaler.columns],
            "deviations": [scaler.deviations[c] for c in scaler.columns]}


def scaler_from(entry: dict | None) -> Scaler | None:
    if entry is None:
        return None
    return Scaler(dict(zip(entry["columns"], entry["means"])), dict(zip(entry["columns"], entry["deviations"])))


def load_personas(spark: SparkSession, path: str) -> DataFrame:
    """A few rows, one per cluster, made part of the plan: scoring does not read the table for every batch."""
    table = spark.read.parquet(path)
    return spark.createDataFrame(table.orderBy("cluster_id").collect(), table.schema)


def store(spark: SparkSession, bundles: str, version: str, kind: str, entries: dict, write_parts: Callable[[str], None]) -> str:
    """Writes the parts of a version and then its manifest; returns the folder."""
    folder = f"{bundles}/{version}"
    if files.exists(spark, f"{folder}/{MANIFEST}"):
        raise FileExistsError(f"version {version} is stored already")
    write_parts(folder)
    files.write_new(spark, f"{folder}/{MANIFEST}", json.dumps({"format": FORMAT, "kind": kind, "version": version, **entries}))
    return folder


def versions(spark: SparkSession, bundles: str) -> list[str]:
    """Complete versions, in the order of their names."""
    return [v for v in files.names(spark, bundles) if files.exists(spark, f"{bundles}/{v}/{MANIFEST}")]


def manifest(spark: SparkSession, bundles: str, version: str | None = None) -> tuple[str, dict]:
    """Folder and manifest of a version, the last one if none is given."""
    if version is None:
        found = versions(spark, bundles)
        if not found:
            raise FileNotFoundError(f"no bundle in {bundles}")
        version = found[-1]
    folder = f"{bundles}/{version}"
    content = json.loads(files.read_text(spark, f"{folder}/{MANIFEST}"))
    if content["format"] != FORMAT:
        raise ValueError(f"bundle format {content['format']} is not known")
    return folder, content


@dataclass
class FittedBundle:
    """Churn trees, value model, segments and spending profile of one fit."""

    columns: list[str]
    churn: object
    value: object
    value_scaler: Scaler | None
    log_target: bool
    kmeans: object
    segment_scaler: Scaler
    personas: DataFrame
    profile: anomaly.SpendingProfile
    p95: float
    p99: float
    churn_path: str  # where the churn model is stored; the trees are read from there
    notes: dict = field(default_factory=dict)

    KIND = "fitted"

    def save(self, spark: SparkSession, bundles: str, version: str) -> str:
        def parts(folder: str) -> None:
            models.save_model(self.churn, f"{folder}/churn")
            models.save_model(self.value, f"{folder}/value")
            models.save_model(self.kmeans, f"{folder}/kmeans")
            models.save_model(self.profile.model, f"{folder}/profile")
            self.personas.coalesce(1).write.mode("overwrite").parquet(f"{folder}/personas")

        return store(spark, bundles, version, self.KIND, {
            "columns": self.columns, "value_scaler": scaler_entry(self.value_scaler), "log_target": self.log_target,
            "segment_scaler": scaler_entry(self.segment_scaler), "profile_scaler": scaler_entry(self.profile.scaler),
            "p95": self.p95, "p99": self.p99, "notes": self.notes,
        }, parts)

    @classmethod
    def load(cls, spark: SparkSession, folder: str, m: dict) -> "FittedBundle":
        return cls(
            m["columns"], models.load_model(spark, f"{folder}/churn"), models.load_model(spark, f"{folder}/value"),
            scaler_from(m["value_scaler"]), m["log_target"], models.load_model(spark, f"{folder}/kmeans"),
            scaler_from(m["segment_scaler"]), load_personas(spark, f"{folder}/personas"),
            anomaly.SpendingProfile(scaler_from(m["profile_scaler"]), PCAModel.load(f"{folder}/profile")),
            m["p95"], m["p99"], f"{folder}/churn", m["notes"])

    def scorer(self, spark: SparkSession) -> Scorer:
        """Probability with attributions, value, segment and anomaly of records with the input columns."""
        names, ensemble = self.columns, load_ensemble(spark, self.churn, self.churn_path)
        scale = self.value_scaler.scaled if self.value_scaler else (lambda c: F.col(c).cast("double"))
        value_inputs = [f"_v{i}" for i in range(len(names))]

        def score(df: DataFrame) -> DataFrame:
            rows = df.fillna(0, subset=names)
            plain = VectorAssembler(inputCols=names, outputCol="features").transform(rows)
            out = models.churn_probability(self.churn, plain).drop("features")
            out = out.withColumns({v: scale(c) for v, c in zip(value_inputs, names)})
            out = VectorAssembler(inputCols=value_inputs, outputCol="features").transform(out).drop(*value_inputs)
            out = self.value.transform(out).withColumn("clv", spend_prediction(F.col("prediction"), self.log_target))
            out = self.kmeans.transform(scaled_vectors(out.drop("features", "prediction"), self.segment_scaler)).drop("x")
            out = segments.with_segment_names(out, self.personas)
            out = self.profile.with_error(out, "anomaly_error").withColumn("anomaly_limit", F.lit(self.p95))
            return with_tree_factors(out, ensemble, names)

        return score


@dataclass
class RuleBundle:
    """A churn rule in place of a fitted model, for checks and as a fall-back: a margin of columns over divisors, segments by
    tier and recency, and the mean squared deviation as anomaly."""

    divisors: dict[str, float]
    means: dict[str, float]
    value_share: float
    scaler: Scaler
    personas: DataFrame
    p95: float
    p99: float

    KIND = "rules"

    def save(self, spark: SparkSession, bundles: str, version: str) -> str:
        def parts(folder: str) -> None:
            self.personas.coalesce(1).write.mode("overwrite").parquet(f"{folder}/personas")

        return store(spark, bundles, version, self.KIND, {
            "divisors": self.divisors, "means": self.means, "value_share": self.value_share, "scaler": scaler_entry(self.scaler),
            "p95": self.p95, "p99": self.p99,
        }, parts)

    @classmethod
    def load(cls, spark: SparkSession, folder: str, m: dict) -> "RuleBundle":
        return cls(m["divisors"], m["means"], m["value_share"], scaler_from(m["scaler"]), load_personas(spark, f"{folder}/personas"),
                   m["p95"], m["p99"])

    def scorer(self, spark: SparkSession) -> Scorer:
        def score(df: DataFrame) -> DataFrame:
            tier = F.when(F.col("engagement_score") <= 40, 0).when(F.col("engagement_score") <= 70, 1).otherwise(2)
            cluster = (tier + F.when(F.col("recency_days") > 90, 3).otherwise(0)).cast("int")
            named = segments.with_segment_names(df.withColumn("cluster_id", cluster), self.personas)
            parts = [F.col(c).cast("double") / F.lit(w) for c, w in self.divisors.items()]
            margin = parts[0]
            for part in parts[1:]:
                margin = margin + part
            factors = F.array(*[
                F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value"),
                         (F.lit(1.0 / w) * (F.col(c).cast("double") - F.lit(self.means[c]))).alias("attribution"))
                for c, w in self.divisors.items()])
            return named.withColumns({
                "probability": 1.0 / (1.0 + F.exp(-margin)),
                "clv": F.lit(self.value_share) * F.greatest(F.col("total_spend"), F.lit(0.0)),
                "anomaly_error": anomaly.mean_square(self.scaler), "anomaly_limit": F.lit(self.p95), "factors": factors,
                "segment_name": F.coalesce("segment_name", F.concat(F.lit("Cluster "), F.col("cluster_id").cast("string"))),
            })

        return score


KINDS = {kind.KIND: kind for kind in (FittedBundle, RuleBundle)}


def load(spark: SparkSession, bundles: str, version: str | None = None) -> FittedBundle | RuleBundle:
    """A stored bundle, from its folder alone; the last version if none is given."""
    folder, m = manifest(spark, bundles, version)
    return KINDS[m["kind"]].load(spark, folder, m)
