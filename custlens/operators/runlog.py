"""The log of model fits, and what the registry says of it.

A run is one row: model, target, version, time, where the model lies, its parameters as text, the number of inputs, and its
quality on the test rows. Runs are only added. The registry shows the last version of every model and marks the best of each
target as active: by the target's measure, then by the second one, then by name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

RUN_SCHEMA = (
    "model string, target string, version bigint, trained_at timestamp_ntz, path string, parameters string, "
    "feature_count bigint, measure string, test_value double, second_value double"
)
COLUMNS = [c.split()[0] for c in RUN_SCHEMA.split(", ")]
#: The measure of each target, and the one that decides between equals.
MEASURES = {"churn": ("roc_auc", "recall"), "clv_next_90d": ("r2", None)}


def run_rows(measured: DataFrame, target: str, version: int, trained_at, path: str, parameters: str, feature_count: int) -> DataFrame:
    """Rows of the log from metrics of models on test rows (model, metrics); ``path`` is completed by the model's name."""
    first, second = MEASURES[target]
    return measured.select(
        "model", F.lit(target).alias("target"), F.lit(version).cast("bigint").alias("version"), F.lit(trained_at).cast("timestamp_ntz").alias("trained_at"),
        F.concat(F.lit(f"{path}/"), "model").alias("path"), F.lit(parameters).alias("parameters"),
        F.lit(feature_count).cast("bigint").alias("feature_count"), F.lit(first).alias("measure"),
        F.col(first).cast("double").alias("test_value"), (F.col(second).cast("double") if second else F.lit(None).cast("double")).alias("second_value"))


def append(runs: DataFrame, folder: str) -> None:
    runs.select(*COLUMNS).write.mode("append").parquet(folder)


def read(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(RUN_SCHEMA).parquet(folder)


def registry(log: DataFrame) -> DataFrame:
    """The last version of every model, with its rank in the target and whether it is active."""
    # an aggregate per model and one window over the models of a target, both small
    last = log.groupBy("target", "model").agg(F.max(F.struct("version", *[c for c in COLUMNS if c not in ("target", "model", "version")])).alias("run"))
    rows = last.select("target", "model", "run.*")
    order = Window.partitionBy("target").orderBy(F.desc("test_value"), F.desc_nulls_last("second_value"), "model")
    return rows.withColumn("place", F.row_number().over(order)).withColumn("active", F.col("place") == 1)


def active(log: DataFrame) -> DataFrame:
    """The active model of each target."""
    return registry(log).filter("active").drop("place", "active")
