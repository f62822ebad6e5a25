"""Writers of the cleaned table, the feature table, exports and run logs."""

from __future__ import annotations

import json

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, functions as F

from custlens.functions.columns import timestamp


def write_cleaned(df: DataFrame, path: str) -> None:
    """The cleaned table in folders by month, in time order inside the files."""
    (
        df.withColumn("year", F.year("invoice_date")).withColumn("month", F.month("invoice_date"))
        .sortWithinPartitions("year", "month", "invoice_date")
        .write.mode("overwrite").partitionBy("year", "month").parquet(path)
    )


def read_cleaned(spark: SparkSession, path: str, cutoff: datetime | None = None) -> DataFrame:
    """The cleaned table up to a cutoff; months after it are not listed or read."""
    lines = spark.read.parquet(path)
    if cutoff is not None:
        year, month = F.col("year"), F.col("month")
        months = (year < cutoff.year) | ((year == cutoff.year) & (month <= cutoff.month))
        lines = lines.filter(months & (F.col("invoice_date") <= timestamp(cutoff)))
    return lines.drop("year", "month")


def write_report(df: DataFrame, path: str) -> None:
    """A small result (audit, profiles, metrics) as JSON lines."""
    df.write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_features(df: DataFrame, summary: DataFrame, dictionary: dict[str, str], folder: str) -> None:
    """Feature table as Parquet and CSV, and a metadata table beside it."""
    described = df.select(
        *[F.col(c).alias(c, metadata={"comment": dictionary[c]}) if c in dictionary else F.col(c) for c in df.columns]
    )
    described.write.mode("overwrite").parquet(f"{folder}/customer_features")
    write_csv(df.sparkSession.read.parquet(f"{folder}/customer_features"), f"{folder}/customer_features_csv")
    metadata = {
        "columns": df.columns,
        "dtypes": dict(df.dtypes),
        "feature_dictionary": dictionary,
    }
    write_report(
        summary.withColumn("metadata", F.lit(json.dumps(metadata))), f"{folder}/feature_metadata"
    )


def replace_tables(tables: dict[str, DataFrame], database: str | None = None) -> None:
    """Full reload of serving tables in the session catalog."""
    for name, df in tables.items():
        target = f"{database}.{name}" if database else name
        df.write.mode("overwrite").saveAsTable(target)


def replace_tables_jdbc(tables: dict[str, DataFrame], url: str, properties: dict[str, str]) -> None:
    """Full reload of serving tables in a database, keeping its table definitions."""
    for name, df in tables.items():
        df.write.option("truncate", True).jdbc(url, name, mode="overwrite", properties=properties)


def append_runs(df: DataFrame, path: str) -> None:
    """Adds evaluation rows to the run log."""
    df.write.mode("append").parquet(path)


def read_serving(spark: SparkSession, name: str, columns: list[str]) -> DataFrame:
    return spark.table(name).select(*columns)
