"""The stage tables that registered queries share, built from a folder of test tables."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession

from custlens.functions.columns import days_before
from custlens.functions.stages import stage
from custlens.operators import features as feature_ops
from custlens.operators.clean import clean_transactions
from custlens.operators.orders import latest_date, upto
from custlens.sources.star import raw_transactions

WINDOW_DAYS = 90


def raw(spark: SparkSession, folder: str) -> DataFrame:
    return raw_transactions(spark, folder)


def cleaned(spark: SparkSession, folder: str) -> DataFrame:
    return stage(
        spark, folder, "cleaned_transactions", lambda: clean_transactions(raw(spark, folder)).cleaned
    )


def cutoff(spark: SparkSession, folder: str) -> datetime:
    return days_before(latest_date(cleaned(spark, folder)), WINDOW_DAYS)


def observed(spark: SparkSession, folder: str) -> DataFrame:
    return upto(cleaned(spark, folder), cutoff(spark, folder))


def features(spark: SparkSession, folder: str) -> DataFrame:
    def build() -> DataFrame:
        return feature_ops.customer_features(
            cleaned(spark, folder), cutoff(spark, folder), WINDOW_DAYS
        )

    return stage(spark, folder, "customer_features", build)
