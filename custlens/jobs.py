"""Jobs on files: sheets to cleaned lines, cleaned lines to features, results to serving tables and exports.

Each job reads and writes the paths it is given, checks what it hands on, and returns nothing that only its own
application can read.

    clean_job(spark, ["s3://…/2010", "s3://…/2011"], "s3://…/cleaned", fmt="csv")
    features_job(spark, "s3://…/cleaned", "s3://…/features")
    serving_job(spark, "s3://…/cleaned", "s3://…/features", "s3://…/bundles", "s3://…/serving", seeded_at)
    export_job(scored, "s3://…/export")
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, functions as F

from custlens.functions.columns import days_before
from custlens.operators import bundle, serving
from custlens.operators.clean import clean_transactions
from custlens.operators.eda import cohort_summary
from custlens.operators.features import FEATURE_DICTIONARY, check_features, cohort, customer_features
from custlens.operators.orders import latest_date
from custlens.operators.scoring import export_rows
from custlens.operators.validate import validate_cleaned
from custlens.sources import sinks
from custlens.sources.invoices import load_raw
from custlens.streaming.store import ServingStore


def clean_job(
    spark: SparkSession, sheets: Sequence[str], out: str, fmt: str = "parquet", cache_path: str | None = None,
    report: str | None = None,
) -> DataFrame:
    """Sheets to the cleaned table in folders by month; raises if a rule of severity error is broken.

    ``report`` is a folder for the audit and the summary. Returns the summary, one row.
    """
    result = clean_transactions(load_raw(spark, sheets, fmt, cache_path))
    sinks.write_cleaned(result.cleaned, out)
    summary = validate_cleaned(sinks.read_cleaned(spark, out))
    if report:
        sinks.write_report(result.audit, f"{report}/audit")
        sinks.write_report(summary, f"{report}/summary")
    return summary


def features_job(
    spark: SparkSession, cleaned: str, out: str, cutoff: datetime | None = None, window_days: int = 90,
) -> DataFrame:
    """The cleaned table to the feature table with its metadata; raises if a customer is lost or has no label."""
    lines = sinks.read_cleaned(spark, cleaned)
    cutoff = cutoff or days_before(latest_date(lines), window_days)
    table = customer_features(lines, cutoff, window_days)
    sinks.write_features(table, cohort_summary(table), FEATURE_DICTIONARY, out)
    written = spark.read.parquet(f"{out}/customer_features")
    check_features(written, cohort(sinks.read_cleaned(spark, cleaned, cutoff), cutoff).count())
    return written


def serving_job(
    spark: SparkSession, cleaned: str, features: str, bundles: str, out: str, seeded_at: datetime, version: str | None = None,
    database: str | None = None,
) -> ServingStore:
    """A full load of the four serving tables with a stored bundle: into a store that streams go on with, and into the catalog
    if a database is named."""
    _, manifest = bundle.manifest(spark, bundles, version)
    made = bundle.load(spark, bundles, manifest["version"])
    table = spark.read.parquet(f"{features}/customer_features")
    scored = made.scorer(spark)(table)
    store = ServingStore(spark, out)
    store.create({
        "customers": serving.customers_table(table, sinks.read_cleaned(spark, cleaned)),
        "customer_segments": serving.segments_table(scored, seeded_at),
        "predictions": serving.predictions_table(scored, manifest["version"], seeded_at),
        "anomaly_reports": serving.anomalies_table(scored, F.lit(made.p95), F.lit(made.p99), seeded_at),
    }, made.p99)
    if database:
        sinks.replace_tables(store.tables(), database)
    return store


def export_job(scored: DataFrame, out: str) -> None:
    """Scored records as CSV with a header."""
    sinks.write_csv(export_rows(scored), out)
