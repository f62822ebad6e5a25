"""Serving tables and the reports that read them.

Predictions and anomaly reports are append-only histories; the key of a row is
(customer_id, scored_at, model_version).
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F

from custlens.functions.columns import cents, exact_mean, round_even, round_exact, timestamp
from custlens.functions.ranking import exact_quantiles
from custlens.operators.scoring import risk_tier

HOME = "United Kingdom"


# Building and updating the tables


def customers_table(features: DataFrame, lines: DataFrame) -> DataFrame:
    dates = lines.groupBy("customer_id").agg(
        F.min("invoice_date").alias("first_order_date"), F.max("invoice_date").alias("last_order_date")
    )
    return features.join(dates, "customer_id", "left").select(
        "customer_id", F.coalesce("primary_country", F.lit(HOME)).alias("country"),
        "first_order_date", "last_order_date", (F.col("is_uk") == 1).alias("is_uk"),
    )


def segments_table(segmented: DataFrame, updated_at: datetime) -> DataFrame:
    return segmented.select(
        "customer_id", F.col("cluster_id").cast("int").alias("segment_id"), "segment_name",
        round_even("engagement_score", 2).alias("engagement_score"), timestamp(updated_at).alias("updated_at"),
    )


def predictions_table(scored: DataFrame, version: str, scored_at: datetime) -> DataFrame:
    """From ``probability`` and ``clv``."""
    p = F.col("probability")
    return scored.select(
        "customer_id", round_exact(p, 4).alias("churn_probability"), (p >= 0.50).alias("is_churn"),
        round_exact(F.greatest(F.col("clv"), F.lit(0.0)), 2).alias("predicted_clv"), risk_tier(p).alias("risk_tier"),
        F.lit(version).alias("model_version"), timestamp(scored_at).alias("scored_at"),
    )


def anomalies_table(scored: DataFrame, p95: Column, p99: Column, flagged_at: datetime) -> DataFrame:
    """From ``anomaly_error``, rounded before it is compared."""
    error = round_exact("anomaly_error", 4)
    return scored.select(
        "customer_id", error.alias("reconstruction_error"), (error >= p95).alias("is_anomaly_95"),
        (error >= p99).alias("is_anomaly_99"), timestamp(flagged_at).alias("flagged_at"),
    )


def latest(history: DataFrame, at: str, count_as: str | None = None) -> DataFrame:
    """The newest row per customer, with their number if ``count_as`` names it.

    An aggregate, so long histories merge before the shuffle.
    """
    others = [c for c in history.columns if c != "customer_id"]
    order = F.struct(at, *[c for c in others if c != at])
    newest = history.groupBy("customer_id").agg(F.max(order).alias("row"), F.count(F.lit(1)).alias("rows"))
    counted = [F.col("rows").alias(count_as)] if count_as else []
    return newest.select("customer_id", *[F.col(f"row.{c}").alias(c) for c in others], *counted)


def upsert_customers(existing: DataFrame, scored: DataFrame, country: str = HOME) -> DataFrame:
    """Adds scored customers that are not there yet."""
    unknown = scored.filter(F.col("customer_id").isNotNull()).select("customer_id").distinct().join(
        existing, "customer_id", "left_anti"
    )
    added = unknown.select(
        "customer_id", F.lit(country).alias("country"), F.lit(None).cast("timestamp_ntz").alias("first_order_date"),
        F.lit(None).cast("timestamp_ntz").alias("last_order_date"), F.lit(country == HOME).alias("is_uk"),
    )
    return existing.unionByName(added)


def upsert_segments(existing: DataFrame, scored: DataFrame) -> DataFrame:
    """Sets name and time of scored customers; new ones get segment 0 and score 50."""
    newest = latest(
        scored.filter(F.col("customer_id").isNotNull()).select("customer_id", "segment_name", "scored_at"), "scored_at"
    ).withColumnsRenamed({"segment_name": "_name", "scored_at": "_at"})
    return existing.join(newest, "customer_id", "full_outer").select(
        "customer_id",
        F.coalesce("segment_id", F.lit(0)).alias("segment_id"),
        F.coalesce("_name", "segment_name").alias("segment_name"),
        F.coalesce("engagement_score", F.lit(50.0)).alias("engagement_score"),
        F.coalesce("_at", "updated_at").alias("updated_at"),
    )


def append_predictions(existing: DataFrame, scored: DataFrame) -> DataFrame:
    rows = scored.filter(F.col("customer_id").isNotNull()).select(
        "customer_id", "churn_probability", "is_churn", F.col("predicted_clv_90d").alias("predicted_clv"),
        "risk_tier", "model_version", "scored_at",
    )
    return existing.unionByName(rows)


def append_anomalies(existing: DataFrame, scored: DataFrame, p99: Column) -> DataFrame:
    rows = scored.filter(F.col("customer_id").isNotNull()).select(
        "customer_id", F.col("anomaly_score").alias("reconstruction_error"), F.col("is_anomaly").alias("is_anomaly_95"),
        (F.col("anomaly_score") >= p99).alias("is_anomaly_99"), F.col("scored_at").alias("flagged_at"),
    )
    return existing.unionByName(rows)


# Customer reports


def rfm_metrics(features: DataFrame) -> DataFrame:
    return features.select(
        "customer_id", "recency_days", F.col("frequency").cast("double").alias("frequency"),
        *[round_even(c, 2).alias(c) for c in ("total_spend", "avg_order_value", "avg_basket_size")],
        "tenure_days", round_even("engagement_score", 2).alias("rfm_engagement_score"),
        round_even("return_line_rate", 4).alias("return_rate"),
    )


def customer_360(
    customers: DataFrame, segments: DataFrame, predictions: DataFrame, anomalies: DataFrame, features: DataFrame
) -> DataFrame:
    """Master data, segment, latest prediction and their number, latest anomaly and RFM per customer.

    The predictions themselves stay rows, see :func:`prediction_history`.
    """
    def nested(df: DataFrame, name: str) -> DataFrame:
        return df.select("customer_id", F.struct(*[c for c in df.columns if c != "customer_id"]).alias(name))

    number = "historical_predictions_count"
    newest = latest(predictions, "scored_at", number)
    fields = [c for c in newest.columns if c not in ("customer_id", number)]
    newest = newest.select("customer_id", F.struct(*fields).alias("latest_prediction"), number)
    return (
        customers.join(nested(segments, "segment"), "customer_id", "left")
        .join(newest, "customer_id", "left")
        .join(nested(latest(anomalies, "flagged_at"), "latest_anomaly"), "customer_id", "left")
        .join(nested(rfm_metrics(features), "rfm_metrics"), "customer_id", "left")
        .fillna(0, subset=["historical_predictions_count"])
    )


def prediction_history(predictions: DataFrame, customer_id: int | None = None) -> DataFrame:
    """All predictions, of one customer if given, newest first."""
    if customer_id is None:
        return predictions.orderBy("customer_id", F.desc("scored_at"))
    return predictions.filter(F.col("customer_id") == customer_id).orderBy(F.desc("scored_at"))


def customer_page(
    customers: DataFrame, segments: DataFrame, predictions: DataFrame, features: DataFrame,
    limit: int = 20, offset: int = 0,
) -> DataFrame:
    """One page by customer id with segment, latest prediction and RFM.

    The page (at most 200 ids) is cut first; only its rows of the histories are read on.
    """
    if not 1 <= limit <= 200 or offset < 0:
        raise ValueError("limit must be 1 to 200 and offset not negative")
    page = customers.orderBy("customer_id").offset(offset).limit(limit)
    ids = F.broadcast(page.select("customer_id"))
    newest = latest(predictions.join(ids, "customer_id", "left_semi"), "scored_at")
    return (
        page.join(segments.join(ids, "customer_id", "left_semi"), "customer_id", "left")
        .join(newest, "customer_id", "left")
        .join(rfm_metrics(features).join(ids, "customer_id", "left_semi"), "customer_id", "left")
        .withColumn("historical_predictions_count", F.when(F.col("scored_at").isNotNull(), 1).otherwise(0))
    )


# Cohort reports


def cohort_view(segmented: DataFrame, predictions: DataFrame, anomalies: DataFrame) -> DataFrame:
    """Customers with their latest prediction and anomaly; simple stand-ins where there is none."""
    p = latest(predictions, "scored_at").select("customer_id", "churn_probability", "predicted_clv", "risk_tier")
    a = latest(anomalies, "flagged_at").select("customer_id", "reconstruction_error", "is_anomaly_95")
    joined = segmented.join(p, "customer_id", "left").join(a, "customer_id", "left")
    probability = F.coalesce("churn_probability", F.when(F.col("recency_days") > 90, 0.85).otherwise(0.25))
    return joined.withColumns({
        "risk_tier": F.coalesce("risk_tier", risk_tier(probability)),
        "churn_probability": probability,
        "predicted_clv": F.coalesce("predicted_clv", round_even(F.col("total_spend") * 0.45, 2)),
        "is_anomaly_95": F.coalesce("is_anomaly_95", F.lit(False)),
        "reconstruction_error": F.coalesce("reconstruction_error", F.lit(0.02)),
    })


def kpis(cohort: DataFrame) -> DataFrame:
    n = F.count(F.lit(1))
    return cohort.agg(
        n.alias("customers"),
        (F.count_if(F.col("churn_probability") >= 0.50) / n * 100.0).alias("churn_percent"),
        (F.sum(cents("predicted_clv").cast("decimal(38,0)")).cast("double") / 100.0 / n).alias("mean_clv"),
        F.count_if(F.col("risk_tier") == "High Risk").alias("high_risk"),
        F.count_if("is_anomaly_95").alias("anomalies"),
    )


def tier_counts(cohort: DataFrame) -> DataFrame:
    return cohort.groupBy("risk_tier").agg(F.count(F.lit(1)).alias("customers"))


def segment_filter(
    cohort: DataFrame, personas: Sequence[str] | None = None, country: str | None = None,
    low: float = 0.0, high: float | None = None,
) -> DataFrame:
    """Customers by persona, country and spend; the upper limit is the 98th percentile of spend."""
    limit = (
        F.lit(high) if high is not None
        else exact_quantiles(cohort, "total_spend", {"limit": 0.98}).select("limit").scalar()
    )
    keep = (F.col("total_spend") >= low) & (F.col("total_spend") <= limit)
    if personas is not None:
        keep = keep & F.col("segment_name").isin(list(personas))
    if country is not None:
        keep = keep & (F.col("primary_country") == country)
    return cohort.filter(keep)


def fixed_sample(df: DataFrame, n: int, seed: int = 42, key: str = "customer_id") -> DataFrame:
    """``n`` rows that depend on the seed and the keys only."""
    order = F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}")).cast("binary"))
    return df.orderBy(order, key).limit(n)


def segment_summary(cohort: DataFrame) -> DataFrame:
    return cohort.groupBy("segment_name").agg(
        F.count("customer_id").alias("customers"), exact_mean("total_spend").alias("avg_spend"),
        exact_mean("frequency").alias("avg_freq"), exact_mean("recency_days").alias("avg_recency"),
        exact_mean("predicted_clv").alias("avg_clv"), exact_mean("churn_probability").alias("churn_risk"),
    )


LEADERBOARD_COLUMNS = (
    "customer_id", "segment_name", "churn_probability", "predicted_clv", "priority_revenue_at_risk",
    "recency_days", "frequency", "total_spend", "risk_tier",
)


def at_risk(cohort: DataFrame, min_risk: float = 0.60, min_spend: float = 500.0, tier: str | None = None) -> DataFrame:
    """Customers over both limits with the revenue at risk."""
    keep = (F.col("churn_probability") >= min_risk) & (F.col("total_spend") >= min_spend)
    if tier is not None:
        keep = keep & (F.col("risk_tier") == tier)
    value = F.coalesce("predicted_clv", F.col("total_spend") * 0.5) * F.col("churn_probability")
    return cohort.filter(keep).withColumn("priority_revenue_at_risk", round_even(value, 2)).select(*LEADERBOARD_COLUMNS)


def leaderboard(risky: DataFrame, top: int = 100) -> DataFrame:
    return risky.orderBy(F.desc("priority_revenue_at_risk"), "customer_id").limit(top)


def leaderboard_total(risky: DataFrame) -> DataFrame:
    total = F.sum(cents("priority_revenue_at_risk").cast("decimal(38,0)")).cast("double") / 100.0
    return risky.agg(F.count(F.lit(1)).alias("accounts"), F.coalesce(total, F.lit(0.0)).alias("revenue_at_risk"))
