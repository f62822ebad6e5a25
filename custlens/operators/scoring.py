"""Scoring of customer records: range checks, defaults, tiers, results."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F, types as T

from custlens.functions.columns import cents, clip, round_even, round_exact, timestamp
from custlens.operators.explain import API_FACTORS, narrative, top_factors

# Field -> (required, default, lowest, highest). No default means derived or 0.
_SHARE = (False, 0.0, 0.0, 1.0)
FIELDS: dict[str, tuple[bool, float | None, float | None, float | None]] = {
    "recency_days": (True, None, 0.0, None),
    "frequency": (True, None, 0.0, None),
    "total_spend": (True, None, None, None),
    "gross_spend": (False, None, None, None),
    "total_items": (False, None, 0.0, None),
    "unique_products_count": (False, None, 0.0, None),
    "avg_order_value": (False, None, None, None),
    "avg_basket_size": (False, None, 0.0, None),
    "avg_unique_products_per_order": (False, None, 0.0, None),
    "log_total_spend": (False, None, None, None),
    "log_frequency": (False, None, None, None),
    "tenure_days": (False, None, 0.0, None),
    "days_active_span": (False, None, 0.0, None),
    "inter_purchase_mean": (False, None, 0.0, None),
    "inter_purchase_std": (False, None, 0.0, None),
    "is_single_order": (False, None, None, None),
    "recent_orders_last_90d": (False, 0.0, 0.0, None),
    "recent_orders_ratio": _SHARE,
    "velocity_acceleration": (False, 1.0, 0.0, None),
    "seasonal_q4_order_share": _SHARE,
    "seasonal_q4_spend_share": _SHARE,
    "return_line_rate": _SHARE,
    "return_spend_ratio": _SHARE,
    "has_returned": (False, 0.0, None, None),
    "discount_sensitivity": _SHARE,
    "cat_affinity_22": _SHARE,
    "cat_affinity_21": _SHARE,
    "cat_affinity_85": _SHARE,
    "cat_affinity_84": _SHARE,
    "cat_affinity_23": _SHARE,
    "cat_affinity_20": _SHARE,
    "is_uk": (False, 1.0, 0.0, 1.0),
    "engagement_score": (False, None, 0.0, 100.0),
}
MODEL_VERSION = "v1.0.0"
ANONYMOUS = 99999

SCORING_SCHEMA = T.StructType(
    [T.StructField("customer_id", T.LongType())] + [T.StructField(f, T.DoubleType()) for f in FIELDS]
)


def reject_reasons() -> Column:
    """Texts of the broken rules of a record; empty if it is valid."""
    reasons = []
    for name, (required, _, low, high) in FIELDS.items():
        x = F.col(name)
        if required:
            reasons.append(F.when(x.isNull(), f"{name} is missing"))
        if low is not None:
            reasons.append(F.when(x < low, f"{name} < {low:g}"))
        if high is not None:
            reasons.append(F.when(x > high, f"{name} > {high:g}"))
    return F.array_compact(F.array(*reasons))


def check_records(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid records, and the rejected ones with their reasons. A value that is not a number counts as missing."""
    numbers = df.withColumns({f: F.when(~F.isnan(F.col(f)), F.col(f)) for f in FIELDS})
    marked = numbers.withColumn("reject_reasons", reject_reasons())
    bad = F.size("reject_reasons") > 0
    return marked.filter(~bad).drop("reject_reasons"), marked.filter(bad)


def impute(df: DataFrame) -> DataFrame:
    """Fills derived and default features. In the derived ones, no orders count
    as one order and a recency of 0 as 30 days.
    """
    orders = F.greatest(F.when(F.col("frequency") != 0, F.col("frequency")).otherwise(1.0), F.lit(1.0))
    spend = F.coalesce("total_spend", F.lit(0.0))
    recency = F.when(F.col("recency_days") != 0, F.col("recency_days")).otherwise(30.0)
    tenure = F.coalesce("tenure_days", F.greatest(recency, F.lit(30.0)))
    derived = {
        "gross_spend": F.greatest(spend, F.lit(0.0)),
        "avg_order_value": spend / orders,
        "avg_basket_size": F.coalesce(F.col("total_items") / orders, F.lit(10.0)),
        "avg_unique_products_per_order": F.coalesce(F.col("unique_products_count") / orders, F.lit(3.0)),
        "log_total_spend": F.log1p(F.greatest(spend, F.lit(0.0))),
        "log_frequency": F.log1p(orders),
        "tenure_days": tenure,
        "days_active_span": F.greatest(tenure - recency, F.lit(0.0)),
        "inter_purchase_mean": tenure / F.greatest(orders - 1.0, F.lit(1.0)),
        "inter_purchase_std": F.lit(0.0),
        "is_single_order": F.when(orders <= 1.0, 1.0).otherwise(0.0),
        "engagement_score": clip(50.0 + orders * 3.0 + spend / 100.0 - recency / 5.0, 0.0, 100.0),
    }
    defaults = {f: F.lit(rule[1] or 0.0) for f, rule in FIELDS.items()}
    return df.select("customer_id", *[
        F.coalesce(F.col(f), derived.get(f, defaults[f])).cast("double").alias(f) for f in FIELDS
    ])


def risk_tier(p: Column) -> Column:
    return F.when(p >= 0.70, "High Risk").when(p >= 0.40, "Medium Risk").otherwise("Low Risk")


def scored_records(df: DataFrame, version: str, scored_at: datetime) -> DataFrame:
    """The result record from ``probability``, ``clv``, ``segment_name``,
    ``anomaly_error``, ``anomaly_limit`` and ``factors``.
    """
    p = F.col("probability")
    ranked = top_factors(F.col("factors"))
    return df.withColumn("_top", ranked).select(
        "customer_id",
        round_exact(p, 4).alias("churn_probability"),
        (p >= 0.50).alias("is_churn"),
        round_exact(F.greatest(F.col("clv"), F.lit(0.0)), 2).alias("predicted_clv_90d"),
        risk_tier(p).alias("risk_tier"),
        "segment_name",
        (F.col("anomaly_error") >= F.col("anomaly_limit")).alias("is_anomaly"),
        round_exact("anomaly_error", 4).alias("anomaly_score"),
        narrative(F.coalesce("customer_id", F.lit(ANONYMOUS).cast("bigint")), p, F.col("_top")).alias("plain_language_narrative"),
        F.slice("_top", 1, API_FACTORS).alias("top_risk_factors"),
        F.lit(version).alias("model_version"),
        timestamp(scored_at).alias("scored_at"),
    )


def score_batch(
    records: DataFrame, scorer: Callable[[DataFrame], DataFrame], version: str, scored_at: datetime
) -> tuple[DataFrame, DataFrame]:
    """Results of the valid records, and the rejected records."""
    good, bad = check_records(records)
    return scored_records(scorer(impute(good)), version, scored_at), bad


def batch_summary(scored: DataFrame) -> DataFrame:
    """One row: records, mean probability, mean value, anomalies."""
    n = F.count(F.lit(1))
    p = F.rint(F.col("churn_probability") * 10000.0).cast("decimal(38,0)")
    clv = cents("predicted_clv_90d").cast("decimal(38,0)")
    return scored.agg(
        n.alias("total_records"),
        round_even(F.coalesce(F.sum(p).cast("double") / 10000.0 / n, F.lit(0.0)), 4).alias("churn_rate"),
        round_even(F.coalesce(F.sum(clv).cast("double") / 100.0 / n, F.lit(0.0)), 2).alias("mean_predicted_clv"),
        F.count_if("is_anomaly").alias("anomalies_detected"),
    )


EXPORT_COLUMNS = (
    "customer_id", "churn_probability", "is_churn", "predicted_clv_90d", "risk_tier", "segment_name",
    "is_anomaly", "anomaly_score",
)


def export_rows(scored: DataFrame) -> DataFrame:
    """The columns of the CSV export."""
    return scored.select(*EXPORT_COLUMNS)
