"""Spending anomalies: reconstruction error and percentile thresholds."""

from __future__ import annotations

from pyspark.ml.feature import PCA, PCAModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from custlens.functions.columns import round_even
from custlens.functions.ranking import exact_quantiles
from custlens.operators.splits import Scaler, fit_scaler, scaled_vectors

FEATURES = (
    "recency_days", "frequency", "total_spend", "gross_spend", "avg_order_value", "avg_basket_size",
    "velocity_acceleration", "return_spend_ratio", "return_line_rate", "discount_sensitivity", "engagement_score",
)
LATENT = 6


def mean_square(scaler: Scaler) -> Column:
    """Mean of the squared scaled columns: the error of a model that predicts the mean."""
    total = F.lit(0.0)
    for c in scaler.columns:
        total = total + scaler.scaled(c) * scaler.scaled(c)
    return total / float(len(scaler.columns))


class SpendingProfile:
    """Linear autoencoder: a projection to ``LATENT`` components and back."""

    def __init__(self, scaler: Scaler, model: PCAModel):
        self.scaler = scaler
        self.model = model

    @classmethod
    def fit(cls, df: DataFrame, columns: tuple[str, ...] = FEATURES, latent: int = LATENT) -> "SpendingProfile":
        scaler = fit_scaler(df, [c for c in columns if c in df.columns])
        vectors = scaled_vectors(df, scaler, "_x").select("_x")
        return cls(scaler, PCA(k=latent, inputCol="_x", outputCol="_z").fit(vectors))

    def with_error(self, df: DataFrame, name: str) -> DataFrame:
        """Adds the mean squared difference of a row and its reconstruction.

        The components are orthonormal, so it is what the projection leaves over.
        """
        def squares(v: str) -> Column:
            return F.aggregate(vector_to_array(v), F.lit(0.0), lambda s, x: s + x * x)

        both = self.model.transform(scaled_vectors(df, self.scaler, "_x"))
        left = F.greatest(squares("_x") - squares("_z"), F.lit(0.0))
        return both.withColumn(name, left / float(len(self.scaler.columns))).drop("_x", "_z")


def anomaly_thresholds(df: DataFrame, error: str, percentile: float = 95.0) -> DataFrame:
    """One row: thresholds, median, maximum and the number above the chosen threshold."""
    probs = {"median_error": 0.5, "threshold_p95": 0.95, "threshold_p99": 0.99, "threshold": percentile / 100.0}
    cuts = exact_quantiles(df, error, probs)
    limit = cuts.select("threshold").scalar()
    extremes = df.agg(
        F.max(error).alias("max_error"), F.count_if(F.col(error) > limit).alias("anomalous_accounts_count")
    )
    return cuts.select(
        *[round_even(c, 4).alias(c) for c in probs],
        round_even(extremes.select("max_error").scalar(), 4).alias("max_error"),
        extremes.select("anomalous_accounts_count").scalar().alias("anomalous_accounts_count"),
    )


def anomaly_flags(df: DataFrame, error: str, p95: float, p99: float) -> DataFrame:
    return df.withColumns({
        "is_anomaly_95": F.col(error) >= F.lit(p95), "is_anomaly_99": F.col(error) >= F.lit(p99),
    })
