"""Model metrics as aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from custlens.functions.columns import ratio, round_even
from custlens.functions.ranking import cumulative_counts


def exact_auc(df: DataFrame, label: str, score: str) -> DataFrame:
    """Area under the ROC curve from average ranks; null if a class is absent.

    Twice the rank is a whole number, so the rank sum is exact.
    """
    positive = (F.col(label) == 1).cast("bigint")
    cdf = cumulative_counts(df, score, sums={"positives": positive})
    twice_rank = (2 * F.col("below") + F.col("n") + 1).cast("decimal(20,0)")
    sums = cdf.agg(
        F.sum(twice_rank * F.col("positives").cast("decimal(18,0)")).cast("double").alias("twice"),
        F.sum("positives").cast("double").alias("n1"),
        F.sum("n").cast("double").alias("n"),
    )
    n1, n0 = F.col("n1"), F.col("n") - F.col("n1")
    return sums.select(
        ratio(F.col("twice") / 2.0 - n1 * (n1 + 1.0) / 2.0, n1 * n0, default=None).alias("roc_auc")
    )


def classifier_metrics(
    df: DataFrame, label: str = "churn", score: str = "probability", threshold: float = 0.5
) -> DataFrame:
    """One row: accuracy, precision, recall, F1, AUC (4 digits) and the confusion counts."""
    predicted, actual = F.col(score) >= threshold, F.col(label) == 1
    counts = df.agg(
        F.count_if(predicted & actual).alias("true_positives"),
        F.count_if(predicted & ~actual).alias("false_positives"),
        F.count_if(~predicted & ~actual).alias("true_negatives"),
        F.count_if(~predicted & actual).alias("false_negatives"),
    )
    tp, fp = F.col("true_positives"), F.col("false_positives")
    tn, fn = F.col("true_negatives"), F.col("false_negatives")
    auc = exact_auc(df, label, score).scalar()
    return counts.select(
        round_even(ratio(tp + tn, tp + fp + tn + fn), 4).alias("accuracy"),
        round_even(ratio(tp, tp + fp), 4).alias("precision"),
        round_even(ratio(tp, tp + fn), 4).alias("recall"),
        round_even(ratio(2 * tp, 2 * tp + fp + fn), 4).alias("f1"),
        round_even(auc, 4).alias("roc_auc"),
        *counts.columns,
    )


def spend_prediction(prediction: Column, is_log: bool = False) -> Column:
    """A model output as money: undoes the log target, never negative."""
    value = F.expm1(F.least(F.greatest(prediction, F.lit(0.0)), F.lit(15.0))) if is_log else prediction
    return F.greatest(value, F.lit(0.0))


def regressor_metrics(
    df: DataFrame, label: str = "clv_next_90d", prediction: str = "prediction", is_log: bool = False
) -> DataFrame:
    """One row: MAE and RMSE (2 digits), R2 (4 digits)."""
    y = F.col(label).cast("double")
    error = y - spend_prediction(F.col(prediction), is_log)
    sums = df.agg(
        F.avg(F.abs(error)).alias("mae"), F.avg(error * error).alias("mse"), F.var_pop(y).alias("variance")
    )
    r2 = F.when(F.col("variance") > 0, 1.0 - F.col("mse") / F.col("variance"))
    return sums.select(
        round_even("mae", 2).alias("mae"), round_even(F.sqrt("mse"), 2).alias("rmse"), round_even(r2, 4).alias("r2")
    )
