"""Closed-form ridge regression and attributions of linear scores."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F


def gram_sums(df: DataFrame, columns: list[str], label: str) -> DataFrame:
    """Long form (i, j, value) of the sums of products of all columns, the label
    and a constant. One pass; each task sends one row per column.
    """
    names = [*columns, label, "one"]
    values = F.array(*[F.col(c).cast("double") for c in (*columns, label)], F.lit(1.0))
    rows = df.select(values.alias("x")).select(F.posexplode("x").alias("i", "xi"), "x")
    sums = rows.groupBy("i").agg(*[
        F.sum(F.col("xi") * F.col("x")[j]).alias(f"s{j}") for j in range(len(names))
    ])
    labels = F.array(*[F.lit(n) for n in names])
    return sums.select(
        labels[F.col("i")].alias("row_name"), F.posexplode(F.array(*[f"s{j}" for j in range(len(names))])).alias("j", "value")
    ).select("row_name", labels[F.col("j")].alias("column_name"), "value")


@dataclass(frozen=True)
class LinearModel:
    intercept: float
    weights: dict[str, float]

    def predict(self) -> Column:
        out = F.lit(self.intercept)
        for name, w in self.weights.items():
            out = out + F.lit(w) * F.col(name).cast("double")
        return out


def fit_ridge(df: DataFrame, columns: list[str], label: str, alpha: float = 100.0) -> LinearModel:
    """Ridge with an unpenalised intercept. Only the product sums reach the driver."""
    sums = {(r.row_name, r.column_name): r.value for r in gram_sums(df, columns, label).collect()}
    n = sums["one", "one"]
    mean = np.array([sums[c, "one"] / n for c in columns])
    y_mean = sums[label, "one"] / n
    gram = np.array([[sums[a, b] for b in columns] for a in columns]) - n * np.outer(mean, mean)
    moment = np.array([sums[c, label] for c in columns]) - n * mean * y_mean
    w = np.linalg.solve(gram + alpha * np.eye(len(columns)), moment)
    return LinearModel(float(y_mean - mean @ w), {c: float(v) for c, v in zip(columns, w)})


def linear_attributions(
    df: DataFrame, weights: dict[str, float], key: str = "customer_id", keep: dict[str, Column] | None = None,
) -> DataFrame:
    """Exact Shapley values of a linear score: weight * (value - mean), as a factor array; ``keep`` adds columns."""
    means = df.agg(*[F.avg(F.col(c).cast("double")).alias(c) for c in weights]).first()  # one row
    factors = [
        F.struct(
            F.lit(c).alias("feature"),
            F.col(c).cast("double").alias("value"),
            (F.lit(w) * (F.col(c).cast("double") - F.lit(float(means[c])))).alias("attribution"),
        )
        for c, w in weights.items()
    ]
    return df.select(key, F.array(*factors).alias("factors"), *[c.alias(name) for name, c in (keep or {}).items()])
