"""A support-vector classifier with a Gaussian kernel by random Fourier features, with calibrated probabilities.

The map to Fourier features is a fixed random matrix (from a seed) that travels with the task; the fit on them is Spark's
linear one, so it scales with the rows. Probabilities come from isotonic calibration: margins are counted in buckets of fixed
width, bounded in number, and pooled until the rates rise.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.classification import LinearSVC, LinearSVCModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from custlens.operators.splits import SEED, fitting_rows

FEATURES = 256
#: Buckets of the margin: their width, and the numbers beyond which all margins are one bucket.
WIDTH, MOST = 0.25, 160


@dataclass
class FourierMap:
    """x to sqrt(2 / D) cos(W x + b), whose products approach the kernel exp(-gamma |x - y|^2)."""

    weights: np.ndarray
    phases: np.ndarray

    @classmethod
    def draw(cls, width: int, gamma: float, features: int = FEATURES, seed: int = SEED) -> "FourierMap":
        rng = np.random.default_rng(seed)
        return cls(rng.normal(0.0, np.sqrt(2.0 * gamma), (width, features)), rng.uniform(0.0, 2.0 * np.pi, features))

    def mapped(self, x: np.ndarray) -> np.ndarray:
        return np.sqrt(2.0 / len(self.phases)) * np.cos(x @ self.weights + self.phases)

    def apply(self, x: Column) -> Column:
        weights, phases = self.weights, self.phases

        @F.pandas_udf("array<double>")
        def fourier(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            own = FourierMap(weights, phases)
            for s in batches:
                yield pd.Series(list(own.mapped(np.stack(s))) if len(s) else [], dtype=object)

        return array_to_vector(fourier(x))


def margin_bucket(margin: Column, width: float = WIDTH, most: int = MOST) -> Column:
    return F.least(F.greatest(F.floor(margin / width), F.lit(-most)), F.lit(most)).cast("int")


def pooled(counts: Sequence[tuple[int, int, float]]) -> list[tuple[int, float]]:
    """(bucket, rate) with rates that never fall, from (bucket, rows, positives) in the order of the buckets.

    Neighbours whose rates fall are pooled, again and again; the result is the closest rising one by least squares.
    """
    blocks: list[list] = []  # buckets, rows, positives
    for bucket, n, positive in counts:
        blocks.append([[bucket], n, positive])
        while len(blocks) > 1 and blocks[-2][2] * blocks[-1][1] >= blocks[-1][2] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [blocks[-1][0] + last[0], blocks[-1][1] + last[1], blocks[-1][2] + last[2]]
    return [(bucket, positive / n) for buckets, n, positive in blocks for bucket in buckets]


@dataclass
class Calibration:
    """Rates by bucket; a bucket without rows takes the rate of the next lower one that has some, else the lowest."""

    steps: list[tuple[int, float]]
    width: float = WIDTH
    most: int = MOST

    @classmethod
    def fit(cls, rows: DataFrame, margin: str, label: str, width: float = WIDTH, most: int = MOST) -> "Calibration":
        counts = rows.groupBy(margin_bucket(F.col(margin), width, most).alias("b")).agg(
            F.count(F.lit(1)).alias("n"), F.sum(F.col(label).cast("double")).alias("p")).orderBy("b").collect()  # 2 * most + 1 rows at most
        return cls(pooled([(r["b"], r["n"], r["p"]) for r in counts]), width, most)

    def probability(self, margin: Column) -> Column:
        bucket = margin_bucket(margin, self.width, self.most)
        table = F.array(*[F.struct(F.lit(b).alias("b"), F.lit(rate).alias("rate")) for b, rate in self.steps])
        below = F.filter(table, lambda s: s["b"] <= bucket)
        return F.when(F.size(below) > 0, F.element_at(below, F.greatest(F.size(below), F.lit(1)))["rate"]).otherwise(F.lit(self.steps[0][1]))


@dataclass
class KernelSvm:
    fourier: FourierMap
    model: LinearSVCModel
    calibration: Calibration

    def margins(self, df: DataFrame, x: str = "x") -> DataFrame:
        mapped = df.withColumn("_fourier", self.fourier.apply(F.col(x)))
        out = self.model.transform(mapped).withColumn("margin", vector_to_array("_raw")[1])
        return out.drop("_fourier", "_raw", "_class")

    def transform(self, df: DataFrame, x: str = "x") -> DataFrame:
        """Adds ``margin`` and ``probability``."""
        return self.margins(df, x).withColumn("probability", self.calibration.probability(F.col("margin")))


def fit_kernel_svm(
    train: DataFrame, val: DataFrame, label: str = "label", gamma: float | None = None, features: int = FEATURES, penalty: float = 1e-3,
    iterations: int = 50, partitions: int = 8,
) -> KernelSvm:
    """``train`` and ``val`` have customer_id, x (array of scaled numbers) and the label; probabilities are fitted on ``val``."""
    width = len(train.first()["x"])
    fourier = FourierMap.draw(width, 1.0 / width if gamma is None else gamma, features)
    mapped = train.select("customer_id", fourier.apply(F.col("x")).alias("_fourier"), F.col(label).cast("double").alias("_label"))
    with fitting_rows(mapped, partitions) as rows:
        model = LinearSVC(
            featuresCol="_fourier", labelCol="_label", rawPredictionCol="_raw", predictionCol="_class", regParam=penalty, maxIter=iterations,
            standardization=False).fit(rows)
    made = KernelSvm(fourier, model, Calibration([(0, 0.5)]))
    made.calibration = Calibration.fit(made.margins(val), "margin", label)
    return made
