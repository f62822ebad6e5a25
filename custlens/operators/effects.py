"""Partial dependence of tree ensembles, exactly and in one pass over the rows.

The effect of a feature at a value is the mean margin over all rows with the feature set to that value. A row then ends in a
leaf if it meets the leaf's conditions on the other features and the value meets those on this one. So each leaf needs only
the number of rows that meet all its conditions, and, for each feature on its path, of those that fail in that one alone.
Tasks count them for their rows; the counts are as large as the model. Any grid follows from them, without grid times rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from custlens.operators.trees import ROWS_AT_ONCE, TreeEnsemble

COUNTS = "features int, leaf int, failed int, n bigint"


@dataclass
class LeafCounts:
    """Rows in all; and for the leaves with m features: who meets all conditions (last column) or fails in one feature only."""

    rows: int
    by_features: dict[int, np.ndarray]


def count_leaves(ensemble: TreeEnsemble, x: np.ndarray) -> dict[int, np.ndarray]:
    out = {}
    for m, g in ensemble.leaf_paths().items():
        counts = np.zeros((len(g["value"]), m + 1), dtype=np.int64)
        for a in range(0, len(x), ROWS_AT_ONCE):
            picked = x[a:a + ROWS_AT_ONCE][:, g["feature"]]
            ok = (picked > g["bounds"][:, :, 0]) & (picked <= g["bounds"][:, :, 1])
            misses = m - ok.sum(axis=2)
            counts[:, m] += (misses == 0).sum(axis=0)
            one = misses == 1
            for i in range(m):
                counts[:, i] += (one & ~ok[:, :, i]).sum(axis=0)
        out[m] = counts
    return out


def leaf_counts(df: DataFrame, ensemble: TreeEnsemble, columns: Sequence[str]) -> LeafCounts:
    """One pass over ``df``; what comes to the driver is as large as the model, whatever the number of rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[int, np.ndarray] = {}
        rows = 0
        for pdf in batches:
            rows += len(pdf)
            for m, counts in count_leaves(ensemble, np.stack(pdf["x"])).items():
                total[m] = total.get(m, 0) + counts
        if rows:
            yield pd.DataFrame({"features": [-1], "leaf": [0], "failed": [0], "n": [rows]})
        for m, counts in total.items():
            leaf, failed = np.nonzero(counts)
            yield pd.DataFrame({"features": m, "leaf": leaf, "failed": failed, "n": counts[leaf, failed]})

    x = F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns])
    found = df.select(x.alias("x")).mapInPandas(run, COUNTS).groupBy("features", "leaf", "failed").agg(F.sum("n").alias("n")).collect()
    by = {m: np.zeros((len(g["value"]), m + 1), dtype=np.int64) for m, g in ensemble.leaf_paths().items()}
    rows = 0
    for r in found:
        if r["features"] < 0:
            rows = r["n"]
        else:
            by[r["features"]][r["leaf"], r["failed"]] = r["n"]
    return LeafCounts(rows, by)


def effect(ensemble: TreeEnsemble, counts: LeafCounts, feature: int, values: Sequence[float]) -> np.ndarray:
    """The mean margin over the rows with the feature set to each of the values."""
    values = np.asarray(values, dtype=float)
    out = np.zeros(len(values))
    for m, g in ensemble.leaf_paths().items():
        n = counts.by_features[m]
        here = g["feature"] == feature
        without = ~here.any(axis=1)
        out += (g["value"][without] * n[without, m]).sum()
        for i in range(m):
            some = here[:, i]
            low, high = g["bounds"][some, i, 0], g["bounds"][some, i, 1]
            others_met = (n[some, m] + n[some, i]) * g["value"][some]
            out += ((values[:, None] > low) & (values[:, None] <= high)) @ others_met
    return out / max(counts.rows, 1)


def partial_dependence(
    spark: SparkSession, df: DataFrame, ensemble: TreeEnsemble, columns: Sequence[str], grid: Mapping[str, Sequence[float]],
) -> DataFrame:
    """One row per feature and value of the grid: feature, value, margin."""
    counts = leaf_counts(df, ensemble, columns)
    rows = [
        (name, float(v), float(e))
        for name, values in grid.items() for v, e in zip(values, effect(ensemble, counts, list(columns).index(name), values))
    ]
    return spark.createDataFrame(rows, "feature string, value double, margin double")
