"""Explanations per row: the quick ways against plain ones, and how the rows are dealt."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from custlens.operators import splits, surrogate, trees


def plain_fit(z, y, w, keep):
    """Forward selection that solves the whole system for every candidate."""
    total = w.sum()
    zc, yc = z - (w @ z) / total, y - (w @ y) / total
    gram, moment, whole = zc.T @ (zc * w[:, None]), zc.T @ (w * yc), (w * yc * yc).sum()

    def solve(chosen, alpha):
        g, m = gram[np.ix_(chosen, chosen)], moment[chosen]
        beta = np.linalg.lstsq(g + alpha * np.eye(len(chosen)), m, rcond=None)[0]
        return beta, 1.0 - (whole - 2.0 * beta @ m + beta @ g @ beta) / whole

    chosen = []
    for _ in range(keep):
        chosen.append(max((j for j in range(z.shape[1]) if j not in chosen), key=lambda j: solve([*chosen, j], 0.0)[1]))
    return (chosen, *solve(chosen, 1.0))


def test_forward_selection_solves_no_system_per_candidate(monkeypatch):
    rng = np.random.default_rng(5)
    z = (rng.random((900, 9)) < rng.random(9)).astype(float)
    z[:, 4] = 1.0  # constant
    y = z @ rng.normal(size=9) + z[:, 0] * z[:, 1] + 0.1 * rng.normal(size=900)
    w = rng.random(900) + 0.1
    expected = plain_fit(z, y, w, 6)
    monkeypatch.delattr(np.linalg, "lstsq")
    chosen, beta, r2 = surrogate._fit(z, y, w, 6)
    assert chosen == expected[0]
    assert np.allclose(beta, expected[1], atol=1e-9) and abs(r2 - expected[2]) < 1e-9


def test_more_features_wanted_than_there_are():
    z = np.ones((20, 2))
    z[:10, 0] = 0.0
    chosen, beta, r2 = surrogate._fit(z, z[:, 0] * 3.0, np.ones(20), 6)
    assert chosen == [0, 1] and abs(beta[1]) < 1e-9 and 0.9 < r2 <= 1.0


def test_customers_to_explain_are_dealt_to_all_cores(spark):
    rows = spark.range(400).select(F.col("id").alias("customer_id"), (F.col("id") % 7).cast("double").alias("a")).coalesce(1)
    bins = surrogate.Bins(["a"], [[2.0, 4.0]], [np.array([.4, .3, .3])], *[[np.array([1.0, 3.5, 5.5])]] * 1,
                          [np.zeros(3)], [np.zeros(3)], [np.full(3, 6.0)])
    out = surrogate.local_surrogates(rows, bins, lambda x: x[:, 0] / 10.0, samples=30)
    assert out.rdd.getNumPartitions() == splits.TASKS_PER_CORE * spark.sparkContext.defaultParallelism
    assert out.count() == 400


def test_tables_hold_the_attributions_of_every_pattern():
    rng = np.random.default_rng(3)
    for m in (1, 2, 4, trees.TABLE_FEATURES, trees.TABLE_FEATURES + 1):
        low = rng.normal(size=(11, m)) - 1.0
        bounds = np.stack([low, low + 2.0 * rng.random((11, m)), rng.random((11, m))], axis=2)
        group = {"value": rng.normal(size=11), "feature": np.array([rng.permutation(9)[:m] for _ in range(11)]), "bounds": bounds}
        tabled = trees.with_tables({m: group})
        assert ("table" in tabled[m]) == (m <= trees.TABLE_FEATURES)
        x = rng.normal(size=(50, 9))
        assert np.array_equal(trees.shapley(x, tabled, 9), trees.shapley(x, {m: group}, 9))
        # What the features of a leaf get is what the row's value differs from the mean by.
        inside = (x[:, group["feature"]] > low) & (x[:, group["feature"]] <= bounds[:, :, 1])
        reached = (group["value"] * inside.all(axis=2)).sum(axis=1) - (group["value"] * bounds[:, :, 2].prod(axis=1)).sum()
        assert np.allclose(trees.shapley(x, tabled, 9).sum(axis=1), reached)
