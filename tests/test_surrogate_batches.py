"""Local surrogates of many customers at once against one by one, and tree values by sets of leaves against a walk."""

from __future__ import annotations

import math
import pickle

import numpy as np
import pytest

from custlens.operators import surrogate, trees


def some_bins(rng, sizes):
    """Bins of features with so many bins each, and draws from them."""
    cuts = [[float(v) for v in range(n - 1)] for n in sizes]
    blank = [np.zeros(n) for n in sizes]
    bins = surrogate.Bins([f"f{j}" for j in range(len(sizes))], cuts, *[blank] * 5)
    places = np.stack([rng.choice(n, size=400, p=rng.dirichlet(np.full(n, 3.0))) for n in sizes], axis=1)
    return bins, places


def one_by_one(places, y, home, own, keep):
    """The fit of a customer from the matrix of its equal bins."""
    same = np.vstack([np.ones(places.shape[1]), places == home])
    width = math.sqrt(places.shape[1]) * 0.75
    other = places.shape[1] - same.sum(axis=1)
    return surrogate._fit(same, np.concatenate([[own], y]), np.sqrt(np.exp(-other / width**2)), keep)


@pytest.mark.parametrize("sizes", [[4, 3, 1, 4, 2, 4, 4], [2, 4], [1, 1, 1], [3]])
def test_customers_fitted_together_get_what_each_gets_alone(monkeypatch, sizes):
    rng = np.random.default_rng(7)
    bins, places = some_bins(rng, sizes)
    y = 1.0 / (1.0 + np.exp(-(places @ rng.normal(size=len(sizes)) + places[:, 0] * places[:, -1])))
    home = np.stack([rng.integers(0, n, 70) for n in sizes], axis=1)
    own = rng.random(70)
    expected = [one_by_one(places, y, h, p, 6) for h, p in zip(home, own)]
    monkeypatch.setattr(surrogate, "WEIGHTS_AT_ONCE", 16)
    monkeypatch.delattr(surrogate, "_fit")  # nobody is fitted alone
    chosen, beta, r2 = surrogate._Draws(places, y, bins).fits(home, own, 6)
    for i, (c, b, r) in enumerate(expected):
        same = (places[:, c] == home[i][c]).mean(axis=0)
        free = (same > 0) & (same < 1)  # a bin with all draws, or none, explains nothing
        assert chosen[i][free].tolist() == np.array(c)[free].tolist()
        assert np.allclose(np.where(free, beta[i], 0.0), np.where(free, b, 0.0), atol=1e-9) and abs(r2[i] - r) < 1e-9


def test_a_model_that_says_the_same_of_all_leaves_nothing_to_explain():
    bins, places = some_bins(np.random.default_rng(1), [4, 3, 4])
    chosen, beta, r2 = surrogate._Draws(places, np.full(len(places), 0.3), bins).fits(places[:9], np.full(9, 0.3), 2)
    assert chosen.tolist() == [[0, 1]] * 9 and not beta.any() and not r2.any()


def grown(rng, leaves, width):
    """Arrays of a tree with so many leaves: feature, threshold, left, right, value."""
    f, c, left, right, value = [-1], [0.0], [0], [0], [rng.normal()]
    ends = [0]
    while len(ends) < leaves:
        node = ends.pop(rng.integers(len(ends)))
        f[node], c[node], left[node], right[node] = int(rng.integers(width)), float(rng.integers(-3, 4)) / 2.0, len(f), len(f) + 1
        for _ in range(2):
            ends.append(len(f))
            f.append(-1), c.append(0.0), left.append(0), right.append(0), value.append(rng.normal())
    return f, c, left, right, value


@pytest.mark.parametrize("leaves", [1, 2, 5, trees.MASK_LEAVES, trees.MASK_LEAVES + 1])
def test_sets_of_leaves_give_the_values_of_a_walk(leaves):
    rng = np.random.default_rng(leaves)
    grow = [grown(rng, int(n), 5) for n in rng.integers(1, leaves + 1, 30)] + [grown(rng, leaves, 5)]
    nodes = max(len(t[0]) for t in grow)
    arrays = [np.array([[*t[i], *[(-1, 0.0, 0, 0, 0.0)[i]] * (nodes - len(t[i]))] for t in grow]) for i in range(5)]
    ensemble = trees.TreeEnsemble(*arrays, np.ones((len(grow), nodes)), rng.random(len(grow)), True)
    x = rng.integers(-8, 9, size=(700, 5)) / 4.0  # many lie on a cut
    x[::50, 1], x[::70, 2] = np.nan, np.inf
    expected = ensemble._walked(x)
    assert np.array_equal(ensemble.outputs(x), expected) and ensemble.outputs(x[:0]).shape == (0, len(grow))
    assert (trees.leaf_masks(ensemble) is False) == (leaves > trees.MASK_LEAVES)
    assert np.array_equal(pickle.loads(pickle.dumps(ensemble)).margin(x), expected @ ensemble.scale)
