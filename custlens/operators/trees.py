"""Fitted tree ensembles as arrays, and exact path-dependent attributions.

A fitted model is small (trees x 2^depth nodes) and travels with the task; the
customers stay partitioned. Attributions of a row sum, with the base value, to
the model's margin.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

ROWS_AT_ONCE = 256

#: Trees with up to this many leaves are evaluated by sets of leaves, a bit each.
MASK_LEAVES = 16


@dataclass
class LeafMasks:
    """Which leaves of all trees a row can still reach, by the interval that a feature's value lies in.

    Leaves are numbered from left to right. A split that a row passes to the right rules out the leaves to its left, so the
    row's leaf is the first one that no split rules out.
    """

    cuts: dict[int, np.ndarray]  # per feature, the thresholds of all trees in order
    reach: dict[int, np.ndarray]  # per feature, a row of sets (a tree each) per interval between the cuts
    leaf: np.ndarray  # values of the leaves, a row per tree
    lowest: np.ndarray  # the first member of every set

    def values(self, x: np.ndarray) -> np.ndarray:
        """The value of every row (rows) in every tree (columns)."""
        left = np.full((len(x), len(self.leaf)), (1 << MASK_LEAVES) - 1, dtype=np.uint16)
        for f, cuts in self.cuts.items():
            left &= self.reach[f][np.searchsorted(cuts, x[:, f])]
        return self.leaf.take(self.lowest[left] + np.arange(len(self.leaf)) * MASK_LEAVES)


def leaf_masks(ensemble: TreeEnsemble) -> LeafMasks | bool:
    """The sets of leaves of an ensemble; False if a tree has too many leaves."""
    leaf, splits = np.zeros((len(ensemble.scale), MASK_LEAVES)), []  # of splits: feature, cut, tree, set of leaves that stay
    for t in range(len(leaf)):
        seen = 0  # leaves so far, from left to right
        stack = [(0, None)]
        while stack:
            node, at = stack.pop()
            if at is not None:  # all leaves to the left of this split have been seen
                splits.append((int(ensemble.feature[t, node]), ensemble.threshold[t, node], t, ~((1 << seen) - (1 << at))))
            elif ensemble.feature[t, node] >= 0:
                stack += [(int(ensemble.right[t, node]), None), (node, seen), (int(ensemble.left[t, node]), None)]
            elif seen == MASK_LEAVES:
                return False
            else:
                leaf[t, seen] = ensemble.value[t, node]
                seen += 1
    cuts = {f: np.unique([c for g, c, _, _ in splits if g == f]) for f in sorted({s[0] for s in splits})}
    every = (1 << MASK_LEAVES) - 1
    reach = {f: np.full((len(c) + 1, len(leaf)), every, dtype=np.uint16) for f, c in cuts.items()}
    for f, cut, t, stay in splits:
        reach[f][np.searchsorted(cuts[f], cut) + 1 :, t] &= np.uint16(stay & every)
    sets = np.arange(every + 1)
    lowest = np.zeros(every + 1, dtype=np.int64)
    for i in reversed(range(MASK_LEAVES)):
        lowest[sets >> i & 1 == 1] = i
    return LeafMasks(cuts, reach, leaf, lowest)


@dataclass
class TreeEnsemble:
    """Nodes of all trees, one array row per tree. Left is ``x <= threshold``."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    cover: np.ndarray
    scale: np.ndarray  # factor of each tree in the margin
    logistic: bool
    _masks: LeafMasks | bool | None = field(default=None, repr=False, compare=False)  # made at the first use; False without

    def __getstate__(self) -> dict:
        return {**self.__dict__, "_masks": None}  # each task makes its own

    def outputs(self, x: np.ndarray) -> np.ndarray:
        """The value of every row (rows) in every tree (columns)."""
        if self._masks is None:
            self._masks = leaf_masks(self)
        if not self._masks:
            return self._walked(x)
        out = np.empty((len(x), len(self.scale)))
        for start in range(0, len(x), ROWS_AT_ONCE):
            part = slice(start, start + ROWS_AT_ONCE)
            out[part] = self._masks.values(x[part])
        return out

    def _walked(self, x: np.ndarray) -> np.ndarray:
        """The same by a walk down the trees, for trees of any size."""
        node = np.zeros((len(x), len(self.scale)), dtype=np.int64)
        tree = np.arange(len(self.scale))
        rows = np.arange(len(x))[:, None]
        for _ in range(self.feature.shape[1]):
            split = self.feature[tree, node]
            inner = split >= 0
            if not inner.any():
                break
            goes_left = x[rows, np.where(inner, split, 0)] <= self.threshold[tree, node]
            child = np.where(goes_left, self.left[tree, node], self.right[tree, node])
            node = np.where(inner, child, node)
        return self.value[tree, node]

    def margin(self, x: np.ndarray) -> np.ndarray:
        return self.outputs(x) @ self.scale

    def probability(self, x: np.ndarray) -> np.ndarray:
        m = self.margin(x)
        return 1.0 / (1.0 + np.exp(-m)) if self.logistic else m

    def leaf_paths(self) -> dict[int, dict[str, np.ndarray]]:
        """Leaves by number of distinct features on the path.

        Per feature: the interval a row must be in, and the share of training
        rows that pass its splits.
        """
        groups: dict[int, list] = {}
        for t in range(len(self.scale)):
            stack = [(0, {})]
            while stack:
                node, path = stack.pop()
                f = int(self.feature[t, node])
                if f < 0:
                    groups.setdefault(len(path), []).append((path, self.value[t, node] * self.scale[t]))
                    continue
                cut = self.threshold[t, node]
                for child, is_left in ((int(self.left[t, node]), True), (int(self.right[t, node]), False)):
                    low, high, share = path.get(f, (-math.inf, math.inf, 1.0))
                    share *= self.cover[t, child] / self.cover[t, node]
                    bounds = (low, min(high, cut), share) if is_left else (max(low, cut), high, share)
                    stack.append((child, {**path, f: bounds}))
        out = {}
        for m, leaves in groups.items():
            out[m] = {
                "value": np.array([v for _, v in leaves]),
                "feature": np.array([list(p) for p, _ in leaves], dtype=np.int64).reshape(len(leaves), m),
                "bounds": np.array([list(p.values()) for p, _ in leaves]).reshape(len(leaves), m, 3),
            }
        return out

    def base_value(self) -> float:
        return float(sum((g["value"] * g["bounds"][:, :, 2].prod(axis=1)).sum() for g in self.leaf_paths().values()))


#: Leaves with up to this many features on their path have a table of their attributions, 2^features rows each.
TABLE_FEATURES = 6


def leaf_shares(o: np.ndarray, z: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Attributions (..., leaf, feature) of the features on the leaves' paths.

    In one leaf with shares z and indicators o, the subset sums of a feature
    are the coefficients of the product of (z_j + o_j t) over the others.
    """
    m = z.shape[1]
    size_weight = [math.factorial(s) * math.factorial(m - 1 - s) / math.factorial(m) for s in range(m)]
    out = np.empty(o.shape)
    for i in range(m):
        terms = [np.ones(o.shape[:-1])]
        for j in range(m):
            if j == i:
                continue
            grown = [terms[0] * z[:, j]]
            grown += [terms[s] * z[:, j] + terms[s - 1] * o[..., j] for s in range(1, len(terms))]
            terms = [*grown, terms[-1] * o[..., j]]
        subsets = sum(w * t for w, t in zip(size_weight, terms))
        out[..., i] = value * (o[..., i] - z[:, i]) * subsets
    return out


def with_tables(groups: dict[int, dict[str, np.ndarray]]) -> dict[int, dict[str, np.ndarray]]:
    """``groups`` with a table of all attributions of a leaf, by which of its features are in their intervals."""
    out = {}
    for m, g in groups.items():
        out[m] = dict(g)
        if 0 < m <= TABLE_FEATURES:
            patterns = (np.arange(1 << m)[:, None] >> np.arange(m) & 1).astype(float)
            o = np.broadcast_to(patterns[:, None, :], (1 << m, len(g["value"]), m))
            out[m]["table"] = leaf_shares(o, g["bounds"][:, :, 2], g["value"])
    return out


def shapley(x: np.ndarray, groups: dict[int, dict[str, np.ndarray]], width: int) -> np.ndarray:
    """Attributions of the rows of ``x``, looked up where ``with_tables`` has made tables."""
    out = np.zeros((len(x), width))
    for m, g in groups.items():
        if m == 0:
            continue
        low, high, z = (g["bounds"][:, :, i] for i in range(3))
        picked = x[:, g["feature"]]
        inside = (picked > low) & (picked <= high)
        if "table" in g:
            pattern = inside @ (1 << np.arange(m))
            shares = g["table"][pattern, np.arange(len(z))]
        else:
            shares = leaf_shares(inside.astype(float), z, g["value"])
        for i in range(m):
            onehot = np.zeros((len(z), width))
            onehot[np.arange(len(z)), g["feature"][:, i]] = 1.0
            out += shares[..., i] @ onehot
    return out


def load_ensemble(spark: SparkSession, model, path: str) -> TreeEnsemble:
    """Arrays of a saved Spark tree model; ``path`` is where it was saved.

    Only continuous features are supported: the model inputs have no others.
    """
    data = spark.read.parquet(f"{path}/data")
    nodes = data.select("treeID", "nodeData.*") if "treeID" in data.columns else data.withColumn("treeID", F.lit(0))
    rows = nodes.select(
        "treeID", "id", "prediction", "impurityStats", "leftChild", "rightChild",
        F.col("split.featureIndex").alias("feature"), F.col("split.leftCategoriesOrThreshold").alias("cut"),
        F.col("split.numCategories").alias("categories"),
    ).collect()  # the model itself
    trees = 1 + max(r.treeID for r in rows)
    width = 1 + max(r.id for r in rows)
    kind = type(model).__name__
    boosted = kind.startswith("GBT")
    classes = kind.endswith("ClassificationModel") and not boosted
    shape = (trees, width)
    e = TreeEnsemble(
        np.full(shape, -1), np.zeros(shape), np.zeros(shape, int), np.zeros(shape, int), np.zeros(shape),
        np.ones(shape), np.ones(trees), boosted and "Classification" in kind,
    )
    for r in rows:
        if r.feature >= 0 and r.categories != -1:
            raise ValueError("categorical splits are not supported")
        at = (r.treeID, r.id)
        e.feature[at] = r.feature
        e.threshold[at] = r.cut[0] if r.feature >= 0 else 0.0
        e.left[at], e.right[at] = r.leftChild, r.rightChild
        e.cover[at] = sum(r.impurityStats) if classes else r.impurityStats[0]
        e.value[at] = r.impurityStats[1] / sum(r.impurityStats) if classes else r.prediction
    if boosted:
        # A boosted classifier's probability is the logistic of twice the sum.
        e.scale = np.array(model.treeWeights) * (2.0 if e.logistic else 1.0)
    else:
        e.scale = np.full(trees, 1.0 / trees)
    return e


def explanation(ensemble: TreeEnsemble, columns: list[str]) -> Column:
    """Struct (margin, base, attributions) of a row; Arrow batches, no shuffle."""
    groups, base = with_tables(ensemble.leaf_paths()), ensemble.base_value()
    width = len(columns)

    @F.pandas_udf("struct<margin double, base double, attributions array<double>>")
    def explain(values: pd.Series) -> pd.DataFrame:
        margins, phis = [], []
        for start in range(0, len(values), ROWS_AT_ONCE):
            x = np.stack(values.iloc[start : start + ROWS_AT_ONCE])
            margins.append(ensemble.margin(x))
            phis.extend(shapley(x, groups, width))
        return pd.DataFrame({"margin": np.concatenate(margins), "base": base, "attributions": phis})

    return explain(F.array(*[F.col(c).cast("double") for c in columns]))


def with_tree_factors(df: DataFrame, ensemble: TreeEnsemble, columns: list[str]) -> DataFrame:
    """Adds ``margin``, ``base`` and the factor array of every row."""
    factors = F.array(*[
        F.struct(
            F.lit(c).alias("feature"), F.col(c).cast("double").alias("value"),
            F.col("_why.attributions")[i].alias("attribution"),
        )
        for i, c in enumerate(columns)
    ])
    return df.withColumn("_why", explanation(ensemble, columns)).select(
        *df.columns, F.col("_why.margin").alias("margin"), F.col("_why.base").alias("base"), factors.alias("factors")
    )
