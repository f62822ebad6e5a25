"""Local linear surrogate of a model around single customers.

Features are cut at the quartiles of the training rows. Bins are drawn by
their training frequency, and values inside them; the surrogate is a weighted
ridge on "same bin as the customer". The draws do not depend on the customer,
so a task makes and scores them once, with one call of the model; per customer
remain the comparison of bins and the small fit. A draw's weight follows from
its number of equal bins, which is looked up, and the sums that the fits need
are products of many customers' weights with the draws. Quartiles and bin
statistics are Spark aggregates; the customers to explain are dealt evenly to
all cores.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from custlens.functions.ranking import exact_quantiles
from custlens.operators.splits import SEED, spread

SAMPLES = 5000
FEATURES = 6

#: Customers fitted at once, with a byte per draw each, and those whose weights are held at once, with a double per draw.
FITS_AT_ONCE, WEIGHTS_AT_ONCE = 4096, 256


@dataclass
class Bins:
    """Cut points per feature, and per bin its frequency and spread in training."""

    names: list[str]
    cuts: list[list[float]]
    share: list[np.ndarray]
    mean: list[np.ndarray]
    deviation: list[np.ndarray]
    low: list[np.ndarray]
    high: list[np.ndarray]

    def bin_of(self, x: np.ndarray) -> np.ndarray:
        """The bins of a matrix of rows, feature by feature."""
        return np.stack([np.searchsorted(c, x[:, j]) for j, c in enumerate(self.cuts)], axis=1)

    def rule(self, j: int, b: int) -> str:
        c, name = self.cuts[j], self.names[j]
        if b == 0:
            return f"{name} <= {c[0]:.2f}"
        if b == len(c):
            return f"{name} > {c[-1]:.2f}"
        return f"{c[b - 1]:.2f} < {name} <= {c[b]:.2f}"


def fit_bins(train: DataFrame, columns: list[str]) -> Bins:
    """Quartile bins of all features in two aggregates; four rows per feature come back."""
    long = train.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in columns
    ])))
    cuts = exact_quantiles(long, "value", {"q1": 0.25, "q2": 0.5, "q3": 0.75}, by=["feature"])
    points = F.array_distinct(F.array("q1", "q2", "q3")).alias("cuts")
    table = cuts.select("feature", points)
    bin_no = F.size(F.filter("cuts", lambda c: c < F.col("value")))
    stats = (
        long.join(F.broadcast(table), "feature")  # one row per feature
        .groupBy("feature", "cuts", bin_no.alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("sd"),
             F.min("value").alias("low"), F.max("value").alias("high"))
    ).collect()
    out = Bins(list(columns), [], [], [], [], [], [])
    for name in columns:
        mine = {r.bin: r for r in stats if r.feature == name}
        points = next(iter(mine.values())).cuts
        total = sum(r.n for r in mine.values())
        bins = range(len(points) + 1)
        get = lambda field: np.array([float(mine[b][field]) if b in mine else 0.0 for b in bins])
        out.cuts.append(list(points))
        out.share.append(get("n") / total)
        for target, field in ((out.mean, "mean"), (out.deviation, "sd"), (out.low, "low"), (out.high, "high")):
            target.append(get(field))
    return out


def _draws(bins: Bins, samples: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Perturbed rows and their bins. Values follow the bin's normal distribution cut at its ends, by inverse CDF."""
    rng, normal = np.random.default_rng(seed), NormalDist()
    rows, places = np.empty((samples, len(bins.names))), np.empty((samples, len(bins.names)), dtype=np.int64)
    for j in range(len(bins.names)):
        b = rng.choice(len(bins.share[j]), size=samples, p=bins.share[j])
        u = rng.random(samples)
        for k in range(len(bins.share[j])):
            mean, deviation, low, high = (float(v[j][k]) for v in (bins.mean, bins.deviation, bins.low, bins.high))
            mine = np.flatnonzero(b == k)
            if deviation == 0.0 or low == high:
                rows[mine, j] = mean
                continue
            first, last = normal.cdf((low - mean) / deviation), normal.cdf((high - mean) / deviation)
            share = np.clip(first + u[mine] * (last - first), 1e-12, 1.0 - 1e-12)
            rows[mine, j] = np.clip([mean + deviation * normal.inv_cdf(p) for p in share], low, high)
        places[:, j] = b
    return rows, places


def _select(
    total: np.ndarray, sums: np.ndarray, moment: np.ndarray, whole: np.ndarray, products: Callable[[np.ndarray], np.ndarray], keep: int,
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward selection by weighted R2, then a ridge (alpha 1) on the chosen features, for many customers (rows) at once.

    Weighted sums are given: of 1, of the features z (0 or 1), of z with the centred y, and of its square. ``products`` gives
    those of z with one feature per customer, asked for chosen features only. What a feature adds to R2 follows from its
    part that the chosen ones leave over; a step takes the chosen one's part out of all others, so no step solves a system.
    """
    customers, width = sums.shape
    every, keep = np.arange(customers), min(keep, width)
    mean = sums / total[:, None]
    spread_of = sums - sums * mean
    size, rest = spread_of, moment
    chosen, taken = np.zeros((customers, keep), dtype=np.int64), np.zeros((customers, width), dtype=bool)
    gram, left, share = (np.zeros((customers, keep, width)) for _ in range(3))
    for i in range(keep):
        free = size > 1e-10 * total[:, None]  # not a sum of the chosen ones, or constant
        gain = np.where(free, rest * rest / np.where(free, size, 1.0), 0.0)
        gain[taken] = -1.0
        k = gain.argmax(axis=1)
        chosen[:, i], taken[every, k] = k, True
        if i == keep - 1:  # what the last one has with the others is known from them
            gram[every, i, k] = spread_of[every, k]
            for j in range(i):
                gram[every, i, chosen[:, j]] = gram[every, j, k]
            break
        gram[:, i] = products(k) - sums * mean[every, k][:, None]
        own = gram[:, i]
        for j in range(i):
            own = own - share[:, j] * left[every, j, k][:, None]
        left[:, i] = np.where(free[every, k][:, None], own, 0.0)
        share[:, i] = left[:, i] / np.where(free[every, k], size[every, k], 1.0)[:, None]
        rest = rest - share[:, i] * rest[every, k][:, None]
        size = size - share[:, i] * left[:, i]
    g = np.take_along_axis(gram, np.broadcast_to(chosen[:, None, :], (customers, keep, keep)), axis=2)
    m = np.take_along_axis(moment, chosen, axis=1)
    beta = np.linalg.solve(g + np.eye(keep), m[:, :, None])[:, :, 0]
    unexplained = whole - 2.0 * (beta * m).sum(axis=1) + np.einsum("ci,cij,cj->c", beta, g, beta)
    return chosen, beta, np.where(whole > 0, 1.0 - unexplained / np.where(whole > 0, whole, 1.0), 0.0)


def _fit(z: np.ndarray, y: np.ndarray, w: np.ndarray, keep: int) -> tuple[list[int], np.ndarray, float]:
    """The surrogate of one customer, from its own matrix of equal bins."""
    total = w.sum()
    yc = y - (w @ y) / total
    chosen, beta, r2 = _select(
        np.array([total]), (w @ z)[None], (z.T @ (w * yc))[None], np.array([(w * yc * yc).sum()]), lambda k: ((w * z[:, k[0]]) @ z)[None], keep)
    return chosen[0].tolist(), beta[0], float(r2[0])


class _Draws:
    """The draws of a task, their scores, and the sums over them that the fits of customers need.

    A customer is the bins of its row and its probability; its row is one more draw, in the same bin everywhere.
    """

    def __init__(self, places: np.ndarray, y: np.ndarray, bins: Bins):
        sizes, self.width = [len(c) + 1 for c in bins.cuts], places.shape[1]
        # By the number of features in the same bin.
        self.weights = np.sqrt(np.exp(-np.arange(self.width, -1.0, -1.0) / (math.sqrt(self.width) * 0.75) ** 2))
        # A column of ones, and one per bin but the first of a feature, whose sums are what the others leave of the total.
        self.first = np.concatenate([[0], np.cumsum(sizes)[:-1] - np.arange(1, self.width)]).astype(np.int64)
        self.at = np.zeros((len(places), 1 + sum(sizes) - self.width))
        self.at[:, 0] = 1.0
        self.of_feature = np.zeros((self.at.shape[1], self.width))
        for j, n in enumerate(sizes):
            for b in range(1, n):
                self.at[places[:, j] == b, self.first[j] + b] = 1.0
                self.of_feature[self.first[j] + b, j] = 1.0
        self.inside = [[np.flatnonzero(places[:, j] == b) for b in range(n)] for j, n in enumerate(sizes)]
        # How many bins of two neighbouring features are equal, by the bins of a customer.
        kind = np.min_scalar_type(self.width)
        self.equal = []
        for j in range(0, self.width, 2):
            found = np.zeros((1, len(places)), dtype=kind)
            for i in range(j, min(j + 2, self.width)):
                same = (places[:, i] == np.arange(sizes[i])[:, None]).astype(kind)
                found = (found[:, None] + same[None]).reshape(-1, len(places))
            self.equal.append(found)
        self.sizes = sizes
        self.shift = (y.min() + y.max()) / 2.0  # no digits are lost in sums of y - shift
        self.y = y - self.shift

    def _matches(self, home: np.ndarray) -> np.ndarray:
        """How many bins of every draw are the customer's."""
        out = None
        for i, table in enumerate(self.equal):
            code = home[:, 2 * i]
            if 2 * i + 1 < self.width:
                code = code * self.sizes[2 * i + 1] + home[:, 2 * i + 1]
            out = table[code] if out is None else np.add(out, table[code], out=out)
        return out

    def _of_homes(self, sums: np.ndarray, home: np.ndarray) -> np.ndarray:
        """From sums by column of ``at`` those of the customers' own bins."""
        return np.where(home == 0, sums[:, :1] - sums @ self.of_feature, np.take_along_axis(sums, self.first + home, axis=1))

    def fits(self, home: np.ndarray, own: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Chosen features, their coefficients and R2 of customers with bins ``home`` and probabilities ``own``."""
        y0, matches = own - self.shift, np.empty((len(home), len(self.at)), dtype=self.equal[0].dtype)
        shape = (len(home), self.at.shape[1])
        weight, moment, square = np.empty(shape), np.empty(shape), np.empty(len(home))
        for start in range(0, len(home), WEIGHTS_AT_ONCE):
            part = slice(start, start + WEIGHTS_AT_ONCE)
            matches[part] = self._matches(home[part])
            w = self.weights.take(matches[part])
            weight[part] = w @ self.at
            w *= self.y
            moment[part] = w @ self.at
            square[part] = w @ self.y
        # The customer's own row has the weight 1.
        total, sum_y, square = weight[:, 0] + 1.0, moment[:, 0] + y0, square + y0 * y0
        sums = self._of_homes(weight, home) + 1.0
        moment = self._of_homes(moment, home) + y0[:, None] - sums * (sum_y / total)[:, None]

        def products(k: np.ndarray) -> np.ndarray:
            out = np.empty(shape)
            bin_of = home[np.arange(len(home)), k]
            order = np.lexsort((bin_of, k))
            new = np.flatnonzero((np.diff(k[order]) != 0) | (np.diff(bin_of[order]) != 0)) + 1
            for group in np.split(order, new):
                draws = self.inside[k[group[0]]][bin_of[group[0]]]
                at = self.at[draws]
                for start in range(0, len(group), WEIGHTS_AT_ONCE):
                    part = group[start : start + WEIGHTS_AT_ONCE]
                    out[part] = self.weights.take(matches[part].take(draws, axis=1)) @ at
            return self._of_homes(out, home) + 1.0

        return _select(total, sums, moment, square - sum_y * sum_y / total, products, keep)


def local_surrogates(
    df: DataFrame, bins: Bins, probability: Callable[[np.ndarray], np.ndarray],
    features: int = FEATURES, samples: int = SAMPLES, key: str = "customer_id", seed: int = SEED,
) -> DataFrame:
    """(key, churn_probability, surrogate_score, factors) per row of ``df``, the customers to explain.

    ``probability`` maps a matrix of feature rows to churn probabilities. The
    draws depend on the seed only.
    """
    names = bins.names

    def explain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        draws, rules = None, [[bins.rule(j, b) for b in range(len(c) + 1)] for j, c in enumerate(bins.cuts)]
        texts = pa.array([r for some in rules for r in some], pa.string())
        first = np.concatenate([[0], np.cumsum([len(some) for some in rules])[:-1]])
        impacts = pa.array(["Protective (Reduces Risk)", "Increases Churn Risk"], pa.string())
        for batch in batches:
            if not batch.num_rows:
                continue
            if draws is None:
                rows, places = _draws(bins, samples - 1, seed)
                draws = _Draws(places, probability(rows), bins)
            x = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False) for c in names]).astype(float)
            own, homes = probability(x), bins.bin_of(x)
            for start in range(0, len(x), FITS_AT_ONCE):
                part = slice(start, start + FITS_AT_ONCE)
                home = homes[part]
                chosen, beta, r2 = draws.fits(home, own[part], features)
                order = np.argsort(-np.abs(beta), axis=1, kind="stable")
                chosen, beta = (np.take_along_axis(a, order, axis=1) for a in (chosen, beta))
                rounded = lambda a: pa.array([round(v, 4) for v in a.ravel().tolist()], pa.float64())
                factors = pa.StructArray.from_arrays([
                    texts.take(pa.array((first[chosen] + np.take_along_axis(home, chosen, axis=1)).ravel())), rounded(beta),
                    impacts.take(pa.array((beta > 0).ravel().astype(np.int64))),
                ], names=["rule", "weight", "impact"])
                ends = pa.array(np.arange(len(home) + 1) * chosen.shape[1], pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(key)[part], rounded(own[part]), rounded(r2), pa.ListArray.from_arrays(ends, factors)],
                    names=[key, "churn_probability", "surrogate_score", "factors"])

    kind = dict(df.dtypes)[key]
    schema = (
        f"{key} {kind}, churn_probability double, surrogate_score double, "
        "factors array<struct<rule string, weight double, impact string>>"
    )
    rows = spread(df.select(key, *[F.col(c).cast("double").alias(c) for c in names]), key)
    return rows.mapInArrow(explain, schema)
