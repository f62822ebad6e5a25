"""Exact k-nearest-neighbour vote against a bounded number of labelled rows.

The classifier is fitted on at most ``FIT_ROWS`` training rows, picked by a hash of their key; that is its size, like
the number of trees of a forest. They are one matrix on every executor, and the rows to classify pass it in Arrow
batches: no vector is shuffled, and the work grows with the rows to classify alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

NEIGHBOURS = 15
#: Labelled rows of the fit; with 34 doubles each, 20,000 are a matrix of 5 MB.
FIT_ROWS = 20_000
QUERY_ROWS = 256


def fit_rows(train: DataFrame, rows: int = FIT_ROWS) -> DataFrame:
    """The ``rows`` training rows with the smallest hash of ``tid``; all of them if there are no more."""
    return train.orderBy(F.md5(F.concat(F.col("tid").cast("string"), F.lit(":knn")).cast("binary")), "tid").limit(rows)


def nearest_neighbours(queries: DataFrame, train: DataFrame, k: int = NEIGHBOURS, rows: int = FIT_ROWS) -> DataFrame:
    """(qid, tid, d, y) for the k nearest rows of the fit for every query.

    ``queries`` has (qid, x), ``train`` (tid, x, y); x is an array of doubles. Ties in distance go to the smaller tid.
    """
    fitted = sorted(fit_rows(train.select("tid", "x", "y"), rows).collect())  # at most ``rows`` rows
    ids = np.array([r.tid for r in fitted], dtype=np.int64)
    x, y = np.array([r.x for r in fitted], dtype=np.float64), np.array([r.y for r in fitted], dtype=np.float64)
    model = queries.sparkSession.sparkContext.broadcast((ids, x, y))

    def nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, x, y = model.value
        size = (x**2).sum(axis=1) if len(x) else np.zeros(0)
        for batch in batches:
            found = []
            for start in range(0, len(batch) if len(x) else 0, QUERY_ROWS):
                part = batch.iloc[start:start + QUERY_ROWS]
                q = np.stack(part["x"])
                q_size = (q**2).sum(axis=1)
                # Quick squared distances pick the candidates, with room for their rounding errors.
                quick = size + q_size[:, None] - 2.0 * (q @ x.T)
                room = 1e-9 * (size.max() + q_size + 1.0)
                limit = np.partition(quick, k - 1, axis=1)[:, k - 1] + room if len(x) > k else np.full(len(quick), np.inf)
                for i, qid in enumerate(part["qid"]):
                    near = np.flatnonzero(quick[i] <= limit[i])
                    d = np.sqrt(((x[near] - q[i]) ** 2).sum(axis=1))
                    best = np.lexsort((ids[near], d))[:k]
                    found.append((np.full(len(best), qid), ids[near[best]], d[best], y[near[best]]))
            if found:
                yield pd.DataFrame(dict(zip(("qid", "tid", "d", "y"), map(np.concatenate, zip(*found)))))

    return queries.select("qid", "x").mapInPandas(nearest, "qid long, tid long, d double, y double")


def distance_vote(neighbours: DataFrame) -> DataFrame:
    """Share of class 1 weighted by 1/distance; exact matches outvote all others."""
    d, y = F.col("d"), F.col("y")
    sums = neighbours.groupBy("qid").agg(
        F.count_if(d == 0).alias("zeros"),
        F.sum(F.when(d == 0, y)).alias("zero_y"),
        F.sum(F.when(d > 0, 1.0 / d)).alias("w"),
        F.sum(F.when(d > 0, y / d)).alias("wy"),
    )
    return sums.select(
        "qid",
        F.when(F.col("zeros") > 0, F.col("zero_y") / F.col("zeros")).otherwise(F.try_divide("wy", "w")).alias("probability"),
    )
