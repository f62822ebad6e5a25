"""Stratified folds of the training rows, and a search over parameter sets by successive halving."""

from __future__ import annotations

import math
from collections.abc import Callable, Hashable, Sequence
from dataclasses import dataclass

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

from custlens.functions.ranking import ordered_row_numbers
from custlens.operators.metrics import exact_auc
from custlens.operators.splits import SEED, fitting_rows, in_parallel

FOLDS = 5


def assign_folds(rows: DataFrame, label: str = "churn", folds: int = FOLDS, seed: int = SEED, key: str = "customer_id") -> DataFrame:
    """Adds ``fold`` (0 to folds - 1): sizes per class differ by one at most, repeatable by hash of the key.

    Rows are numbered within their class in the order of the hash, in even buckets, so no class is sorted in one task.
    """
    keyed = rows.withColumn("stratum", F.col(label).cast("string")).withColumn(
        "_hash", F.md5(F.concat(F.col(key).cast("string"), F.lit(f":fold:{seed}")).cast("binary")))
    numbered = ordered_row_numbers(keyed, F.substring("_hash", 1, 3), ["_hash", key], "_place", by=["stratum"])
    return numbered.withColumn("fold", ((F.col("_place") - 1) % folds).cast("int")).select(*rows.columns, "fold")


@dataclass
class Trial:
    """A parameter set and its scores on the folds it was tried on, in their order."""

    name: Hashable
    scores: list[float]

    @property
    def mean(self) -> float:
        return sum(self.scores) / len(self.scores)


def successive_halving(names: Sequence[Hashable], score: Callable[[Hashable, int], float], folds: int = FOLDS) -> list[Trial]:
    """All trials, best first: those that were tried on more folds, then those with the higher mean, then by name.

    All sets are scored on the first fold; the better half, by the mean over the folds so far, goes on to the next one. The
    last one goes through all folds. ``score`` gets a set and a fold, and must look at training rows only.
    """
    left, done = [Trial(name, []) for name in names], []
    for fold in range(folds):
        for trial, value in zip(left, in_parallel(lambda t: score(t.name, fold), left)):
            trial.scores.append(value)
        left.sort(key=lambda t: (-t.mean, str(t.name)))
        keep = math.ceil(len(left) / 2)
        if fold < folds - 1:
            left, gone = left[:keep], left[keep:]
            done = gone + done
    return left + done


def fold_auc(rows: DataFrame, fit: Callable[[DataFrame], object], fold: int, partitions: int = 8) -> float:
    """The area under the curve on a fold of a model fitted on the other ones. ``rows``: customer_id, features, label, fold."""
    with fitting_rows(rows.filter(F.col("fold") != fold), partitions) as train:
        model = fit(train)
    scored = model.transform(rows.filter(F.col("fold") == fold)).withColumn("p", vector_to_array("probability")[1])
    return exact_auc(scored, "label", "p").first()[0]
