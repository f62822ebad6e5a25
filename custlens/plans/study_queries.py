"""Queries on studies around the models: many cutoffs, folds, encodings, effects."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from custlens.functions.columns import days_before, round_even
from custlens.functions.stages import stage
from custlens.operators import effects, folds, kernel_svm, smote, trends
from custlens.operators.backtest import backtest as run_backtest
from custlens.operators.encoding import HotCodes, TargetEncoding
from custlens.operators.metrics import classifier_metrics, exact_auc
from custlens.operators.orders import latest_date
from custlens.operators.trees import TreeEnsemble
from custlens.plans import tables, training
from custlens.plans.serving import rule_margin

BACKTEST_DAYS = (90, 120, 180, 270, 365)


def backtest(s, d):
    """Features and labels at five cutoffs, in days before the last line."""
    lines = tables.cleaned(s, d)
    last = latest_date(lines)
    return run_backtest(lines, [days_before(last, n) for n in BACKTEST_DAYS])


def _training_folds(s, d):
    """The training rows with their folds."""
    return stage(s, d, "training_folds", lambda: folds.assign_folds(training.splits(s, d, "churn").filter("split = 'train'")))


def cv_folds(s, d):
    return _training_folds(s, d).select("customer_id", "churn", "fold")


DIVISORS = {"divisor_02": 2.0, "divisor_05": 5.0, "divisor_10": 10.0, "divisor_20": 20.0}


def halving_search(s, d):
    """Successive halving over the divisor of the churn rule, on the folds of the training rows."""
    rows = _training_folds(s, d)

    def score(name, fold):
        margin = F.col("recency_days") / 100.0 - F.col("frequency") / DIVISORS[name]
        return exact_auc(rows.filter(F.col("fold") == fold).withColumn("margin", margin), "churn", "margin").first()[0]

    trials = folds.successive_halving(list(DIVISORS), score)
    found = [(k + 1, t.name, len(t.scores), round(t.mean, 9)) for k, t in enumerate(trials)]
    return s.createDataFrame(found, "place int, candidate string, folds int, mean_auc double")


def target_encoding(s, d):
    """The country of every customer as its churn rate: without the own fold in training, whole elsewhere."""
    train = _training_folds(s, d)
    encoding = TargetEncoding.fit(train, "primary_country")
    rest = training.splits(s, d, "churn").filter("split <> 'train'").withColumn("fold", F.lit(None).cast("int"))
    out = encoding.apply(train.unionByName(rest), "country_rate")
    return out.select("customer_id", "split", round_even("country_rate", 9).alias("country_rate"))


def hot_codes(s, d):
    """Codes of the three most frequent countries of the training rows, and of all others, as one text."""
    codes = HotCodes.fit(_training_folds(s, d), "primary_country", most=3)
    return tables.features(s, d).select("customer_id", F.concat(*[c.cast("string") for c in codes.columns().values()]).alias("codes"))


EFFECT_COLUMNS = ["recency_days", "frequency", "total_spend"]
EFFECT_GRID = {"recency_days": (30.0, 90.0, 150.0, 365.0), "frequency": (1.0, 2.0, 3.0, 5.0, 8.0), "total_spend": (100.0, 500.0, 1000.0)}


def rule_trees() -> TreeEnsemble:
    """Two small trees with fixed cuts, so that SQL can state their margin."""
    none = -1
    return TreeEnsemble(
        feature=np.array([[0, 1, none, none, 1, none, none], [2, none, 0, none, none, none, none]]),
        threshold=np.array([[90.0, 5.0, 0, 0, 2.0, 0, 0], [500.0, 0, 200.0, 0, 0, 0, 0]]),
        left=np.array([[1, 2, 0, 0, 5, 0, 0], [1, 0, 3, 0, 0, 0, 0]]), right=np.array([[4, 3, 0, 0, 6, 0, 0], [2, 0, 4, 0, 0, 0, 0]]),
        value=np.array([[0, 0, -0.2, -0.8, 0, 1.0, 0.4], [0, 0.3, 0, -0.4, 0.1, 0, 0]]), cover=np.ones((2, 7)), scale=np.ones(2), logistic=False)


def partial_dependence(s, d):
    out = effects.partial_dependence(s, tables.features(s, d), rule_trees(), EFFECT_COLUMNS, EFFECT_GRID)
    return out.withColumn("margin", round_even("margin", 9))


def frequency_slope(s, d):
    out = trends.frequency_slope(tables.cleaned(s, d), tables.cutoff(s, d))
    return out.withColumn("slope", round_even("slope", 9))


def revenue_forecast(s, d):
    out = trends.revenue_forecast(tables.cleaned(s, d))
    return out.select("month", *[round_even(c, 4).alias(c) for c in out.columns if c != "month"])


def next_category(s, d):
    segments = tables.features(s, d).select("customer_id", F.col("engagement_tier").alias("segment"))
    return trends.next_category(tables.cleaned(s, d), tables.cutoff(s, d), segments)


def smote_rows(s, d):
    """For every training row of the smaller class how many synthetic rows it gives, and whether all lie on their segments."""
    train = training.scaler(s, d, "churn").apply(training.splits(s, d, "churn").filter("split = 'train'"))
    names = training.columns(s, d)
    rows = stage(s, d, "smote_train", lambda: train.select("customer_id", F.array(*names).alias("x"), "churn"))
    made = smote.smote(rows)
    end = lambda name: rows.select(F.col("customer_id").alias(f"{name}_id"), F.col("x").alias(name), F.col("churn").alias(f"{name}_class"))
    both = made.withColumnRenamed("x", "z").join(end("source"), "source_id").join(end("neighbour"), "neighbour_id")
    far = F.aggregate(F.zip_with("z", F.zip_with("source", "neighbour", lambda a, b: a + F.col("gap") * (b - a)), lambda p, q: F.abs(p - q)),
                      F.lit(0.0), lambda x, y: F.greatest(x, y))
    right = (far < 1e-9) & (F.col("gap") >= 0) & (F.col("gap") < 1) & (F.col("source_id") != F.col("neighbour_id"))
    return both.groupBy(F.col("source_id").alias("customer_id")).agg(
        F.count(F.lit(1)).alias("synthetic"), F.bool_and(right).alias("on_segment"),
        F.bool_and(F.col("source_class") == F.col("neighbour_class")).alias("own_class"))


def margin_calibration(s, d):
    """Isotonic rates of the churn rule's margin, by bucket."""
    rows = tables.features(s, d).withColumn("margin", rule_margin())
    found = kernel_svm.Calibration.fit(rows, "margin", "churn", width=0.5, most=20)
    return s.createDataFrame(found.steps, "bucket int, rate double").withColumn("rate", round_even("rate", 9))


def churn_kernel_svm(s, d):
    """Metrics of the kernel classifier on the test rows."""
    names = training.columns(s, d)
    rows = training.scaler(s, d, "churn").apply(training.splits(s, d, "churn")).select(
        "customer_id", "split", F.array(*names).alias("x"), F.col("churn").cast("double").alias("label"))
    rows = stage(s, d, "kernel_rows", lambda: rows)
    model = kernel_svm.fit_kernel_svm(rows.filter("split = 'train'"), rows.filter("split = 'val'"))
    return classifier_metrics(model.transform(rows.filter("split = 'test'")), "label")


QUERIES = {
    f.__name__: f
    for f in (
        backtest, cv_folds, halving_search, target_encoding, hot_codes, partial_dependence, frequency_slope, revenue_forecast, next_category,
        smote_rows, margin_calibration, churn_kernel_svm,
    )
}
