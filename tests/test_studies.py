"""Backtests, folds, encodings and effects against plain versions."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

import numpy as np
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler

from custlens.functions.stages import new_path
from custlens.operators import backtest, bundle, effects, folds, kernel_svm, models, smote, trends
from custlens.operators.encoding import HotCodes, TargetEncoding
from custlens.operators.features import customer_features
from custlens.operators.trees import load_ensemble
from tests.conftest import CLEAN_SCHEMA, clean_line

START = datetime(2010, 1, 1)


@pytest.fixture(scope="module")
def lines(spark):
    """Thirty customers; some invoices have lines on several days, so cutoffs fall inside them."""
    rng = random.Random(6)
    rows = []
    for customer in range(30):
        for invoice in range(rng.randrange(1, 9)):
            first, ret = START + timedelta(days=rng.randrange(0, 500), seconds=rng.randrange(86400)), rng.random() < 0.2
            for _ in range(rng.randrange(1, 5)):
                at = first + timedelta(days=rng.choice([0, 0, 0, 1, 40, 100]))
                amount = round(rng.uniform(1, 90), 2) * (-1 if ret else 1)
                rows.append(clean_line(customer, f"{customer}-{invoice}", at, amount, rng.choice(["22001", "21002", "85003", "x"]), -2.0 if ret else 2.0, ret=ret))
    rows += [clean_line(5, "5-edge", START + timedelta(days=d), 10.0) for d in (110, 200, 290)]  # on the bounds themselves
    return spark.createDataFrame(rows, CLEAN_SCHEMA).cache()


def test_backtest_equals_separate_runs(spark, lines):
    cutoffs = [START + timedelta(days=d) for d in (20, 110, 200, 290, 290, 450)]
    got = backtest.backtest(lines, cutoffs)
    names = [c for c in got.columns if c not in ("cutoff", "customer_id")]
    found = {(r["cutoff"], r["customer_id"]): r for r in got.collect()}
    seen = 0
    for cutoff in sorted(set(cutoffs)):
        for want in customer_features(lines, cutoff).collect():
            row = found[cutoff, want["customer_id"]]
            for c in names:
                assert row[c] == pytest.approx(want[c], abs=1e-9), (cutoff, want["customer_id"], c)
            seen += 1
    assert seen == len(found)


def test_backtest_reads_each_line_once(lines):
    """The generator of cutoffs stands behind the states of customers, not behind the lines."""
    cutoffs = [START + timedelta(days=30 * d) for d in range(1, 13)]
    bounds = [c for c in cutoffs]
    assert backtest.order_parts(lines, bounds).agg(F.sum("lines")).first()[0] == lines.count()
    with pytest.raises(ValueError):
        backtest.backtest(lines, [])


# ---- folds and search ----


@pytest.fixture(scope="module")
def labelled(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(503, 3))
    y = (x[:, 0] + 0.5 * rng.normal(size=503) > 0.4).astype(float)
    country = ["UK"] * 300 + [["France", "Spain", "Peru", None][k % 4] for k in range(203)]
    rows = [(k, *map(float, v), float(t), c) for k, (v, t, c) in enumerate(zip(x, y, country))]
    frame = spark.createDataFrame(rows, "customer_id long, a double, b double, c double, churn double, country string")
    return folds.assign_folds(VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(frame).withColumn("label", F.col("churn"))).cache()


def test_folds_are_even_in_each_class_and_repeatable(labelled):
    counts = {(r["churn"], r["fold"]): r["count"] for r in labelled.groupBy("churn", "fold").count().collect()}
    for label in (0.0, 1.0):
        sizes = [counts[label, k] for k in range(5)]
        assert max(sizes) - min(sizes) <= 1
    again = folds.assign_folds(labelled.drop("fold").repartition(7)).select("customer_id", "fold")
    assert again.exceptAll(labelled.select("customer_id", "fold")).count() == 0


def test_halving_keeps_the_better_half():
    seen = []

    def score(name, fold):
        seen.append((name, fold))
        return {"a": 0.5, "b": 0.9, "c": 0.7, "d": 0.6, "e": 0.9}[name] - 0.1 * fold * (name == "b")

    trials = folds.successive_halving(list("abcde"), score, folds=4)
    assert [(t.name, len(t.scores)) for t in trials] == [("e", 4), ("b", 3), ("c", 2), ("d", 1), ("a", 1)]
    assert len(seen) == 5 + 3 + 2 + 1 and trials[0].mean == pytest.approx(0.9)


def test_search_with_fits(labelled):
    """The fold that is scored is not fitted on, and the better parameters win."""
    penalty = {"weak": 0.001, "strong": 50.0}

    def score(name, fold):
        return folds.fold_auc(labelled, lambda t: LogisticRegression(regParam=penalty[name], elasticNetParam=1.0).fit(t), fold, partitions=2)

    trials = folds.successive_halving(list(penalty), score, folds=2)
    assert trials[0].name == "weak" and trials[0].mean > 0.8 and trials[1].mean == pytest.approx(0.5)


# ---- encodings ----


def plain_encoding(rows, smoothing=20.0):
    out = {}
    for r in rows:
        other = [q for q in rows if q["fold"] != r["fold"]]
        same = [q for q in other if q["country"] == r["country"]]
        share = sum(q["churn"] for q in other) / len(other)
        out[r["customer_id"]] = (sum(q["churn"] for q in same) + smoothing * share) / (len(same) + smoothing)
    return out


def test_target_encoding(spark, labelled):
    rows = labelled.select("customer_id", "country", "churn", "fold").collect()
    encoding = TargetEncoding.fit(labelled, "country")
    got = {r["customer_id"]: r["rate"] for r in encoding.apply(labelled, "rate").collect()}
    want = plain_encoding(rows)
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in got)
    # rows outside training: all folds count, and an unknown country gets the share
    new = spark.createDataFrame([(1, "Peru"), (2, "Mars"), (3, None)], "customer_id long, country string")
    rates = {r["customer_id"]: r["rate"] for r in encoding.apply(new, "rate").collect()}
    share = sum(r["churn"] for r in rows) / len(rows)
    of = lambda c: [r["churn"] for r in rows if r["country"] == c]
    assert rates == {k: pytest.approx((sum(of(c)) + 20 * share) / (len(of(c)) + 20)) for k, c in ((1, "Peru"), (2, "Mars"), (3, None))}
    # stored and loaded
    folder = new_path(spark, "encodings")
    encoding.save(spark, folder, "v1")
    again = {r["customer_id"]: r["rate"] for r in bundle.load(spark, folder).apply(new, "rate").collect()}
    assert again == rates


def test_no_row_sees_its_own_label(labelled):
    one = labelled.filter("fold = 2").first()["customer_id"]
    turned = labelled.withColumn("churn", F.when(F.col("customer_id") == one, 1.0 - F.col("churn")).otherwise(F.col("churn")))
    rate = lambda df: TargetEncoding.fit(df, "country").apply(df, "rate").filter("fold = 2").select("customer_id", "rate").collect()
    assert sorted(rate(turned)) == sorted(rate(labelled))


def test_hot_codes(spark, labelled):
    codes = HotCodes.fit(labelled, "country", most=2)
    assert codes.levels == ["UK", "France"]
    rows = {r["country"]: r for r in codes.apply(labelled).collect()}
    assert [(rows[c]["country_is_UK"], rows[c]["country_is_France"], rows[c]["country_is_other"]) for c in ("UK", "France", "Peru", None)] == [
        (1, 0, 0), (0, 1, 0), (0, 0, 1), (0, 0, 1)]
    folder = new_path(spark, "codes")
    codes.save(spark, folder, "v1")
    assert bundle.load(spark, folder).levels == codes.levels


# ---- partial dependence ----


def test_partial_dependence_equals_averaging(spark, labelled):
    model = GBTClassifier(maxIter=6, maxDepth=4, seed=2).fit(labelled)
    path = new_path(spark, "trees")
    models.save_model(model, path)
    ensemble, names = load_ensemble(spark, model, path), ["a", "b", "c"]
    grid = {"a": (-2.0, -0.3, 0.0, 0.4, 3.0), "c": (0.1, 9.0)}
    got = {(r["feature"], r["value"]): r["margin"] for r in effects.partial_dependence(spark, labelled.repartition(5), ensemble, names, grid).collect()}
    x = labelled.select(*names).toPandas().to_numpy()
    for name, values in grid.items():
        for v in values:
            moved = x.copy()
            moved[:, names.index(name)] = v
            assert got[name, v] == pytest.approx(ensemble.margin(moved).mean(), abs=1e-9)
    assert effects.leaf_counts(labelled.limit(0), ensemble, names).rows == 0


# ---- trends ----


def test_frequency_slope(lines):
    cutoff = START + timedelta(days=400)
    orders: dict = {}
    for r in lines.filter("not is_return").collect():
        if r["invoice_date"] <= cutoff:
            key = (r["customer_id"], r["invoice"])
            orders[key] = min(orders.get(key, r["invoice_date"]), r["invoice_date"])
    by_customer: dict = {}
    for (customer, _), at in orders.items():
        by_customer.setdefault(customer, []).append((cutoff.date() - at.date()).days // 30)
    got = {r["customer_id"]: (r["bins"], r["orders"], r["slope"]) for r in trends.frequency_slope(lines, cutoff).collect()}
    assert got.keys() == by_customer.keys()
    for customer, back in by_customer.items():
        n = max(back) + 1
        y = [back.count(n - 1 - t) for t in range(n)]
        assert got[customer] == (n, len(back), pytest.approx(np.polyfit(range(n), y, 1)[0] if n > 1 else 0.0, abs=1e-9))


def test_revenue_forecast(spark):
    d = datetime
    rows = [clean_line(1, "a", d(2010, 1, 5), 100.0), clean_line(2, "b", d(2010, 1, 9), 50.0), clean_line(1, "c", d(2010, 4, 1), 30.0), clean_line(1, "r", d(2010, 5, 1), -10.0, ret=True)]
    got = [tuple(r) for r in trends.revenue_forecast(spark.createDataFrame(rows, CLEAN_SCHEMA), alpha=0.5, least=2).collect()]
    assert [r[0].isoformat() for r in got] == ["2010-01-01", "2010-02-01", "2010-03-01", "2010-04-01", "2010-05-01", "2010-06-01"]
    assert [r[1] for r in got] == [150.0, 0.0, 0.0, 30.0, -10.0, None]
    assert [r[3] for r in got] == [None, None, 75.0, 37.5, 33.75, 11.875]
    assert [r[4] for r in got] == [None, None, 75.0, 7.5, 43.75, None]
    assert trends.revenue_forecast(spark.createDataFrame([], CLEAN_SCHEMA)).count() == 0


def test_next_category(spark):
    d = datetime
    line = lambda c, inv, day, code, amount=10.0: clean_line(c, inv, d(2010, 1, day, int(inv) % 24), amount, code)
    rows = [line(1, str(k), 1 + k // 3, "22x" if k % 2 == 0 else "21x") for k in range(12)]  # 22 -> 21 -> 22 ..., ends with 21
    rows += [line(2, "1", 1, "21a"), line(2, "2", 2, "85a", 5.0), line(2, "2", 2, "84a", 9.0), line(3, "1", 3, "77a"), line(1, "90", 25, "85z"), line(2, "91", 26, "21z")]
    segments = spark.createDataFrame([(1, "A"), (2, "B"), (3, "B")], "customer_id long, segment string")
    got = {r["customer_id"]: (r["last_category"], r["predicted"], r["source"], r["actual"])
           for r in trends.next_category(spark.createDataFrame(rows, CLEAN_SCHEMA), d(2010, 1, 20), segments).collect()}
    assert got == {1: ("21", "22", "customer", "85"), 2: ("84", None, None, "21"), 3: ("77", None, None, None)}
    few = spark.createDataFrame(rows + [line(3, "2", 4, "21a")], CLEAN_SCHEMA)
    again = {r["customer_id"]: (r["last_category"], r["predicted"], r["source"]) for r in trends.next_category(few, d(2010, 1, 20), segments).collect()}
    assert again[3] == ("21", "22", "all")
    nearer = {r["customer_id"]: r["source"] for r in trends.next_category(few, d(2010, 1, 20), segments, least=1).collect()}
    assert nearer[3] == "segment"


# ---- synthetic rows ----


def plain_smote_quota(ids, wanted):
    import hashlib

    order = sorted(ids, key=lambda i: (hashlib.md5(f"{i}:quota:42".encode()).hexdigest(), i))
    return {i: wanted // len(ids) + (k < wanted % len(ids)) for k, i in enumerate(order)}


def test_smote(spark):
    rng = np.random.default_rng(9)
    rows = [(k, rng.normal(5, 1, 3).tolist(), 1.0) for k in range(40)] + [(100 + k, rng.normal(0, 1, 3).tolist(), 0.0) for k in range(137)]
    rows += [(90, rows[0][1], 1.0)]  # an equal row
    train = spark.createDataFrame(rows, "customer_id long, x array<double>, churn double")
    made = smote.smote(train, k=4).collect()
    again = smote.smote(train.repartition(7).orderBy(F.rand(1)), k=4).collect()
    assert sorted(map(str, made)) == sorted(map(str, again))
    points = {i: np.array(x) for i, x, y in rows if y == 1.0}
    assert len(made) == 137 - 41
    counts = {}
    for r in made:
        counts[r["source_id"]] = counts.get(r["source_id"], 0) + 1
        a, b = points[r["source_id"]], points[r["neighbour_id"]]
        assert np.allclose(r["x"], a + r["gap"] * (b - a)) and 0 <= r["gap"] < 1 and r["label"] == 1.0
        others = sorted((np.linalg.norm(points[j] - a), j) for j in points if j != r["source_id"])[:4]
        assert r["neighbour_id"] in [j for _, j in others]
    assert counts == {i: n for i, n in plain_smote_quota(list(points), 96).items() if n}
    assert len({r["neighbour_id"] for r in made}) > 10 and len({round(r["gap"], 6) for r in made}) == len(made)
    even = train.filter("customer_id < 20 or customer_id between 100 and 119")
    assert smote.smote(even).count() == 0 and smote.smote(even).columns == ["source_id", "neighbour_id", "nr", "gap", "x", "label"]
    with pytest.raises(ValueError):
        smote.smote(train.filter("churn = 1"))


# ---- kernel classifier ----


def ring(spark, n, seed):
    """Two classes that no line separates: inside and outside a ring."""
    rng = np.random.default_rng(seed)
    x = rng.uniform(-2, 2, (n, 2))
    y = ((x ** 2).sum(axis=1) < 1.6).astype(float)
    return spark.createDataFrame([(seed * n + k, v.tolist(), float(t)) for k, (v, t) in enumerate(zip(x, y))], "customer_id long, x array<double>, label double").cache()


def test_kernel_svm_learns_a_ring(spark):
    train, val, test = (ring(spark, 600, k) for k in range(3))
    model = kernel_svm.fit_kernel_svm(train, val, gamma=1.0, features=128, penalty=1e-4, partitions=2)
    rows = model.transform(test).toPandas()
    assert ((rows.probability >= 0.5) == (rows.label == 1)).mean() > 0.9
    assert rows.probability.between(0, 1).all()
    order = rows.sort_values("margin").probability.to_numpy()
    assert (np.diff(order) >= 0).all()
    linear = LogisticRegression().fit(train.select("label", kernel_svm.array_to_vector("x").alias("features")))
    plain = linear.transform(test.select("label", kernel_svm.array_to_vector("x").alias("features"))).toPandas()
    assert (plain.prediction == plain.label).mean() < 0.75


def test_fourier_features_approach_the_kernel():
    fourier = kernel_svm.FourierMap.draw(3, 0.4, features=20_000)
    x = np.random.default_rng(1).normal(size=(5, 3))
    z = fourier.mapped(x)
    want = np.exp(-0.4 * ((x[:, None] - x[None]) ** 2).sum(axis=2))
    assert np.allclose(z @ z.T, want, atol=0.05)


def test_pooling_is_the_closest_rising_sequence():
    rng = random.Random(5)
    for _ in range(200):
        counts = []
        for b in range(rng.randrange(1, 12)):
            n = rng.randrange(1, 9)
            counts.append((b, n, float(rng.randrange(0, n + 1))))
        got = [rate for _, rate in kernel_svm.pooled(counts)]
        mean = lambda i, j: sum(c[2] for c in counts[i:j + 1]) / sum(c[1] for c in counts[i:j + 1])
        want = [max(min(mean(i, j) for j in range(k, len(counts))) for i in range(k + 1)) for k in range(len(counts))]
        assert got == pytest.approx(want)


def test_calibration_steps(spark):
    c = kernel_svm.Calibration([(-2, 0.1), (0, 0.4), (3, 0.9)], width=0.5, most=4)
    rows = spark.createDataFrame([(m,) for m in (-9.0, -1.0, -0.1, 0.0, 1.4, 1.5, 99.0)], "m double")
    assert [r[0] for r in rows.select(c.probability(F.col("m"))).collect()] == [0.1, 0.1, 0.1, 0.4, 0.4, 0.9, 0.9]
