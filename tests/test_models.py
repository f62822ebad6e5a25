"""Splits, metrics, closed forms, neighbours, trees, clusters on planted data."""

from __future__ import annotations

import hashlib
import math
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from custlens.functions.stages import new_path
from custlens.operators import anomaly, explain, linear, metrics, models, segments, sequences, splits, surrogate
from custlens.operators.neighbours import distance_vote, nearest_neighbours
from custlens.operators.splits import fitting_rows
from custlens.operators.trees import load_ensemble, with_tree_factors
from tests.conftest import by_key

NAMES = ["recency_days", "frequency", "total_spend", "noise"]


@pytest.fixture(scope="module")
def planted(spark):
    """400 customers whose churn follows recency and orders, and spend ahead follows spend."""
    rng = np.random.default_rng(42)
    n = 400
    rec, freq = rng.uniform(1, 365, n), rng.integers(1, 20, n).astype(float)
    spend = rng.uniform(10, 5000, n)
    p = 1 / (1 + np.exp(-(rec / 40 - freq / 2)))
    pdf = pd.DataFrame({
        "customer_id": range(n), "recency_days": rec, "frequency": freq, "total_spend": spend, "noise": rng.normal(0, 1, n),
        "churn": (rng.random(n) < p).astype(int), "clv_next_90d": np.maximum(0, 0.4 * spend + rng.normal(0, 50, n)),
    })
    return splits.assign_splits(spark.createDataFrame(pdf)).cache()


def test_split_sizes_and_repeatability(spark, planted):
    sizes = {r.split: r["count"] for r in planted.groupBy("split").count().collect()}
    assert sizes["test"] == 60 and abs(sizes["train"] - 280) <= 1 and abs(sizes["val"] - 60) <= 1
    overall = planted.agg(F.avg("churn")).first()[0]
    for r in planted.groupBy("split").agg(F.avg("churn").alias("c")).collect():
        assert r.c == pytest.approx(overall, abs=0.02)
    again = splits.assign_splits(planted.drop("split").repartition(5))
    assert again.orderBy("customer_id").collect() == planted.select(again.columns).orderBy("customer_id").collect()
    other = splits.assign_splits(planted.drop("split"), seed=7)
    assert other.join(planted, ["customer_id", "split"]).count() < 400
    spendy = splits.assign_splits(planted.drop("split"), "clv_next_90d")
    assert {r.split: r["count"] for r in spendy.groupBy("split").count().collect()}["test"] == 60


def test_splits_move_only_the_rows_of_cut_buckets(spark):
    rows = [(i // 2 if i < 600 else i, int(i % 3 == 0), f"r{i}") for i in range(5000)] + [(None, 1, "none")]  # repeated and null keys
    df = spark.createDataFrame(rows, "customer_id bigint, churn int, wide string")
    got = splits.assign_splits(df)
    split = {r.wide: r.split for r in got.collect()}
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan[plan.index("== Final Plan"):plan.index("== Initial Plan")].count("Exchange hashpartitioning") <= 1
    quota = {r.stratum: (r.test_n, r.val_n) for r in splits.split_quotas(
        df.groupBy(F.col("churn").cast("string").alias("stratum")).agg(F.count("*").alias("n")), 0.15, 0.15).collect()}
    for churn in (0, 1):
        mine = sorted((hashlib.md5(f"{k}:42".encode()).hexdigest(), k, w) for k, c, w in rows if c == churn and k is not None)
        test, val = quota[str(churn)]
        skip = sum(1 for k, c, w in rows if c == churn and k is None)  # a row without a key takes the first place and has no split
        want = ["test"] * (test - skip) + ["val"] * val + ["train"] * (len(mine) - test - val + skip)
        by_key = lambda parts: Counter((h, p) for (h, _, _), p in zip(mine, parts))
        assert by_key(want) == by_key([split[w] for _, _, w in mine])
    assert "none" not in split and len(split) == 5000


def test_scaler_and_constant_column(planted):
    rows = planted.withColumn("flat", F.lit(3.0))
    train = rows.filter("split = 'train'")
    scaler = splits.fit_scaler(train, [*NAMES, "flat"])
    r = scaler.apply(train).agg(*[F.avg(c).alias(f"m_{c}") for c in NAMES], *[F.stddev_pop(c).alias(f"s_{c}") for c in NAMES], F.max("flat").alias("flat")).first()
    assert all(abs(r[f"m_{c}"]) < 1e-9 and abs(r[f"s_{c}"] - 1) < 1e-9 for c in NAMES) and r.flat == 0.0


def test_class_weights(planted):
    got = {r.churn: r for r in splits.class_weights(planted).collect()}
    assert got[0].n * got[0].weight == pytest.approx(200) and got[1].n * got[1].weight == pytest.approx(200)


def test_auc_equals_evaluator(planted):
    # A coarse score, so that many rows tie.
    scored = planted.withColumn("score", F.floor(F.col("recency_days") / 60) / 10)
    mine = metrics.exact_auc(scored, "churn", "score").first()[0]
    rows = scored.select(F.col("churn").cast("double").alias("label"), F.col("score").alias("rawPrediction"))
    assert mine == pytest.approx(BinaryClassificationEvaluator(numBins=0).evaluate(rows), abs=1e-12)
    one_class = metrics.exact_auc(scored.filter("churn = 1"), "churn", "score").first()[0]
    assert one_class is None


def test_metrics_by_hand(spark):
    df = spark.createDataFrame([(1, 0.9), (1, 0.4), (0, 0.6), (0, 0.1), (1, 0.5)], "churn int, probability double")
    r = metrics.classifier_metrics(df).first()
    assert (r.true_positives, r.false_positives, r.true_negatives, r.false_negatives) == (2, 1, 1, 1)
    assert (r.accuracy, r.precision, r.recall, r.f1) == (0.6, 0.6667, 0.6667, 0.6667)
    none = metrics.classifier_metrics(df.withColumn("probability", F.lit(0.1))).first()
    assert (none.precision, none.recall, none.f1) == (0.0, 0.0, 0.0)
    y = spark.createDataFrame([(0.0, -5.0), (10.0, 8.0), (20.0, 26.0)], "clv_next_90d double, prediction double")
    r = metrics.regressor_metrics(y).first()
    assert (r.mae, r.rmse, r.r2) == (2.67, 3.65, 0.8)


def test_ridge_equals_closed_form_and_spark(planted):
    rows = splits.fit_scaler(planted, NAMES).apply(planted)
    model = linear.fit_ridge(rows, NAMES, "clv_next_90d", alpha=100.0)
    pdf = rows.toPandas()
    x, y = pdf[NAMES].to_numpy(), pdf["clv_next_90d"].to_numpy()
    xc, yc = x - x.mean(0), y - y.mean()
    w = np.linalg.solve(xc.T @ xc + 100 * np.eye(4), xc.T @ yc)
    assert np.allclose([model.weights[c] for c in NAMES], w)
    vec = VectorAssembler(inputCols=NAMES, outputCol="features").transform(rows).withColumn("label", F.col("clv_next_90d"))
    assert np.allclose(models._ridge(vec, vec).coefficients.toArray(), w, rtol=1e-6)


def test_linear_attributions_add_up(planted):
    weights = {"recency_days": 0.01, "frequency": -0.2}
    means = planted.agg(*[F.avg(c).alias(c) for c in weights]).first()
    out = linear.linear_attributions(planted, weights).join(planted, "customer_id").select(
        F.aggregate("factors", F.lit(0.0), lambda s, f: s + f["attribution"]).alias("total"),
        sum(F.lit(w) * (F.col(c) - means[c]) for c, w in weights.items()).alias("want"))
    assert out.filter(F.abs(F.col("total") - F.col("want")) > 1e-9).count() == 0


def test_neighbours_equal_brute_force(spark):
    rng = np.random.default_rng(9)
    # Two thirds of the training rows in one tight clump, some of them equal.
    train = np.vstack([rng.normal(0, 0.05, (400, 5)).round(2), rng.normal(0, 3, (200, 5))])
    y = rng.integers(0, 2, 600)
    query = np.vstack([rng.normal(0, 2, (30, 5)), train[:10]])
    t = spark.createDataFrame([(i, x.tolist(), float(c)) for i, (x, c) in enumerate(zip(train, y))], "tid long, x array<double>, y double")
    q = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(query)], "qid long, x array<double>")
    near = nearest_neighbours(q, t, k=7)
    got = near.toPandas()
    votes = by_key(distance_vote(near), "qid")
    for i, x in enumerate(query):
        d = np.sqrt(((train - x) ** 2).sum(1))
        order = np.lexsort((np.arange(600), d))[:7]
        assert sorted(got[got.qid == i].tid) == sorted(order)
        zero = d[order] == 0
        want = y[order][zero].mean() if zero.any() else (y[order] / d[order]).sum() / (1 / d[order]).sum()
        assert votes[i].probability == pytest.approx(want)


def test_neighbours_of_a_bounded_fit(spark):
    rng = np.random.default_rng(2)
    train, query = rng.normal(0, 1, (200, 2)), rng.normal(0, 1, (50, 2))
    t = spark.createDataFrame([(i, x.tolist(), 1.0) for i, x in enumerate(train)], "tid long, x array<double>, y double")
    q = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(query)], "qid long, x array<double>")
    chosen = sorted(range(200), key=lambda i: hashlib.md5(f"{i}:knn".encode()).hexdigest())[:60]
    for parts in (1, 5):
        got = nearest_neighbours(q, t.repartition(parts), k=3, rows=60).toPandas()
        for i, x in enumerate(query):
            near = sorted(chosen, key=lambda j: ((train[j] - x) ** 2).sum())[:3]
            assert sorted(got[got.qid == i].tid) == sorted(near)


def test_fits_do_not_depend_on_the_layout(spark, planted):
    rows = _vectors(planted)
    specs = {name: models.CHURN_MODELS[name] for name in ("churn_rf", "churn_tree")}
    specs["gbt"] = models.Spec(lambda t, v: GBTClassifier(maxIter=5, subsamplingRate=0.8, featureSubsetStrategy="0.8", seed=1).fit(t))
    seen = {}
    for parts in (1, 3, 8):
        for name, spec in specs.items():
            with fitting_rows(rows.repartition(parts).orderBy(F.rand(parts))) as fit:
                model = models.fit_model(fit, spec)
                out = model.transform(rows).select("customer_id", vector_to_array("probability")[1].alias("p"))
                got = {r.customer_id: round(r.p, 9) for r in out.collect()}
            assert seen.setdefault(name, got) == got
    vectors = rows.select("customer_id", F.col("features").alias("x"))
    costs = {round(segments.fit_kmeans(vectors.repartition(parts), 3, restarts=2).summary.trainingCost, 6) for parts in (1, 3, 8)}
    assert len(costs) == 1


def _vectors(planted):
    return VectorAssembler(inputCols=NAMES, outputCol="features").transform(planted).select(
        "customer_id", "split", "features", F.col("churn").cast("double").alias("label"), *NAMES, F.lit(1.0).alias("weight"))


@pytest.mark.parametrize("estimator", [
    lambda: DecisionTreeClassifier(maxDepth=4, seed=1), lambda: RandomForestClassifier(numTrees=5, maxDepth=4, seed=1),
    lambda: GBTClassifier(maxIter=8, maxDepth=3, stepSize=0.3, seed=1),
])
def test_tree_attributions_add_up_and_match_model(spark, planted, estimator):
    rows = _vectors(planted)
    model = estimator().fit(rows)
    path = new_path(spark, "tree")
    model.write().save(path)
    ensemble = load_ensemble(spark, model, path)
    out = with_tree_factors(rows, ensemble, NAMES)
    sums = out.select("customer_id", (F.col("base") + F.aggregate("factors", F.lit(0.0), lambda s, f: s + f["attribution"]) - F.col("margin")).alias("gap"))
    assert sums.filter(F.abs("gap") > 1e-9).count() == 0
    x = rows.select(*NAMES).toPandas().to_numpy()
    want = np.array([r[0] for r in model.transform(rows).select(vector_to_array("probability")[1]).collect()])
    assert np.allclose(ensemble.probability(x), want, atol=1e-9)


def test_tree_attributions_equal_subset_definition(spark, planted):
    """Shapley values of the path-dependent expectation, by all feature subsets."""
    from itertools import combinations

    rows = _vectors(planted)
    model = GBTClassifier(maxIter=3, maxDepth=4, stepSize=0.3, seed=1).fit(rows)
    path = new_path(spark, "tree")
    model.write().save(path)
    e = load_ensemble(spark, model, path)

    def expectation(x, known, t, node=0):
        f = e.feature[t, node]
        if f < 0:
            return e.value[t, node] * e.scale[t]
        left, right = e.left[t, node], e.right[t, node]
        if f in known:
            return expectation(x, known, t, left if x[f] <= e.threshold[t, node] else right)
        share = e.cover[t, left] / e.cover[t, node]
        return share * expectation(x, known, t, left) + (e.cover[t, right] / e.cover[t, node]) * expectation(x, known, t, right)

    sample = with_tree_factors(rows, e, NAMES).orderBy("customer_id").limit(5).collect()
    for r in sample:
        x = np.array([f["value"] for f in r.factors])
        for j in range(4):
            rest, want = [i for i in range(4) if i != j], 0.0
            for size in range(4):
                w = math.factorial(size) * math.factorial(3 - size) / math.factorial(4)
                for s in combinations(rest, size):
                    want += w * sum(expectation(x, {*s, j}, t) - expectation(x, set(s), t) for t in range(len(e.scale)))
            assert r.factors[j]["attribution"] == pytest.approx(want, abs=1e-9)


def test_early_stopping_rule():
    assert models.best_round([5, 4, 3, 3.5, 3.2, 2.9, 4], patience=30) == 6
    assert models.best_round([5, 4, 4.1, 4.2, 4.3, 1.0], patience=3) == 2
    assert models.best_round([5.0, 5.0]) == 1


@pytest.mark.parametrize("name", ["churn_lr", "churn_tree", "churn_rf", "churn_mlp"])
def test_churn_models_beat_chance(planted, name):
    spec = models.CHURN_MODELS[name]
    rows = splits.fit_scaler(planted.filter("split = 'train'"), NAMES).apply(planted) if spec.scaled else planted
    ready = models.training_rows(rows, NAMES, "churn").cache()
    model = models.fit_model(ready, spec)
    scored = model.transform(ready.filter("split = 'test'")).withColumn("p", vector_to_array("probability")[1])
    r = metrics.classifier_metrics(scored, "label", "p").first()
    assert r.roc_auc > 0.8 and r.recall > 0.5


def test_boosting_stops_on_validation(planted):
    ready = models.training_rows(planted, NAMES, "churn").cache()
    train, val = ready.filter("split = 'train'"), ready.filter("split = 'val'")
    est = GBTClassifier(maxIter=25, maxDepth=4, stepSize=0.5, seed=1)
    model = models._boosted(est, train, val)
    losses = est.fit(train).evaluateEachIteration(val)
    assert len(model.trees) == models.best_round(losses) <= 25


def test_clv_models_beat_mean(planted):
    ready = models.training_rows(planted, NAMES, "clv_next_90d").cache()
    for name in ("clv_ridge", "clv_rf"):
        spec = models.CLV_MODELS[name]
        rows = models.training_rows(splits.fit_scaler(planted, NAMES).apply(planted), NAMES, "clv_next_90d") if spec.scaled else ready
        model = models.fit_model(rows, spec)
        r = metrics.regressor_metrics(model.transform(rows.filter("split = 'test'")), "label").first()
        assert r.r2 > 0.6


def test_sequences(spark):
    rows = [(1, f"{i}", f"2010-01-{i + 1:02d} 00:00:00", 100.0 * (i + 1), float(i), i == 8) for i in range(9)]
    rows += [(2, "x", "2010-01-05 00:00:00", -5.0, 3.0, True), (3, "y", "2010-01-01 00:00:00", 1.0, 1.0, False), (3, "z", "2012-01-01 00:00:00", 1.0, 1.0, False)]
    events = spark.createDataFrame(rows, "customer_id long, invoice string, invoice_date string, total_amount double, total_quantity double, is_return boolean")
    events = events.withColumn("invoice_date", F.col("invoice_date").cast("timestamp_ntz"))
    got = {r.customer_id: r.sequence for r in sequences.purchase_sequences(events).collect()}
    assert all(len(s) == 6 and all(len(step) == 4 for step in s) for s in got.values())
    assert got[1][0] == [math.log1p(400.0) / 10, 0.01, math.log1p(3.0) / 10, 0.0] and got[1][5][3] == 1.0
    assert got[2] == [[0.0] * 4] * 5 + [[0.0, 0.0, math.log1p(3.0) / 10, 1.0]]
    assert [s[1] for s in got[3]] == [0.0] * 5 + [3.65]  # gaps end at 365 days


def test_anomaly_profile(spark):
    rng = np.random.default_rng(0)
    z = rng.normal(0, 1, (300, 2))
    x = z @ rng.normal(0, 1, (2, 5)) + rng.normal(0, 0.01, (300, 5))
    x[7] += np.array([3, -3, 3, -3, 3])
    names = [f"f{i}" for i in range(5)]
    df = spark.createDataFrame(pd.DataFrame(x, columns=names).assign(customer_id=range(300)))
    profile = anomaly.SpendingProfile.fit(df, tuple(names), latent=2)
    scored = profile.with_error(df, "e").select("customer_id", "e").toPandas()
    assert scored.sort_values("e").customer_id.iloc[-1] == 7 and (scored.e >= 0).all()
    s = (x - x.mean(0)) / x.std(0)
    v = np.linalg.svd(s, full_matrices=False)[2][:2]
    want = ((s - s @ v.T @ v) ** 2).mean(1)
    assert np.allclose(scored.sort_values("customer_id").e, want, atol=1e-8)
    cuts = anomaly.anomaly_thresholds(spark.createDataFrame(scored), "e").first()
    assert cuts.anomalous_accounts_count == (scored.e > np.percentile(scored.e, 95)).sum()
    assert cuts.threshold_p99 == pytest.approx(np.percentile(scored.e, 99), abs=1e-4)


def test_segments_end_to_end(spark):
    rng = np.random.default_rng(42)
    n = 150
    centre = rng.integers(0, 3, n)
    pdf = pd.DataFrame({"customer_id": range(n), **{c: centre * 10.0 + rng.normal(0, 1, n) for c in segments.FEATURES},
                        "churn": rng.integers(0, 2, n), "clv_next_90d": rng.uniform(0, 1000, n)})
    out, profile, _, _ = segments.segment_customers(spark.createDataFrame(pdf), k=3, restarts=3)
    got = out.select("customer_id", "cluster_id", "segment_name").toPandas()
    assert got.cluster_id.nunique() == 3 and pd.crosstab(centre, got.sort_values("customer_id").cluster_id).max(axis=1).sum() == n
    names = [r.segment_name for r in profile.collect()]
    assert len(set(names)) == 3 and profile.agg(F.sum("customer_count")).first()[0] == n
    vectors = splits.scaled_vectors(spark.createDataFrame(pdf), splits.fit_scaler(spark.createDataFrame(pdf), list(segments.FEATURES)))
    sweep = segments.evaluate_cluster_range(vectors.select("x"), range(2, 5), restarts=2)
    assert [m["k"] for m in sweep] == [2, 3, 4] and all(m["inertia"] > 0 and m["silhouette_sq"] > -1 for m in sweep)
    assert max(sweep, key=lambda m: m["silhouette_sq"])["k"] == 3
    model, bic = segments.fit_gmm(vectors.select("x"), 3)
    assert model.transform(vectors).select("gmm_cluster_id").distinct().count() == 3 and math.isfinite(bic)


def test_davies_bouldin_by_hand(spark):
    pts = [(0, 0.0, 0.0), (0, 0.0, 2.0), (1, 10.0, 0.0), (1, 10.0, 4.0), (2, 0.0, 20.0)]
    df = spark.createDataFrame(pts, "c int, a double, b double")
    c = {0: (0, 1.0), 1: (10, 2.0), 2: (0, 20.0)}
    s = {0: 1.0, 1: 2.0, 2: 0.0}
    worst = [max((s[i] + s[j]) / math.dist(c[i], c[j]) for j in c if j != i) for i in c]
    got = segments.davies_bouldin(df, [F.col("a"), F.col("b")], "c").first()[0]
    assert got == pytest.approx(sum(worst) / 3)


def test_personas(spark):
    rows = [(0, 10.0, 60.0, 10.0), (1, 300.0, 2.0, 9000.0), (2, 30.0, 6.0, 500.0), (3, 95.0, 1.0, 50.0), (4, 200.0, 1.0, 40.0), (5, 5.0, 1.0, 50000.0)]
    df = spark.createDataFrame(rows, "cluster_id int, recency_days double, frequency double, total_spend double")
    got = {r.cluster_id: (r.segment_name, r.recommended_strategy) for r in segments.label_personas(df).collect()}
    assert [got[i][0] for i in range(6)] == ["VIP Champions", "High-Value Inactive", "Loyal Regulars", "At-Risk / Lapsed",
                                             "At-Risk / Lapsed (Cohort 4)", "VIP Champions (Cohort 5)"]
    assert got[4][1] == segments.DEFAULT_STRATEGY and got[0][1] == segments.STRATEGIES["VIP Champions"]


def test_local_surrogate_finds_the_driver(spark, planted):
    bins = surrogate.fit_bins(planted, NAMES)
    pdf = planted.toPandas()
    for j, c in enumerate(NAMES):
        assert np.allclose(bins.cuts[j], np.unique(np.percentile(pdf[c], [25, 50, 75])))
    model = lambda x: 1 / (1 + np.exp(-(x[:, 0] - 180) / 20))
    rows = planted.filter("customer_id < 20")
    out = surrogate.local_surrogates(rows, bins, model, samples=800).collect()
    assert len(out) == 20
    for r in out:
        assert "recency_days" in r.factors[0]["rule"] and 0.1 < r.surrogate_score <= 1.0
        home = pdf[pdf.customer_id == r.customer_id].recency_days.iloc[0]
        assert (r.factors[0]["weight"] > 0) == (home > bins.cuts[0][1])
    assert surrogate.local_surrogates(rows, bins, model, samples=800).collect() == out


def test_representatives(spark):
    df = spark.createDataFrame([(1, 0.1), (2, 0.1), (3, 0.45), (4, 0.55), (5, 0.9)], "customer_id long, churn_probability double")
    got = {r.profile: r.customer_id for r in explain.representatives(df).collect()}
    assert got == {"low_risk": 1, "borderline": 3, "high_risk": 5}
