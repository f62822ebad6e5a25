"""Stored bundles in a process of their own, the run log, and boosting cut to its best round."""

from __future__ import annotations

import subprocess
import sys
from datetime import datetime
from pathlib import Path

import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import functions as F

from custlens.functions import files
from custlens.functions.stages import new_path
from custlens.operators import anomaly, bundle, models, runlog, scoring, segments, splits
from custlens.operators.trees import load_ensemble
from custlens.plans import serving as plan

SCORE_ELSEWHERE = """
import sys
from datetime import datetime
from pyspark.sql import SparkSession
from custlens.operators import bundle, scoring
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2") \\
    .config("spark.sql.session.timeZone", "UTC").getOrCreate()
folder, records, out = sys.argv[1:]
scorer = bundle.load(spark, folder).scorer(spark)
scored, _ = scoring.score_batch(spark.read.parquet(records), scorer, "v2", datetime(2011, 1, 1))
scored.write.parquet(out)
"""


@pytest.fixture(scope="module")
def cohort(spark):
    """Customers with all scoring fields and labels that follow from them."""
    rng = np.random.default_rng(4)
    rows = []
    for i in range(240):
        recency, orders = float(rng.integers(1, 400)), float(rng.integers(1, 30))
        spend = orders * float(rng.integers(20, 90))
        values = {f: float(rng.random()) for f in scoring.FIELDS}
        values |= {"recency_days": recency, "frequency": orders, "total_spend": spend, "gross_spend": spend, "engagement_score": float(rng.integers(0, 100))}
        rows.append((i, *values.values(), float(recency > 150), spend * 0.4, "train" if i % 4 else "val"))
    schema = "customer_id long, " + ", ".join(f"{f} double" for f in scoring.FIELDS) + ", churn double, clv_next_90d double, split string"
    return spark.createDataFrame(rows, schema).cache()


def fitted_bundle(spark, cohort):
    names = list(scoring.FIELDS)
    trees = GBTClassifier(maxIter=4, maxDepth=3, seed=1).fit(models.training_rows(cohort, names, "churn"))
    path = new_path(spark, "churn_trees")
    models.save_model(trees, path)
    scaler = splits.fit_scaler(cohort, names)
    value = LinearRegression(regParam=0.1, elasticNetParam=0.0).fit(models.training_rows(scaler.apply(cohort), names, "clv_next_90d"))
    _, personas, kmeans, seg_scaler = segments.segment_customers(cohort, k=3, restarts=1)
    profile = anomaly.SpendingProfile.fit(cohort)
    return bundle.FittedBundle(names, trees, value, scaler, False, kmeans, seg_scaler, personas, profile, 0.3, 0.6, path, {"churn": "gbt"})


@pytest.mark.parametrize("kind", ["fitted", "rules"])
def test_scores_of_another_process(spark, cohort, kind, tmp_path):
    """The folder is all that another application needs, and its rows are the same."""
    if kind == "fitted":
        made = fitted_bundle(spark, cohort)
    else:
        personas = segments.label_personas(segments.segment_profile(cohort.withColumn("cluster_id", plan.rule_cluster())))
        made = bundle.RuleBundle({"recency_days": 100.0, "frequency": -5.0}, {"recency_days": 150.0, "frequency": 9.0}, 0.45,
                                 splits.fit_scaler(cohort, list(anomaly.FEATURES)), personas, 0.4, 0.9)
    bundles, records, out = (str(tmp_path / n) for n in ("bundles", "records", "out"))
    made.save(spark, bundles, "v2")
    cohort.select("customer_id", *scoring.FIELDS).withColumn("gross_spend", F.lit(None).cast("double")).write.parquet(records)
    here, _ = scoring.score_batch(spark.read.parquet(records), made.scorer(spark), "v2", datetime(2011, 1, 1))
    subprocess.run([sys.executable, "-c", SCORE_ELSEWHERE, bundles, records, out], check=True, timeout=300, cwd=Path(__file__).parents[1])
    rows = lambda df: sorted(map(str, df.withColumn("top_risk_factors", F.to_json("top_risk_factors")).collect()))
    for a, b in zip(rows(spark.read.parquet(out)), rows(here), strict=True):
        assert a == b


def test_versions(spark, cohort, tmp_path):
    """A version is stored once; a folder without manifest is no version; the last one is loaded."""
    folder = str(tmp_path / "bundles")
    personas = spark.createDataFrame([(0, "A")], "cluster_id int, segment_name string")
    make = lambda share: bundle.RuleBundle({"recency_days": 1.0}, {"recency_days": 0.0}, share, splits.Scaler({}, {}), personas, 1.0, 2.0)
    with pytest.raises(FileNotFoundError):
        bundle.load(spark, folder)
    make(0.1).save(spark, folder, "v1")
    make(0.2).save(spark, folder, "v2")
    personas.write.parquet(f"{folder}/v3/personas")
    assert bundle.versions(spark, folder) == ["v1", "v2"]
    assert bundle.load(spark, folder).value_share == 0.2 and bundle.load(spark, folder, "v1").value_share == 0.1
    with pytest.raises(FileExistsError):
        make(0.3).save(spark, folder, "v2")


def test_files(spark, tmp_path):
    path = str(tmp_path / "a" / "b.txt")
    files.write_new(spark, path, "für\n")
    assert files.read_text(spark, path) == "für\n" and files.names(spark, str(tmp_path / "a")) == ["b.txt"]
    with pytest.raises(FileExistsError):
        files.write_new(spark, path, "x")
    assert files.names(spark, str(tmp_path / "none")) == []


def boosting_rows(spark, classes=True):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 3))
    y = (x[:, 0] * x[:, 1] + rng.normal(0, 0.5, 600) > 0).astype(float) if classes else x[:, 0] ** 2
    rows = spark.createDataFrame([(i, *map(float, v), float(t)) for i, (v, t) in enumerate(zip(x, y))], "customer_id long, a double, b double, c double, label double")
    from pyspark.ml.feature import VectorAssembler

    return VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(rows).cache()


def test_first_trees_equal_a_shorter_fit(spark):
    for est, rows in ((GBTClassifier(maxIter=9, maxDepth=3, seed=1), boosting_rows(spark)), (GBTRegressor(maxIter=9, maxDepth=3, seed=1), boosting_rows(spark, False))):
        cut = models.first_trees(est.fit(rows), 4)
        short = est.copy({est.maxIter: 4}).fit(rows)
        assert len(cut.treeWeights) == 4
        both = [sorted((r.customer_id, r.prediction) for r in m.transform(rows).collect()) for m in (cut, short)]
        assert both[0] == both[1]
        path = new_path(spark, "cut")
        models.save_model(cut, path)
        again = models.load_model(spark, path)
        assert again.transform(rows).exceptAll(cut.transform(rows)).count() == 0


def test_auc_by_round(spark):
    rows = boosting_rows(spark)
    model = GBTClassifier(maxIter=6, maxDepth=2, seed=1).fit(rows)
    path = new_path(spark, "trees")
    models.save_model(model, path)
    got = models.auc_by_round(load_ensemble(spark, model, path), rows)
    for n in range(1, 7):
        scored = models.first_trees(model, n).transform(rows).select("label", vector_to_array("probability")[1].alias("p")).toPandas()
        p, q = scored.p[scored.label == 1].to_numpy(), scored.p[scored.label == 0].to_numpy()
        want = ((p[:, None] > q).sum() + 0.5 * (np.abs(p[:, None] - q) < 1e-12).sum()) / (len(p) * len(q))
        assert got[n - 1] == pytest.approx(want, abs=2e-4)
    stopped = models._boosted(GBTClassifier(maxIter=6, maxDepth=2, seed=1), rows, rows, "auc")
    assert len(stopped.treeWeights) == models.best_round([-a for a in got])


def test_registry(spark, tmp_path):
    folder = str(tmp_path / "log")
    t = datetime(2011, 1, 1)

    def measured(model, auc, recall):
        return spark.createDataFrame([(model, auc, recall)], "model string, roc_auc double, recall double")

    for version, rows in ((1, [("a", 0.9, 0.5), ("b", 0.7, 0.5)]), (2, [("a", 0.6, 0.5), ("c", 0.7, 0.8)])):
        for row in rows:
            runlog.append(runlog.run_rows(measured(*row), "churn", version, t, f"m/v{version}", "{}", 33), folder)
    clv = spark.createDataFrame([("r", 0.4)], "model string, r2 double")
    runlog.append(runlog.run_rows(clv, "clv_next_90d", 1, t, "m/v1", "{}", 33), folder)
    log = runlog.read(spark, folder)
    assert log.count() == 5
    got = {(r.target, r.model): (r.version, r.path, r.place, r.active) for r in runlog.registry(log).collect()}
    assert got == {
        ("churn", "c"): (2, "m/v2/c", 1, True), ("churn", "b"): (1, "m/v1/b", 2, False), ("churn", "a"): (2, "m/v2/a", 3, False),
        ("clv_next_90d", "r"): (1, "m/v1/r", 1, True)}
    assert {(r.target, r.model) for r in runlog.active(log).collect()} == {("churn", "c"), ("clv_next_90d", "r")}
