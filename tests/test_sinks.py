"""Tables written and read back."""

from __future__ import annotations

from datetime import datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler

from custlens.operators import models
from custlens.plans.queries import all_queries
from custlens.sources import sinks
from tests.conftest import CLEAN_SCHEMA, clean_line


def test_cleaned_table_prunes_months(spark, tmp_path):
    lines = [clean_line(1, str(i), datetime(2010 + i // 12, 1 + i % 12, 15)) for i in range(20)]
    path = str(tmp_path / "cleaned")
    df = spark.createDataFrame(lines, CLEAN_SCHEMA)
    sinks.write_cleaned(df, path)
    assert sinks.read_cleaned(spark, path).count() == 20
    early = sinks.read_cleaned(spark, path, datetime(2010, 6, 15))
    assert early.count() == 6 and early.columns == df.columns
    plan = early._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [((year" in plan and "PushedFilters: [IsNotNull(invoice_date), LessThanOrEqual" in plan


def test_serving_tables_are_replaced(spark, tmp_path):
    spark.sql(f"CREATE DATABASE IF NOT EXISTS serving_test LOCATION '{tmp_path}/db'")
    try:
        first = spark.createDataFrame([(1, 0.5), (2, 0.7)], "customer_id long, p double")
        sinks.replace_tables({"predictions": first}, "serving_test")
        sinks.replace_tables({"predictions": first.filter("customer_id = 2")}, "serving_test")
        got = sinks.read_serving(spark, "serving_test.predictions", ["p"])
        assert got.columns == ["p"] and [r.p for r in got.collect()] == [0.7]
    finally:
        spark.sql("DROP DATABASE serving_test CASCADE")


def test_run_log_report_and_export(spark, tmp_path):
    rows = spark.createDataFrame([("a", 0.8)], "model string, roc_auc double")
    sinks.append_runs(rows, str(tmp_path / "runs"))
    sinks.append_runs(rows, str(tmp_path / "runs"))
    assert spark.read.parquet(str(tmp_path / "runs")).count() == 2
    sinks.write_report(rows, str(tmp_path / "report"))
    assert spark.read.json(str(tmp_path / "report")).first().roc_auc == 0.8
    sinks.write_csv(rows, str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).first().model == "a"


def test_models_come_back(spark, tmp_path):
    rng = np.random.default_rng(0)
    pdf = pd.DataFrame(rng.normal(0, 1, (80, 2)), columns=["a", "b"])
    pdf["label"] = (pdf.a + 0.1 * pdf.b > 0).astype(float)
    rows = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(spark.createDataFrame(pdf))
    for i, estimator in enumerate((LogisticRegression(), GBTClassifier(maxIter=3, seed=1))):
        model = estimator.fit(rows)
        models.save_model(model, str(tmp_path / str(i)))
        again = models.load_model(spark, str(tmp_path / str(i)))
        assert type(again) is type(model)
        assert again.transform(rows).select("probability").collect() == model.transform(rows).select("probability").collect()


def test_every_checked_query_exists():
    from oracle import all_sql

    queries, sql = all_queries(), all_sql()
    assert set(sql) <= set(queries) and len(sql) >= 80
    assert not [q for q in queries if q.startswith("op")]


@pytest.mark.parametrize("name", ["customer_features", "cleaned_transactions", "upsert_segments", "narrative", "scaled_features"])
def test_queries_match_sql_on_the_smallest_tables(spark, folder, name):
    import duckdb

    from check_queries import TABLES, rows_of
    from oracle import all_sql

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{folder}/{t}.parquet'")
    df = all_queries()[name](spark, folder)
    want = con.sql(all_sql()[name])
    assert rows_of([tuple(r) for r in df.collect()], df.columns) == rows_of(want.fetchall(), want.columns)
