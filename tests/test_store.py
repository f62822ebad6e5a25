"""Serving tables kept up to date by batches."""

from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from custlens.functions import files
from custlens.functions.stages import new_path
from custlens.streaming.store import TABLES, ServingStore

T = [datetime(2011, 1, d) for d in range(1, 6)]
SCORED = (
    "customer_id long, churn_probability double, is_churn boolean, predicted_clv_90d double, risk_tier string, segment_name string, "
    "is_anomaly boolean, anomaly_score double, model_version string, scored_at timestamp_ntz")


def base(spark):
    return {
        "customers": spark.createDataFrame([(1, "France", T[0], T[0], False)], "customer_id long, country string, first_order_date timestamp_ntz, last_order_date timestamp_ntz, is_uk boolean"),
        "customer_segments": spark.createDataFrame([(1, 3, "Old", 77.0, T[0])], "customer_id long, segment_id int, segment_name string, engagement_score double, updated_at timestamp_ntz"),
        "predictions": spark.createDataFrame([(1, 0.1, False, 5.0, "Low Risk", "v1", T[0])], "customer_id long, churn_probability double, is_churn boolean, predicted_clv double, risk_tier string, model_version string, scored_at timestamp_ntz"),
        "anomaly_reports": spark.createDataFrame([(1, 0.2, False, False, T[0])], "customer_id long, reconstruction_error double, is_anomaly_95 boolean, is_anomaly_99 boolean, flagged_at timestamp_ntz"),
    }


def scored(spark, at, *rows):
    return spark.createDataFrame([(c, p, p >= 0.5, 9.0, "High Risk", name, e > 0.3, e, "v1", at) for c, p, name, e in rows], SCORED)


def rows_of(store):
    return {t: sorted(map(str, store.tables()[t].collect())) for t in TABLES}


@pytest.fixture
def store(spark):
    store = ServingStore(spark, new_path(spark, "store"))
    store.create(base(spark), p99=0.8)
    return store


def test_batches(spark, store):
    assert store.apply(0, scored(spark, T[1], (1, 0.9, "New", 0.9), (2, 0.2, "Two", 0.1), (None, 0.2, "None", 0.1)))
    assert store.apply(1, scored(spark, T[2], (2, 0.6, "Two again", 0.4), (2, 0.7, "Two again", 0.4)))
    t = store.tables()
    assert {(r.customer_id, r.country, r.is_uk) for r in t["customers"].collect()} == {(1, "France", False), (2, "United Kingdom", True)}
    assert {(r.customer_id, r.segment_id, r.segment_name, r.engagement_score, r.updated_at) for r in t["customer_segments"].collect()} == {
        (1, 3, "New", 77.0, T[1]), (2, 0, "Two again", 50.0, T[2])}
    assert sorted((r.customer_id, r.churn_probability) for r in t["predictions"].collect()) == [(1, 0.1), (1, 0.9), (2, 0.2), (2, 0.6), (2, 0.7)]
    assert sorted((r.customer_id, r.reconstruction_error, r.is_anomaly_95, r.is_anomaly_99) for r in t["anomaly_reports"].collect()) == [
        (1, 0.2, False, False), (1, 0.9, True, True), (2, 0.1, False, False), (2, 0.4, True, False), (2, 0.4, True, False)]


def test_a_batch_counts_once(spark, store):
    first = scored(spark, T[1], (1, 0.9, "New", 0.9))
    assert store.apply(0, first)
    before = rows_of(store)
    assert not store.apply(0, first.withColumn("scored_at", F.lit(T[4])))
    assert rows_of(store) == before
    store.compact()
    assert rows_of(store) == before and store.pending() == []
    assert not store.apply(0, first)
    assert rows_of(store) == before


def test_a_batch_without_commit_does_not_count(spark, store):
    before = rows_of(store)
    scored(spark, T[1], (5, 0.9, "Lost", 0.9)).write.parquet(f"{store.folder}/deltas/000000000000")
    assert rows_of(store) == before
    assert store.apply(0, scored(spark, T[2], (6, 0.9, "Six", 0.9)))
    assert {r.customer_id for r in store.tables()["customers"].collect()} == {1, 6}


def test_compaction_at_any_time_gives_the_same_tables(spark):
    batches = [scored(spark, T[k + 1], (k, 0.5, f"s{k}", 0.1), (1, 0.5 + k / 10, f"one{k}", 0.9)) for k in range(3)]
    results = []
    for stops in ((), (0,), (0, 1, 2)):
        store = ServingStore(spark, new_path(spark, "store"))
        store.create(base(spark), p99=0.8)
        for k, batch in enumerate(batches):
            store.apply(k, batch)
            if k in stops:
                store.compact()
        results.append(rows_of(store))
        assert len(files.names(spark, f"{store.folder}/pointers")) == 1 + len(stops)
    assert results[0] == results[1] == results[2]
    store.compact()  # nothing new: no further snapshot
    assert len(files.names(spark, f"{store.folder}/pointers")) == 4


def test_a_late_batch_is_an_error(spark, store):
    store.apply(3, scored(spark, T[1], (1, 0.9, "New", 0.9)))
    store.compact()
    with pytest.raises(ValueError):
        store.apply(2, scored(spark, T[2], (1, 0.1, "Late", 0.1)))
