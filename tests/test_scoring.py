"""Texts, scoring records, serving tables, reports and the stream."""

from __future__ import annotations

import math
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from custlens.functions.stages import new_path
from custlens.operators import explain, scoring, serving
from custlens.sources.invoices import DataValidationError
from custlens.sources.uploads import read_scoring_csv
from custlens.streaming.scoring import read_scored, start_scoring, write_scored_batch
from tests.conftest import by_key

T1, T2 = datetime(2011, 1, 1), datetime(2011, 2, 1)
FACTOR = "customer_id long, p double, factors array<struct<feature string, value double, attribution double>>"


def text(spark, cid, p, factors):
    df = spark.createDataFrame([(cid, p, factors)], FACTOR)
    return df.select(explain.narrative(F.col("customer_id"), F.col("p"), F.col("factors"))).first()[0]


def test_narrative_high_risk(spark):
    got = text(spark, 14527, 0.825, [("recency_days", 240.0, 0.85), ("velocity_acceleration", 0.1, 0.45), ("total_spend", 1500.0, -0.30)])
    assert got == ("Customer #14527 is evaluated as **High Churn Risk** with a predicted churn probability of **82.5%**. "
                   "The primary factors driving this risk are **240 days of inactivity and a significant deceleration in recent ordering pace**. "
                   "Conversely, the customer's risk is mitigated by **strong lifetime spend of £1,500.00**. "
                   "Immediate proactive retention outreach is recommended.")


def test_narrative_low_risk_and_rare_phrases(spark):
    got = text(spark, 13085, 0.12, [("total_spend", 4500.0, -0.9), ("frequency", 25.0, -0.75), ("return_line_rate", 0.05, 0.1)])
    assert "Healthy / Low Risk" in got and "12.0%" in got and "loyalty rewards" in got and "an elevated return rate of 5.0%" in got
    assert "a history of 25 completed orders" in got
    got = text(spark, 1, 0.5, [("recent_orders_last_90d", 1.0, 0.3), ("is_uk", 1.0, 0.2), ("log_frequency", 2.5, -0.1), ("engagement_score", 61.5, -0.1)])
    assert "only 1 orders in the last 90 days and is uk (1.0)" in got
    assert "a history of 2 completed orders and a resilient customer health score of 62/100" in got  # half-even
    assert "driving" not in text(spark, 1, 0.5, [])


def test_top_factors(spark):
    factors = [(f"f{i}", float(i), (-1) ** i * i / 10.0) for i in range(12)]
    df = spark.createDataFrame([(1, 0.5, factors)], FACTOR)
    got = df.select(explain.top_factors(F.col("factors")).alias("t")).first().t
    assert [f.feature for f in got] == [f"f{i}" for i in range(11, 3, -1)]
    assert got[0].direction == "Decreases Risk (Protective)" and got[1].direction == "Increases Risk"


def test_playbook(spark):
    df = spark.createDataFrame([(7, p, 100.4, 3.0, 1234.5, 99.0) for p in (0.7, 0.4, 0.39)], "k long, p double, r double, o double, s double, c double")
    got = [r[0] for r in df.select(explain.playbook(*[F.col(c) for c in "kprosc"])).collect()]
    assert "High Churn Risk (70.0%)" in got[0] and "£99.00" in got[0] and "100 days" in got[0]
    assert "Moderate Churn Risk (40.0%)" in got[1] and "£1,234.50 spend" in got[1]
    assert "Low Risk (39.0%)" in got[2]


def records(spark, rows):
    """Records with the fields given, all others missing."""
    out = [tuple(r.get(f) for f in scoring.SCORING_SCHEMA.fieldNames()) for r in rows]
    return spark.createDataFrame(out, scoring.SCORING_SCHEMA)


def test_impute_defaults(spark):
    rows = [{"customer_id": 1, "recency_days": 120.0, "frequency": 1.0, "total_spend": 35.0},
            {"customer_id": 2, "recency_days": 0.0, "frequency": 0.0, "total_spend": -10.0},
            {"customer_id": 3, "recency_days": 10.0, "frequency": 4.0, "total_spend": 400.0, "total_items": 20.0,
             "unique_products_count": 6.0, "tenure_days": 100.0, "engagement_score": 12.0, "gross_spend": 500.0}]
    got = by_key(scoring.impute(records(spark, rows)))
    a, b, c = got[1], got[2], got[3]
    assert (a.avg_order_value, a.avg_basket_size, a.avg_unique_products_per_order, a.tenure_days, a.days_active_span) == (35.0, 10.0, 3.0, 120.0, 0.0)
    assert (a.inter_purchase_mean, a.is_single_order, a.velocity_acceleration, a.is_uk) == (120.0, 1.0, 1.0, 1.0)
    assert a.engagement_score == pytest.approx(50 + 3 + 0.35 - 24) and a.log_frequency == pytest.approx(math.log(2))
    # A recency of 0 counts as 30 days in the derived values, no orders as one.
    assert (b.recency_days, b.frequency, b.tenure_days, b.gross_spend, b.avg_order_value) == (0.0, 0.0, 30.0, 0.0, -10.0)
    assert b.engagement_score == pytest.approx(50 + 3 - 0.1 - 6) and b.log_total_spend == 0.0
    assert (c.gross_spend, c.avg_basket_size, c.avg_unique_products_per_order, c.days_active_span) == (500.0, 5.0, 1.5, 90.0)
    assert (c.inter_purchase_mean, c.engagement_score, c.is_single_order) == (pytest.approx(100 / 3), 12.0, 0.0)


def test_range_checks(spark):
    rows = [{"customer_id": 1, "recency_days": -10.0, "frequency": 1.0, "total_spend": 1.0},
            {"customer_id": 2, "recency_days": 1.0, "total_spend": 1.0, "return_line_rate": 1.5},
            {"customer_id": 3, "recency_days": 0.0, "frequency": 0.0, "total_spend": -5.0, "engagement_score": 100.0}]
    good, bad = scoring.check_records(records(spark, rows))
    assert [r.customer_id for r in good.collect()] == [3]
    got = by_key(bad)
    assert got[1].reject_reasons == ["recency_days < 0"]
    assert got[2].reject_reasons == ["frequency is missing", "return_line_rate > 1"]


def scorer(df):
    p = 1.0 / (1.0 + F.exp(-(F.col("recency_days") / 100 - F.col("frequency") / 5)))
    factor = F.struct(F.lit("recency_days").alias("feature"), F.col("recency_days").alias("value"), (F.col("recency_days") / 100).alias("attribution"))
    return df.withColumns({"probability": p, "clv": F.col("total_spend") * 0.45, "segment_name": F.lit("Loyal Regulars"),
                           "anomaly_error": F.col("recency_days") / 1000, "anomaly_limit": F.lit(0.1), "factors": F.array(factor)})


ROWS = [{"customer_id": 88001, "recency_days": 14.0, "frequency": 9.0, "total_spend": 2150.0},
        {"customer_id": 88002, "recency_days": 125.0, "frequency": 1.0, "total_spend": 42.5},
        {"customer_id": None, "recency_days": 300.0, "frequency": 1.0, "total_spend": -5.0},
        {"customer_id": 88004, "recency_days": -1.0, "frequency": 1.0, "total_spend": 1.0}]


def test_scored_records_and_summary(spark):
    scored, bad = scoring.score_batch(records(spark, ROWS), scorer, "v1.0.0", T1)
    got = {r.customer_id: r for r in scored.collect()}
    assert set(got) == {88001, 88002, None} and bad.count() == 1
    assert got[88002].risk_tier == "High Risk" and got[88002].is_churn and got[88002].is_anomaly
    assert got[88001].risk_tier == "Low Risk" and got[88001].predicted_clv_90d == 967.5 and not got[88001].is_anomaly
    assert got[None].plain_language_narrative.startswith("Customer #99999 ") and got[None].predicted_clv_90d == 0.0
    s = scoring.batch_summary(scored).first()
    assert (s.total_records, s.anomalies_detected) == (3, 2) and 0 <= s.churn_rate <= 1
    none = scoring.batch_summary(scored.filter("false")).first()
    assert (none.total_records, none.churn_rate, none.mean_predicted_clv, none.anomalies_detected) == (0, 0.0, 0.0, 0)


def test_upsert_and_history(spark):
    customers = spark.createDataFrame([(88001, "France", T1, T1, False)], "customer_id long, country string, first_order_date timestamp_ntz, last_order_date timestamp_ntz, is_uk boolean")
    segs = spark.createDataFrame([(88001, 3, "Old", 77.0, T1), (5, 1, "Other", 20.0, T1)], "customer_id long, segment_id int, segment_name string, engagement_score double, updated_at timestamp_ntz")
    first, _ = scoring.score_batch(records(spark, ROWS), scorer, "v1.0.0", T1)
    second, _ = scoring.score_batch(records(spark, ROWS), scorer, "v1.0.0", T2)
    c = by_key(serving.upsert_customers(customers, second))
    assert set(c) == {88001, 88002} and c[88001].country == "France" and c[88002].is_uk
    twice = serving.upsert_customers(serving.upsert_customers(customers, second), second)
    assert twice.count() == 2
    s = by_key(serving.upsert_segments(segs, second.unionByName(first)))
    assert (s[88001].segment_id, s[88001].segment_name, s[88001].engagement_score, s[88001].updated_at) == (3, "Loyal Regulars", 77.0, T2)
    assert (s[88002].segment_id, s[88002].engagement_score) == (0, 50.0) and s[5].segment_name == "Other"
    empty = serving.append_predictions(serving.predictions_table(scorer(scoring.impute(records(spark, []))), "v", T1), first)
    history = serving.append_predictions(empty, second)
    assert history.count() == 4 and {r.scored_at for r in serving.latest(history, "scored_at").collect()} == {T2}
    anomalies = serving.append_anomalies(
        serving.anomalies_table(scorer(scoring.impute(records(spark, []))), F.lit(0.1), F.lit(0.2), T1), second, F.lit(0.2))
    assert {r.customer_id: r.is_anomaly_99 for r in anomalies.collect()} == {88001: False, 88002: False}
    features = scoring.impute(records(spark, ROWS[:2]))
    full = by_key(serving.customer_360(serving.upsert_customers(customers, second), segs, history, anomalies, features))
    assert full[88002].historical_predictions_count == 2 and full[88002].latest_prediction.scored_at == T2
    assert [p.scored_at for p in serving.prediction_history(history, 88001).collect()] == [T2, T1]
    assert full[88002].segment is None and full[88001].rfm_metrics.frequency == 9.0
    page = serving.customer_page(serving.upsert_customers(customers, second), segs, history, features, limit=1, offset=1).collect()
    assert [r.customer_id for r in page] == [88002] and page[0].historical_predictions_count == 1
    with pytest.raises(ValueError):
        serving.customer_page(customers, segs, history, features, limit=201)


def test_leaderboard(spark):
    rows = [(i, "S", 0.5 + i / 20.0, 100.0 * i if i != 4 else None, 1.0, 1, 1000.0 * i, "High Risk") for i in range(1, 8)]
    cohort = spark.createDataFrame(rows, "customer_id long, segment_name string, churn_probability double, predicted_clv double, recency_days double, frequency int, total_spend double, risk_tier string")
    risky = serving.at_risk(cohort)
    top = serving.leaderboard(risky, 2).collect()
    assert [r.customer_id for r in top] == [4, 7] and top[0].priority_revenue_at_risk == 1400.0
    total = serving.leaderboard_total(risky).first()
    assert total.accounts == 6 and total.revenue_at_risk == pytest.approx(sum(r.priority_revenue_at_risk for r in risky.collect()))
    assert serving.at_risk(cohort, tier="Low Risk").count() == 0
    assert serving.leaderboard_total(serving.at_risk(cohort, min_risk=2.0)).first().revenue_at_risk == 0.0
    assert serving.fixed_sample(cohort, 3).collect() == serving.fixed_sample(cohort.repartition(4), 3).collect()


def test_segment_filter_and_view(spark):
    rows = [(i, "A" if i % 2 else "B", "France" if i < 50 else "Spain", 91.0 if i == 0 else 90.0, 1, float(i)) for i in range(101)]
    seg = spark.createDataFrame(rows, "customer_id long, segment_name string, primary_country string, recency_days double, frequency int, total_spend double")
    assert serving.segment_filter(seg).count() == 99  # the 98th percentile is 98
    got = serving.segment_filter(seg, personas=["A"], country="France", low=10.0, high=20.0).collect()
    assert sorted(r.customer_id for r in got) == [11, 13, 15, 17, 19]
    scored = scorer(scoring.impute(records(spark, [{**ROWS[0], "customer_id": 5}])))
    p, a = serving.predictions_table(scored, "v", T1), serving.anomalies_table(scored, F.lit(0.01), F.lit(0.02), T1)
    newer = p.withColumns({"scored_at": F.lit(str(T2)).cast("timestamp_ntz"), "churn_probability": F.lit(0.9), "risk_tier": F.lit("High Risk")})
    view = serving.cohort_view(seg, p.unionByName(newer), a)
    v = by_key(view)
    assert len(v) == 101 == view.count()  # history does not repeat customers
    assert (v[5].churn_probability, v[5].risk_tier, v[5].is_anomaly_95) == (0.9, "High Risk", True)
    assert (v[0].churn_probability, v[0].risk_tier, v[1].churn_probability, v[2].predicted_clv) == (0.85, "High Risk", 0.25, 0.9)
    k = serving.kpis(view).first()
    assert (k.customers, k.high_risk, k.anomalies) == (101, 2, 1)


def test_csv_upload(spark, tmp_path):
    path = str(tmp_path / "in.csv")
    (tmp_path / "in.csv").write_text("customer_id,recency_days,frequency,total_spend,extra\n1,10,2,50.5,a\n2,many,1,5,b\n3,5,1,7.5,c\n")
    good, bad = read_scoring_csv(spark, path, scoring.SCORING_SCHEMA)
    assert {r.customer_id: r.total_spend for r in good.collect()} == {1: 50.5, 3: 7.5}
    assert bad.count() == 1 and good.columns == scoring.SCORING_SCHEMA.fieldNames()
    (tmp_path / "empty.csv").write_text("customer_id,recency_days\n")
    with pytest.raises(DataValidationError):
        read_scoring_csv(spark, str(tmp_path / "empty.csv"), scoring.SCORING_SCHEMA)
    (tmp_path / "x.json").write_text("{}")
    with pytest.raises(DataValidationError):
        read_scoring_csv(spark, str(tmp_path / "x.json"), scoring.SCORING_SCHEMA)


def test_upload_columns_by_name(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.csv").write_text("customer_id,recency_days,frequency,total_spend\n1,10,2,50.5\n2,NaN,1,5\n")
    (folder / "b.csv").write_text("total_spend,extra,customer_id,frequency,recency_days\n900,x,7,3,4\n")
    (folder / "c.csv").write_text("customer_id,total_spend\n9,1\n")
    good, bad = read_scoring_csv(spark, str(folder), scoring.SCORING_SCHEMA)
    rows = {r.customer_id: (r.recency_days, r.frequency, r.total_spend) for r in good.collect()}
    assert rows == {1: (10.0, 2.0, 50.5), 2: (None, 1.0, 5.0), 7: (4.0, 3.0, 900.0), 9: (None, None, 1.0)}
    assert bad.count() == 0
    _, rejected = scoring.check_records(good)
    assert {r.customer_id: r.reject_reasons for r in rejected.collect()} == {
        2: ["recency_days is missing"], 9: ["recency_days is missing", "frequency is missing"]}


def test_not_a_number_is_missing(spark):
    nan = spark.createDataFrame([(1, float("nan"), 2.0, 3.0)], "customer_id long, recency_days double, frequency double, total_spend double")
    full = nan.select("customer_id", *[
        F.col(f) if f in nan.columns else F.lit(None).cast("double").alias(f) for f in scoring.FIELDS])
    good, bad = scoring.check_records(full)
    assert good.count() == 0 and bad.first().reject_reasons == ["recency_days is missing"]


def test_raw_sheets_by_name(spark, tmp_path):
    from custlens.sources.invoices import read_sheet

    folder = tmp_path / "raw"
    folder.mkdir()
    (folder / "a.csv").write_text("Invoice,StockCode,Description,Quantity,InvoiceDate,Price,Customer ID,Country\n1,a,x,5,2010-01-01,2.5,7,UK\n")
    (folder / "b.csv").write_text("Invoice,StockCode,Description,Price,InvoiceDate,Quantity,Customer ID,Country\n2,a,x,2.5,2010-01-01,5,7,UK\n")
    rows = read_sheet(spark, str(folder), "csv").select("Quantity", "Price").collect()
    assert [tuple(r) for r in rows] == [("5", "2.5")] * 2


def test_stream_is_repeatable(spark):
    folder = new_path(spark, "stream_test")
    header = True
    records(spark, ROWS).write.option("header", header).csv(f"{folder}/in")
    times = iter([T1, T2, T2, T2])
    run = lambda: start_scoring(
        spark, f"{folder}/in", f"{folder}/out", scorer, "v1.0.0", once=True, clock=lambda: next(times)).awaitTermination()
    run()
    first = read_scored(spark, f"{folder}/out").select("customer_id", "churn_probability").orderBy("customer_id").collect()
    assert [r.customer_id for r in first] == [None, 88001, 88002]
    run()  # nothing new
    # The same batch again, as after a failure: it replaces its folder.
    none = spark.createDataFrame([], "_corrupt string")
    write_scored_batch(records(spark, ROWS), none, 0, f"{folder}/out", scorer, "v1.0.0", T1)
    assert read_scored(spark, f"{folder}/out").select("customer_id", "churn_probability").orderBy("customer_id").collect() == first
    # a customer twice: both records are scored, at the time of their batch
    records(spark, [{**ROWS[0], "customer_id": 99}] * 2).write.mode("append").option("header", header).csv(f"{folder}/in")
    run()
    scored = read_scored(spark, f"{folder}/out")
    assert scored.count() == 5
    assert {r.customer_id: r.scored_at for r in scored.collect()} == {None: T1, 88001: T1, 88002: T1, 99: T2}
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/in/bad.csv")
    out = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(path)
    # few columns in another order, and one bad cell
    out.write(b"total_spend,frequency,customer_id,recency_days\n10,oops,7,5\n20,3,8,6\n")
    out.close()
    run()
    assert read_scored(spark, f"{folder}/out").filter("customer_id = 8").count() == 1
    rejected = spark.read.option("mergeSchema", True).parquet(f"{folder}/out/rejected")
    assert rejected.filter("_corrupt like '10,oops%'").first().reject_reasons == ["unreadable cell"]
    assert rejected.filter("customer_id = 88004").count() == 1
