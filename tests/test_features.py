"""Point-in-time features on hand-made lines."""

from __future__ import annotations

from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from custlens.functions import ranking
from custlens.operators import eda, features as feat, orders
from custlens.sources import sinks
from tests.conftest import CLEAN_SCHEMA, by_key, clean_line

CUTOFF = datetime(2010, 6, 1)


def test_rfm_point_in_time(window_lines):
    rows = by_key(feat.rfm_features(window_lines, CUTOFF))
    assert set(rows) == {101, 102}
    assert (rows[101].total_spend, rows[101].frequency) == (100.0, 2)
    assert rows[101].recency_days == (CUTOFF - datetime(2010, 3, 20, 11)) / timedelta(days=1)


def test_no_leakage_from_later_lines(window_lines):
    late = F.col("invoice_date") > F.lit(str(CUTOFF)).cast("timestamp_ntz")
    changed = window_lines.withColumns({
        "total_amount": F.when(late, 1_000_000.0).otherwise(F.col("total_amount")),
        "quantity": F.when(late, 10_000.0).otherwise(F.col("quantity")),
        "price": F.when(late, 0.01).otherwise(F.col("price")),
        "country": F.when(late, "Elsewhere").otherwise(F.col("country")),
    })
    labels = ["churn", "clv_next_90d", "target_orders_count"]
    before = feat.customer_features(window_lines, CUTOFF).drop(*labels).orderBy("customer_id").collect()
    after = feat.customer_features(changed, CUTOFF).drop(*labels).orderBy("customer_id").collect()
    assert before == after


def test_targets(window_lines):
    rows = by_key(feat.forward_targets(window_lines, CUTOFF))
    assert (rows[101].churn, rows[101].clv_next_90d, rows[101].target_orders_count) == (0, 500.0, 1)
    assert (rows[102].churn, rows[102].clv_next_90d, rows[102].target_orders_count) == (1, 0.0, 0)
    assert 103 not in rows


def test_window_edges(spark):
    lines = [
        clean_line(1, "a", CUTOFF), clean_line(1, "b", CUTOFF + timedelta(days=90)),
        clean_line(2, "c", CUTOFF - timedelta(days=90)), clean_line(2, "d", CUTOFF + timedelta(days=90, seconds=1)),
        clean_line(3, "e", CUTOFF - timedelta(days=90, seconds=1)),
        clean_line(3, "f", CUTOFF + timedelta(days=1), amount=-5.0, qty=-1.0, ret=True),
    ]
    df = spark.createDataFrame(lines, CLEAN_SCHEMA)
    t, v = by_key(feat.forward_targets(df, CUTOFF)), by_key(feat.velocity_features(df, CUTOFF))
    assert [t[i].churn for i in (1, 2, 3)] == [0, 1, 1] and t[3].clv_next_90d == 0.0
    assert [v[i].recent_orders_last_90d for i in (1, 2, 3)] == [1, 1, 0]


def test_basket_with_return(spark):
    lines = [clean_line(201, "A", datetime(2010, 1, 1), amount=50.0, qty=10.0),
             clean_line(201, "B", datetime(2010, 1, 5), amount=-10.0, qty=-2.0, ret=True)]
    r = feat.rfm_features(spark.createDataFrame(lines, CLEAN_SCHEMA), datetime(2010, 1, 10)).first()
    assert (r.total_spend, r.gross_spend, r.frequency, r.avg_basket_size) == (40.0, 50.0, 1, 10.0)


def test_return_only_customer(spark):
    d = datetime(2010, 1, 1)
    lines = [clean_line(1, "R", d, amount=-7.0, qty=-1.0, ret=True), clean_line(2, "S", d, amount=30.0),
             clean_line(3, "T", d + timedelta(days=5), amount=60.0), clean_line(3, "U", d + timedelta(days=9), amount=5.0)]
    rows = by_key(feat.customer_features(spark.createDataFrame(lines, CLEAN_SCHEMA), datetime(2010, 2, 1)))
    r = rows[1]
    assert (r.recency_days, r.frequency, r.total_spend, r.gross_spend) == (0.0, 0, -7.0, 0.0)
    assert (r.engagement_score, r.engagement_tier, r.has_returned, r.return_line_rate) == (0.0, "nan", 1, 1.0)
    assert (r.tenure_days, r.is_single_order, r.churn) == (0.0, 0, 1)
    # Spend ranks among three customers, recency and orders among two.
    want = 100 * (0.35 * (1 - 0.5) + 0.35 * 1.0 + 0.30 * 1.0)
    assert rows[3].engagement_score == pytest.approx(want, abs=0.006)


def test_velocity_matches_loop(spark):
    rng = np.random.default_rng(5)
    lines, dates = [], {}
    for c in range(40):
        n = int(rng.integers(1, 12))
        stamps = sorted(CUTOFF - timedelta(seconds=int(s)) for s in rng.integers(0, 400 * 86400, n))
        if c % 5 == 0 and n > 2:
            stamps[1] = stamps[0]
            stamps[2] = stamps[0] + timedelta(hours=1)
        dates[c] = sorted(stamps)
        for i, at in enumerate(dates[c]):
            lines += [clean_line(c, f"{c}-{i}", at), clean_line(c, f"{c}-{i}", at + timedelta(minutes=1), code="21002")]
        lines.append(clean_line(c, f"C{c}", CUTOFF - timedelta(days=200), amount=-1.0, qty=-1.0, ret=True))
    lines = [x for x in lines if x[6] <= CUTOFF]
    got = by_key(feat.velocity_features(spark.createDataFrame(lines, CLEAN_SCHEMA), CUTOFF))
    day = timedelta(days=1)
    for c, stamps in dates.items():
        n, r = len(stamps), got[c]
        tenure = max(1.0, (CUTOFF - stamps[0]) / day)
        gaps = [(b - a) / day for a, b in zip(stamps, stamps[1:])]
        recent = sum(s >= CUTOFF - 90 * day for s in stamps)
        assert r.tenure_days == round(tenure, 1)
        assert r.days_active_span == round((stamps[-1] - stamps[0]) / day, 1)
        assert r.inter_purchase_mean == pytest.approx(np.mean(gaps) if gaps else tenure, abs=0.0051)
        assert r.inter_purchase_std == pytest.approx(np.std(gaps) if len(gaps) > 1 else 0.0, abs=0.0051)
        assert (r.is_single_order, r.recent_orders_last_90d) == (int(n == 1), recent)
        pace = min(max(recent / max(n / tenure * 90.0, 0.1), 0.0), 10.0)
        assert r.velocity_acceleration == pytest.approx(pace, abs=5.1e-5)


def test_behaviour(spark):
    d = datetime(2010, 11, 1)
    lines = [clean_line(1, "a", d, amount=10.0, code="22001", country="France"), clean_line(1, "b", datetime(2010, 3, 1), amount=8.0, code="22001", country="Spain"),
             clean_line(2, "c", d, amount=10.0, code="22001"), clean_line(2, "d", d, amount=30.0, code="99001"),
             clean_line(2, "Cx", d, amount=-10.0, qty=-1.0, code="22001", ret=True)]
    rows = by_key(feat.behavior_features(spark.createDataFrame(lines, CLEAN_SCHEMA), datetime(2010, 12, 1)))
    assert rows[1].seasonal_q4_order_share == 0.5 and rows[1].seasonal_q4_spend_share == pytest.approx(10 / 18)
    assert rows[1].discount_sensitivity == 0.5  # 8 < 0.9 * median(8, 10, 10)
    assert rows[1].primary_country == "France" and rows[1].is_uk == 0  # tie: alphabet
    assert (rows[2].cat_affinity_22, rows[2].cat_affinity_21) == (0.25, 0.0)
    assert (rows[2].return_spend_ratio, rows[2].has_returned, rows[2].is_uk) == (0.25, 1, 1)


def test_engagement_order_and_edges(spark):
    df = spark.createDataFrame([(1, 5.0, 20, 5000.0), (2, 100.0, 3, 200.0), (3, 400.0, 1, 20.0)],
                               "customer_id long, recency_days double, frequency long, total_spend double")
    rows = by_key(feat.engagement_scores(df))
    scores = [rows[i].engagement_score for i in (1, 2, 3)]
    assert scores == sorted(scores, reverse=True) and 0 <= min(scores) and max(scores) <= 100
    assert (rows[1].engagement_tier, rows[3].engagement_tier) == ("High", "Low")
    tiers = spark.createDataFrame([(40.0,), (40.01,), (70.0,), (70.01,), (None,)], "s double")
    got = [r[0] for r in tiers.select(feat.engagement_tier(F.col("s"))).collect()]
    assert got == ["Low", "Medium", "Medium", "High", "nan"]


def test_build_and_write(spark, window_lines, tmp_path):
    df = feat.customer_features(window_lines, CUTOFF)
    assert df.count() == 2 and len(df.columns) == 39
    feat.check_features(df, 2)
    with pytest.raises(AssertionError):
        feat.check_features(df, 3)
    sinks.write_features(df, eda.cohort_summary(df), feat.FEATURE_DICTIONARY, str(tmp_path))
    back = spark.read.parquet(str(tmp_path / "customer_features"))
    assert back.count() == 2 and back.schema["recency_days"].metadata["comment"]
    assert spark.read.option("header", True).csv(str(tmp_path / "customer_features_csv")).count() == 2
    assert spark.read.json(str(tmp_path / "feature_metadata")).first().cohort_size == 2


def test_features_do_not_depend_on_partitioning(spark, window_lines):
    one = feat.customer_features(window_lines.coalesce(1), CUTOFF).orderBy("customer_id").collect()
    many = feat.customer_features(window_lines.repartition(7), CUTOFF).orderBy("customer_id").collect()
    assert one == many


def test_hot_customer_and_product(spark):
    """One customer, invoice and product with most of the lines."""
    d = datetime(2010, 1, 1)
    base = spark.range(20000).select(
        F.when(F.col("id") % 3 > 0, "HOT").otherwise(F.concat(F.lit("i"), (F.col("id") % 500).cast("string"))).alias("invoice"),
        F.when(F.col("id") % 2 > 0, "22HOT").otherwise(F.concat(F.lit("21"), (F.col("id") % 700).cast("string"))).alias("stock_code"),
        F.lit("X").alias("description"), F.lit(1.0).alias("quantity"), F.lit(2.0).alias("price"),
        F.when(F.col("id") % 3 > 0, 1).otherwise(2 + F.col("id") % 50).cast("long").alias("customer_id"),
        F.lit(str(d)).cast("timestamp_ntz").alias("invoice_date"), F.lit("France").alias("country"),
        F.lit(2.0).alias("total_amount"), F.lit(False).alias("is_return"),
    )
    got = by_key(feat.customer_features(base, datetime(2010, 2, 1)))
    hot = base.filter("customer_id = 1")
    assert got[1].frequency == 1 and got[1].total_items == hot.count()
    assert got[1].unique_products_count == hot.select("stock_code").distinct().count()
    assert got[1].discount_sensitivity == 0.0


def test_eda(spark):
    d = datetime(2010, 1, 1)
    lines = [clean_line(1, "a", d, 100.0), clean_line(2, "b", d + timedelta(days=40), 50.0, country="France"),
             clean_line(3, "c", d + timedelta(days=10, hours=5), 25.0, country="Spain"),
             clean_line(1, "Cd", d + timedelta(days=60), -20.0, qty=-1.0, ret=True)]
    df = spark.createDataFrame(lines, CLEAN_SCHEMA)
    f = eda.findings(df).first()
    assert f.total_active_customers == 3 and f.median_spend == 50.0 and f.uk_revenue_share == pytest.approx(100 / 175)
    assert by_key(eda.simple_rfm(df))[3].recency == 49  # 49.79 days
    assert [r.country for r in eda.top_countries(df, 2).collect()] == ["United Kingdom", "France"]
    assert eda.returner_share(df).first()[0] == pytest.approx(1 / 3)
    values = spark.createDataFrame([(float(x),) for x in (1, 2, 2, 3, 10)], "x double")
    got = {r.bin: r.n for r in eda.histogram(values, "x", 4).collect()}
    want, _ = np.histogram([1, 2, 2, 3, 10], bins=4)
    assert [got.get(i, 0) for i in range(4)] == want.tolist()
    one = eda.histogram(values.filter("x = 2"), "x", 4).collect()
    assert [(r.bin, r.n) for r in one] == [(2, 2)]


def test_order_events_include_returns(spark):
    d = datetime(2010, 1, 1)
    lines = [clean_line(1, "a", d, 10.0), clean_line(1, "a", d + timedelta(minutes=5), -4.0, qty=-1.0, ret=True)]
    r = orders.order_events(spark.createDataFrame(lines, CLEAN_SCHEMA)).first()
    assert (r.invoice_date, r.total_amount, r.total_quantity, r.is_return) == (d, 6.0, 0.0, True)


def test_lines_of_an_order_meet_with_and_without_heavy_orders(spark, monkeypatch):
    """All sums: lines are dealt to their order; an order with a large share of them is summed up map-side before."""
    day = datetime(2010, 3, 1)
    rows = [clean_line(1, "BIG", day, 1.0 + i % 7, code=f"22{i:04d}", ret=i % 5 == 0) for i in range(900)]
    rows += [clean_line(i % 60, f"I{i % 200}" if i % 11 else None, day, 2.0, code=f"85{i:04d}") for i in range(1200)]
    lines = spark.createDataFrame(rows, CLEAN_SCHEMA).repartition(6)
    key = ["customer_id", "invoice"]
    merged = orders.order_totals(lines, all_sums=False)  # every order is summed up before the shuffle
    want = sorted(map(str, merged.collect()))
    dealt = orders.order_totals(lines)
    assert sorted(map(str, dealt.collect())) == want
    assert "REPARTITION_BY_COL" in dealt._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(ranking.heavy_cells, "__defaults__", (ranking.CELLS, 500))
    assert lines.filter(ranking.heavy_cells(lines, key)).count() >= 900
    assert sorted(map(str, orders.order_totals(lines).collect())) == want
