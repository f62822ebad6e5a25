"""Shuffles of raw lines on the way to cleaned ones."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from custlens.operators import clean
from custlens.operators.features import rfm_features
from custlens.operators.orders import customer_order_facts
from custlens.plans import job_queries, tables
from custlens.sources.star import raw_transactions
from tests.conftest import CLEAN_SCHEMA, RAW_SCHEMA, clean_line

D = datetime(1995, 5, 5)


def star(spark, folder):
    tables = {
        "lineitem": ([(3, 1, 4, 1, 5.0, 10.0, "N", "O"), (3, 1, 4, 5, 5.0, 10.0, "R", "F"), (20, 2, 0, 7, 2.0, 8.0, "R", "O"),
                      (7, 2, None, 3, 1.0, 9.0, None, "O"), (7, None, 3, 1, 1.0, 9.0, "N", "O"), (99, 1, 3, 1, 1.0, 9.0, "N", "O")],
                     "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
                     "l_extendedprice double, l_returnflag string, l_linestatus string"),
        "orders": ([(3, 11, D), (20, 12, D), (7, 11, D), (8, 12, D)], "o_orderkey bigint, o_custkey bigint, o_orderdate timestamp_ntz"),
        "customer": ([(11, 1), (12, 0)], "c_custkey bigint, c_nationkey int"),
        "nation": ([(0, "PERU"), (1, "CHINA")], "n_nationkey int, n_name string"),
        "part": ([(1, "red ring", "Brand#7"), (2, "old bolt", "Brand#16")], "p_partkey bigint, p_name string, p_brand string"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_raw_lines_of_a_hand_made_star(spark, tmp_path):
    got = [tuple(r) for r in raw_transactions(spark, star(spark, tmp_path)).collect()]
    plain = ("3", "07000001", "red ring", 5.0, D, 10.0, 11, "CHINA")
    void = ("C3", "07000001", "", 5.0, D, 10.0, 11, "CHINA")
    assert sorted(got, key=str) == sorted([
        plain, plain, void, void,  # every 25th order comes twice
        ("20", "POST", "old bolt", -2.0, D, 8.0, None, "United Kingdom"),
        ("7", "16000002", "  OLD BOLT", 1000.0, D, 9.0, 11, "CHINA"),
    ], key=str)


def test_copies_merge_where_the_join_leaves_them(spark, tmp_path):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        merged = clean.drop_copies(clean.flag_returns(raw_transactions(spark, star(spark, tmp_path))))
        plan = merged._jdf.queryExecution().executedPlan().toString()
        # Orders by customer and invoice, customers, lines by part and invoice, parts: none by the eight keys of a copy.
        assert plan.count("Exchange hashpartitioning") == 6
        assert merged.count() == 4
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_voting_lines_leave_their_description_behind(spark, monkeypatch):
    rows = [("1", "22001", "red ring", 1.0, D, 1.0, 1, "UK"), ("2", "22001", " Red Ring", 1.0, D, 1.0, 1, "UK"),
            ("3", "22001", "x", 1.0, D, 1.0, 1, "UK"), ("4", "22002", "y ", 1.0, D, 1.0, 1, "UK"),
            ("5", None, "lonely one", 1.0, D, 1.0, 1, "UK"), ("6", "22002", None, 1.0, D, 1.0, 1, "UK")]
    sent = []

    def spied(facts, *more, join=clean.lookup_join, **named):
        sent.append(facts)
        return join(facts, *more, **named)

    monkeypatch.setattr(clean, "lookup_join", spied)
    out = clean.standardize_descriptions(spark.createDataFrame(rows, RAW_SCHEMA))
    assert {r.invoice: r.description for r in out.collect()} == {
        "1": "RED RING", "2": "RED RING", "3": "RED RING", "4": "Y", "5": "LONELY ONE", "6": ""}
    assert {r.invoice for r in sent[0].filter(F.col("description").isNull()).collect()} == {"1", "2"}


def test_customers_without_gaps_need_no_days(spark):
    lines = spark.createDataFrame(
        [clean_line(1 + i % 5, f"I{i // 3}-{i % 5}", datetime(2010, 1 + i % 12, 1 + i % 27, i % 24), 1.0 + i, f"{22 + i % 2}001", 1.0 + i % 4,
                    ret=i % 7 == 0) for i in range(200)], CLEAN_SCHEMA)
    cutoff = datetime(2010, 11, 1)
    days, direct = (customer_order_facts(lines, cutoff, gaps=g) for g in (True, False))
    assert sorted(map(tuple, days.select(*direct.columns).collect())) == sorted(map(tuple, direct.collect()))
    plan = rfm_features(lines, cutoff)._jdf.queryExecution().executedPlan().toString()
    assert "day#" not in plan and "Window" not in plan


def test_round_trip_of_cleaned_lines_makes_the_raw_lines_once(spark, tmp_path, monkeypatch):
    folder = star(spark, tmp_path)
    old = datetime(1994, 5, 5)
    spark.createDataFrame([(3, 11, D), (20, 12, D), (7, 11, old)], "o_orderkey bigint, o_custkey bigint, o_orderdate timestamp_ntz").write.mode(
        "overwrite").parquet(f"{folder}/orders.parquet")
    seen, raw = spark.sparkContext.accumulator(0), tables.raw

    def counted(s, d):
        def run(batches):
            for batch in batches:
                seen.add(batch.num_rows)
                yield batch

        lines = raw(s, d)
        return lines.mapInArrow(run, lines.schema)

    monkeypatch.setattr(tables, "raw", counted)
    got = job_queries.cleaned_roundtrip(spark, folder).collect()
    assert [(r.invoice, r.description, r.quantity, r.invoice_date) for r in got] == [("7", "OLD BOLT", 1000.0, old)]
    assert seen.value == 6
