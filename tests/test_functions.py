"""Rounding, ranking, quantiles and the salted lookup against brute force."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from custlens.functions import ranking
from custlens.functions.columns import days_between, round_even, round_exact, rounded_exact
from custlens.functions.joins import lookup_join
from custlens.functions.ranking import average_percent_ranks, cumulative_counts, exact_quantiles, ordered_row_numbers


def test_rounding_matches_numpy_and_python(spark):
    rng = random.Random(7)
    xs = [2.675, 0.125, 1.005, 0.375, 1.015, 10.025, -0.3, -2.5, 0.0] + [rng.randrange(-200000, 200000) / 200.0 for _ in range(3000)]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    rows = df.select("x", round_even("x", 2).alias("np2"), round_exact("x", 2).alias("py2"), round_exact("x", 1).alias("py1"),
                     round_exact("x", 0).alias("py0")).collect()
    for r in rows:
        assert r.np2 == float(np.round(np.array([r.x]), 2)[0])
        assert (r.py2, r.py1, r.py0) == (round(r.x, 2), round(r.x, 1), round(r.x, 0))
    columns = df.select("x", F.col("x").alias("y"))
    assert all(r.y == round(r.x, 2) for r in rounded_exact(columns, {"y": 2}).collect())


def test_days_do_not_depend_on_the_session_zone(spark):
    a, b = datetime(2010, 3, 13, 12, 30, 15, 250000), datetime(2010, 3, 15, 2, 30)  # a clock change lies between
    df = spark.createDataFrame([(a, b)], "a timestamp_ntz, b timestamp_ntz")
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        for zone in ("UTC", "America/New_York"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            got = df.select(days_between("a", "b"), days_between("b", "a")).first()
            assert got[0] == (b - a) / timedelta(days=1) and got[1] == -got[0]
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_quantiles_match_numpy(spark):
    rng = np.random.default_rng(1)
    values = np.concatenate([rng.normal(0, 100, 900).round(2), np.full(600, 1.0), [-5e6, 7e7]])
    groups = rng.integers(0, 3, len(values))
    df = spark.createDataFrame(pd.DataFrame({"g": groups, "x": values}))
    probs = {"a": 0.25, "b": 0.5, "c": 0.75, "d": 0.95, "e": 0.99, "lo": 0.0, "hi": 1.0}
    for r in exact_quantiles(df, "x", probs, by=["g"]).collect():
        mine = values[groups == r.g]
        for name, p in probs.items():
            assert r[name] == float(np.percentile(mine, p * 100)), (name, r.g)
    whole = exact_quantiles(df, "x", {"m": 0.5}).first()
    assert whole.m == float(np.median(values))


def test_cumulative_counts_ignore_nulls(spark):
    df = spark.createDataFrame([(1.0,), (1.0,), (None,), (3.0,), (-2.0,), (float("nan"),)], "x double")
    got = {r.value: (r.n, r.below, r.total) for r in cumulative_counts(df, "x").collect()}
    assert got == {-2.0: (1, 0, 4), 1.0: (2, 1, 4), 3.0: (1, 3, 4)}


def test_percent_ranks_match_pandas(spark):
    rng = np.random.default_rng(3)
    a = np.where(rng.random(500) < 0.4, 1.0, rng.integers(0, 50, 500)).astype(float)
    b = rng.normal(0, 1, 500)
    b[rng.random(500) < 0.1] = np.nan
    pdf = pd.DataFrame({"customer_id": range(500), "a": a, "b": b})
    df = spark.createDataFrame(pdf).withColumn("b", F.when(~F.isnan("b"), F.col("b")))
    got = average_percent_ranks(df, "customer_id", {"ra": F.col("a"), "rb": F.col("b")}).toPandas().sort_values("customer_id")
    assert np.array_equal(got.ra.to_numpy(), pdf.a.rank(pct=True).to_numpy())
    assert np.array_equal(got.rb.to_numpy(), pdf.b.rank(pct=True).to_numpy(), equal_nan=True)


def test_row_numbers_in_buckets(spark):
    df = spark.range(1000).select("id", (F.col("id") % 3).alias("g"), F.md5(F.col("id").cast("string").cast("binary")).alias("h"))
    got = ordered_row_numbers(df, F.substring("h", 1, 2), ["h", "id"], "rn", by=["g"]).toPandas()
    want = got.sort_values(["g", "h", "id"]).groupby("g").cumcount() + 1
    assert (got.rn.sort_index() == want.sort_index()).all()


def test_lookup_join_with_hot_and_null_keys(spark):
    # Key 0 holds two thirds of the rows, some keys are null, some have no match.
    facts = spark.range(30000).select(
        "id", F.when(F.col("id") % 3 != 0, 0).when(F.col("id") % 9 == 0, None).otherwise(F.col("id") % 4001).alias("k")
    )
    lookup = facts.filter("k is not null AND k <> 7").groupBy("k").agg(F.count(F.lit(1)).alias("n")).withColumn("v", F.col("k") * 2)
    joined = lookup_join(facts, lookup, ["k"], "n", spread_by=["id"])
    r = joined.agg(
        F.count(F.lit(1)).alias("rows"), F.count_if((F.col("v") != F.col("k") * 2)).alias("wrong"),
        F.count_if(F.col("v").isNull() & F.col("k").isNotNull() & (F.col("k") != 7)).alias("lost"),
    ).first()
    assert (r.rows, r.wrong, r.lost) == (30000, 0, 0)


def test_changed_file_inside_a_table_makes_a_new_stage(spark, tmp_path):
    from custlens.functions import stages

    table = tmp_path / "t.parquet"
    spark.range(3).write.parquet(str(table))
    build = lambda: spark.read.parquet(str(table))
    first = stages.stage(spark, str(tmp_path), "rows", build)
    assert stages.stage(spark, str(tmp_path), "rows", build).inputFiles() == first.inputFiles()
    spark.range(5).write.mode("append").parquet(str(table))
    assert stages.stage(spark, str(tmp_path), "rows", build).count() == 8


def test_released_stages_are_gone(spark, monkeypatch, tmp_path):
    from custlens.functions import stages

    monkeypatch.setattr(stages, "shared_folder", lambda s: str(tmp_path))
    monkeypatch.setattr(stages, "_tables", {})
    assert stages.written(spark.range(4), "some").count() == 4
    assert list(tmp_path.glob("custlens/*/*"))
    stages.release(spark)
    assert not list(tmp_path.glob("custlens/*"))


def test_quantiles_of_many_groups_take_one_shuffle(spark, monkeypatch):
    rng = np.random.default_rng(4)
    values = rng.normal(0, 100, 6000).round(2)
    groups = np.where(rng.random(6000) < 0.3, 0, rng.integers(1, 400, 6000))  # one group with a third of all rows
    odd = pd.DataFrame({"g": ["7", None, "9999"], "x": [None, 1.0, float("nan")]}, dtype=object)
    df = spark.createDataFrame(
        list(zip(groups.astype(str).tolist(), values.tolist())) + [tuple(r) for r in odd.itertuples(index=False)], "g string, x double")
    probs = {"a": 0.25, "b": 0.5, "hi": 1.0}

    def check(got):
        assert {r.g for r in got} == set(groups.astype(str)) and len(got) == len(set(groups))
        for r in got:
            mine = values[groups == int(r.g)]
            assert r.total == len(mine)
            assert (r.a, r.b, r.hi) == (np.percentile(mine, 25), np.median(mine), mine.max())

    cut = exact_quantiles(df, "x", probs, by=["g"], many_groups=True)
    check(cut.collect())
    plan = cut._jdf.queryExecution().executedPlan().toString()
    assert plan[plan.index("== Final Plan"):plan.index("== Initial Plan")].count("Exchange hashpartitioning") <= 1
    monkeypatch.setattr(ranking.heavy_cells, "__defaults__", (ranking.CELLS, 500))
    assert 0 < df.filter(ranking.heavy_cells(df, ["g"])).count() < 4000
    check(exact_quantiles(df, "x", probs, by=["g"], many_groups=True).collect())
