"""Cleaning, ingest and validation on hand-made lines."""

from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from custlens.operators import clean, validate
from custlens.sources.invoices import DataValidationError, check_raw_schema, load_raw
from tests.conftest import CLEAN_SCHEMA, RAW_SCHEMA, clean_line

D = datetime(2010, 1, 1, 8)


def raw(spark, rows):
    return spark.createDataFrame(rows, RAW_SCHEMA)


def test_raw_schema_check(spark):
    with pytest.raises(DataValidationError):
        check_raw_schema(spark.createDataFrame([("1", 2)], "Invoice string, Quantity int"))


def test_returns_flag_and_sign(spark):
    rows = [("489434", "a", "x", 10.0, D, 1.0, 1, "UK"), ("C489435", "a", "x", -2.0, D, 1.0, 1, "UK"),
            ("489436", "a", "x", -5.0, D, 1.0, 1, "UK"), ("C489437", "a", "x", 4.0, D, 1.0, 1, "UK"),
            (None, "a", "x", None, D, 1.0, 1, "UK")]
    got = [(r.is_return, r.quantity) for r in clean.flag_returns(raw(spark, rows)).collect()]
    assert got == [(False, 10.0), (True, -2.0), (True, -5.0), (True, -4.0), (False, None)]


def test_admin_codes(spark):
    codes = ["85048", "POST", "BANK CHARGES", "21232", "m ", "d", "POSTAGE1", "CRUK0064", None]
    rows = [("1", c, "x", 1.0, D, 1.0, 1, "UK") for c in codes]
    assert [r.stock_code for r in clean.drop_admin_codes(raw(spark, rows)).collect()] == ["85048", "21232", None]


def test_zero_and_missing_quantity(spark):
    rows = [("1", "a", "x", q, D, 1.0, 1, "UK") for q in (0.0, None, 2.0)]
    assert [r.quantity for r in clean.drop_zero_quantities(raw(spark, rows)).collect()] == [None, 2.0]


def test_prices(spark):
    rows = [("1", "a", "x", 1.0, D, p, 1, "UK") for p in (0.0, None, 0.001, -1.0, 5.0)]
    assert [r.price for r in clean.drop_invalid_prices(raw(spark, rows)).collect()] == [0.001, 5.0]


def test_copies_differing_in_country_only(spark):
    rows = [("1", "a", "x", 1.0, D, 1.0, 1, c) for c in ("France", "Belgium", "France")] + [("1", "a", "x", 1.0, D, 1.0, 2, "France")]
    flagged = clean.flag_returns(raw(spark, rows))
    got = sorted((r.customer_id, r.country, r.copies) for r in clean.drop_copies(flagged, "copies").collect())
    assert got == [(1, "Belgium", 3), (2, "France", 1)]


def test_description_vote(spark):
    rows = [("1", "a", d, 1.0, D, 1.0, i, "UK") for i, d in enumerate(["red mug", " Red Mug ", "mug red", "", "xy"])]
    rows += [("2", "b", d, 1.0, D, 1.0, 9, "UK") for d in ("beta", "alpha")] + [("3", "c", "no", 1.0, D, 1.0, 9, "UK")]
    rows += [("4", None, " own text", 1.0, D, 1.0, 9, "UK")]
    got = {(r.stock_code, r.description) for r in clean.standardize_descriptions(raw(spark, rows)).collect()}
    assert got == {("a", "RED MUG"), ("b", "ALPHA"), ("c", "NO"), (None, "OWN TEXT")}


def test_price_outlier_and_floor(spark):
    rows = [clean_line(1, str(i), D, amount=10.0, qty=1.0) for i in range(20)]
    rows += [clean_line(1, "big", D, amount=2001.0), clean_line(1, "edge", D, amount=2000.0), clean_line(1, "many", D, amount=10.0, qty=5001.0)]
    rows += [(*clean_line(1, "none", D)[:3], None, 10.0, *clean_line(1, "none", D)[5:])]
    df = spark.createDataFrame(rows, CLEAN_SCHEMA)
    bounds = clean.outlier_bounds(df).first()
    assert (bounds.max_quantity, bounds.max_price) == (5000.0, 2000.0)
    kept = {r.invoice for r in clean.drop_outliers(df).collect()}
    assert "big" not in kept and "many" not in kept and {"edge", "none"} <= kept


def test_whole_cleaning_and_audit(spark):
    rows = [
        ("1001", "22001", "Mug", 2.0, D, 5.0, 11, "UK"), ("1001", "22001", "Mug", 2.0, D, 5.0, 11, "UK"),
        ("1002", "22001", "mug", 1.0, D, 5.0, None, "UK"), ("1003", "22001", "mug", 1.0, D, 0.0, 11, "UK"),
        ("1004", "22001", "mug", 0.0, D, 5.0, 11, "UK"), ("1005", "POST", "post", 1.0, D, 5.0, 11, "UK"),
        ("C1006", "22001", "mug", 3.0, D, 5.0, 12, "UK"),
    ]
    out = clean.clean_transactions(raw(spark, rows))
    cleaned = out.cleaned.collect()
    assert sorted((r.invoice, r.quantity, r.total_amount, r.description) for r in cleaned) == [
        ("1001", 2.0, 10.0, "MUG"), ("C1006", -3.0, -15.0, "MUG")]
    assert {r.metric: r.value for r in out.audit.collect()} == {
        "initial_rows": 7, "missing_customers_dropped": 1, "invalid_prices_dropped": 1, "zero_quantities_dropped": 1,
        "admin_codes_removed": 1, "duplicates_removed": 1, "extreme_records_removed": 0, "final_rows": 2,
        "return_rows_count": 1, "unique_customers": 2}
    keep_all = clean.clean_transactions(raw(spark, rows), drop_missing=False, remove_admin=False, cap_outliers=False)
    assert keep_all.cleaned.count() == 4


def test_validation(spark):
    good = spark.createDataFrame([clean_line(1, "1", D), clean_line(1, "C2", D, amount=-5.0, qty=-1.0, ret=True)], CLEAN_SCHEMA)
    s = validate.validate_cleaned(good).first()
    assert (s.total_records, s.unique_customers, s.return_transactions, s.return_rate, s.total_revenue) == (2, 1, 1, 0.5, 5.0)
    bad = good.withColumn("customer_id", F.lit(None).cast("bigint"))
    with pytest.raises(DataValidationError):
        validate.validate_cleaned(bad)
    with pytest.raises(DataValidationError):
        validate.validate_cleaned(good.filter("false"))
    with pytest.raises(DataValidationError):
        validate.validate_cleaned(good.drop("country"))
    late = good.withColumn("invoice_date", F.col("invoice_date") + F.expr("INTERVAL 20 YEARS"))
    assert {r.rule: r.passed for r in validate.validation_rules(late).collect()}["date_range"] is False
    assert validate.validate_cleaned(late).first().total_records == 2


def test_ingest_sheets_and_cache(spark, tmp_path):
    header = "Invoice,StockCode,Description,Quantity,InvoiceDate,Price,Customer ID,Country\n"
    for name, line in (("a", " 1001 ,22001,Mug,2,2010-01-05 10:00:00,2.5,17850.0,France\n"), ("b", "1002,22002,,x,not a date,abc,,\n")):
        (tmp_path / name).mkdir()
        (tmp_path / name / "part.csv").write_text(header + line)
    cache = str(tmp_path / "cache")
    paths = [str(tmp_path / "a"), str(tmp_path / "b")]
    first = {r.invoice: r for r in load_raw(spark, paths, "csv", cache).collect()}
    assert first["1001"].customer_id == 17850 and first["1001"].invoice_date == datetime(2010, 1, 5, 10)
    r = first["1002"]
    assert (r.description, r.quantity, r.price, r.invoice_date, r.customer_id, r.country) == ("", None, None, None, None, "Unspecified")
    again = load_raw(spark, ["/does/not/exist"], "csv", cache)
    assert again.count() == 2
