"""A local session and small helpers."""

from __future__ import annotations

import sys
from datetime import datetime
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

CLEAN_SCHEMA = (
    "invoice string, stock_code string, description string, quantity double, price double, customer_id bigint, "
    "invoice_date timestamp_ntz, country string, total_amount double, is_return boolean"
)
RAW_SCHEMA = (
    "invoice string, stock_code string, description string, quantity double, invoice_date timestamp_ntz, price double, "
    "customer_id bigint, country string"
)


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]").appName("tests")
        .config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared"))).getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session


@pytest.fixture(scope="session")
def folder():
    return "/root/testdata/sf0.001"


def clean_line(customer, invoice, when, amount=10.0, code="22001", qty=1.0, price=None, country="United Kingdom", ret=False):
    return (invoice, code, "ITEM", qty, amount / qty if price is None else price, customer, when, country, amount, ret)


@pytest.fixture(scope="session")
def window_lines(spark):
    """Customers 101 to 103 around the cutoff 2010-06-01."""
    d = datetime
    rows = [
        ("INV01", "22001", "Homeware Item", 5.0, 10.0, 101, d(2010, 1, 15, 10), "United Kingdom", 50.0, False),
        ("INV02", "21002", "Decor Item", 10.0, 5.0, 101, d(2010, 3, 20, 11), "United Kingdom", 50.0, False),
        ("INV03", "85003", "Lighting Item", 2.0, 20.0, 102, d(2010, 2, 10, 9), "United Kingdom", 40.0, False),
        ("INV04", "22001", "Homeware Item", 8.0, 10.0, 102, d(2010, 4, 1, 14), "United Kingdom", 80.0, False),
        ("INV05", "22001", "Homeware Item", 50.0, 10.0, 101, d(2010, 8, 15, 12), "United Kingdom", 500.0, False),
        ("INV06", "21002", "Decor Item", 100.0, 5.0, 103, d(2010, 9, 1, 16), "United Kingdom", 500.0, False),
    ]
    return spark.createDataFrame(rows, CLEAN_SCHEMA)


def by_key(df, key="customer_id"):
    return {r[key]: r for r in df.collect()}
