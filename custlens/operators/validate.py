"""Checks on cleaned lines."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, functions as F

from custlens.functions.columns import cents, timestamp
from custlens.operators.clean import CLEANED_COLUMNS
from custlens.sources.invoices import DataValidationError

MIN_DATE = datetime(2009, 11, 1)
MAX_DATE = datetime(2011, 12, 31)


def validation_rules(
    df: DataFrame,
    max_null_rate: float = 0.0,
    min_date: datetime = MIN_DATE,
    max_date: datetime = MAX_DATE,
    require_positive_price: bool = True,
) -> DataFrame:
    """One row per rule: violations, severity, and whether it holds. One pass."""
    outside = (F.col("invoice_date") < timestamp(min_date)) | (F.col("invoice_date") > timestamp(max_date))
    counted = df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col("customer_id").isNull()).alias("no_customer"),
        F.count_if(F.col("price") <= 0).alias("bad_price"),
        F.count_if(F.col("quantity") == 0).alias("zero_quantity"),
        F.count_if(outside).alias("outside"),
    )
    null_rate = F.when(F.col("rows") > 0, F.col("no_customer") / F.col("rows")).otherwise(0.0)
    price_ok = (F.col("bad_price") == 0) if require_positive_price else F.lit(True)

    def rule(name, violations, severity, holds):
        return F.struct(
            F.lit(name).alias("rule"), violations.cast("bigint").alias("violations"),
            F.lit(severity).alias("severity"), holds.alias("passed"),
        )

    return counted.select(F.inline(F.array(
        rule("non_empty", F.when(F.col("rows") == 0, 1).otherwise(0), "error", F.col("rows") > 0),
        rule("customer_id_null_rate", F.col("no_customer"), "error", null_rate <= max_null_rate),
        rule("positive_price", F.col("bad_price"), "error", price_ok),
        rule("non_zero_quantity", F.col("zero_quantity"), "error", F.col("zero_quantity") == 0),
        rule("date_range", F.col("outside"), "warning", F.col("outside") == 0),
    )))


def validation_summary(df: DataFrame) -> DataFrame:
    """One row: records, customers, invoices, dates, returns, revenue.

    Lines are reduced to (customer, invoice) first, so the two distinct counts
    run over orders.
    """
    orders = df.groupBy("customer_id", "invoice").agg(
        F.count(F.lit(1)).alias("lines"),
        F.count_if("is_return").alias("returns"),
        F.sum(cents("total_amount")).alias("cents"),
        F.min("invoice_date").alias("first"),
        F.max("invoice_date").alias("last"),
    )
    return orders.agg(
        F.sum("lines").alias("total_records"),
        F.count_distinct("customer_id").alias("unique_customers"),
        F.count_distinct("invoice").alias("unique_invoices"),
        F.min("first").alias("min_date"),
        F.max("last").alias("max_date"),
        F.sum("returns").alias("return_transactions"),
        F.sum(F.col("cents").cast("decimal(38,0)")).alias("cents"),
    ).select(
        "total_records", "unique_customers", "unique_invoices", "min_date", "max_date", "return_transactions",
        (F.col("return_transactions") / F.col("total_records")).alias("return_rate"),
        (F.col("cents").cast("double") / 100.0).alias("total_revenue"),
    )


def validate_cleaned(df: DataFrame, **options) -> DataFrame:
    """The summary; raises on a missing column or a broken rule of severity error."""
    missing = [c for c in CLEANED_COLUMNS if c not in df.columns]
    if missing:
        raise DataValidationError(f"cleaned data lack columns: {missing}")
    broken = validation_rules(df, **options).filter("severity = 'error' AND NOT passed").collect()
    if broken:
        raise DataValidationError("; ".join(f"{r.rule}: {r.violations} rows" for r in broken))
    return validation_summary(df)
