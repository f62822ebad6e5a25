"""Reading raw invoice lines: schema check, column names, types, cache."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from custlens.functions.columns import strip
from custlens.sources.headers import layouts


class DataValidationError(Exception):
    """Input or cleaned data break a required rule."""


# Column names of the raw sheets and of the engine.
RAW_COLUMNS = {
    "Invoice": "invoice",
    "StockCode": "stock_code",
    "Description": "description",
    "Quantity": "quantity",
    "InvoiceDate": "invoice_date",
    "Price": "price",
    "Customer ID": "customer_id",
    "Country": "country",
}

RAW_TEXT_SCHEMA = T.StructType([T.StructField(name, T.StringType()) for name in RAW_COLUMNS])


def check_raw_schema(df: DataFrame, expected: Sequence[str] = tuple(RAW_COLUMNS)) -> bool:
    missing = [c for c in expected if c not in df.columns]
    if missing:
        raise DataValidationError(f"raw data lack columns: {missing}")
    return True


def rename_raw_columns(df: DataFrame) -> DataFrame:
    return df.withColumnsRenamed(RAW_COLUMNS)


def coerce_raw_types(df: DataFrame) -> DataFrame:
    """Trims texts and turns values that do not parse into nulls.

    A missing invoice or stock code stays null.
    """
    def number(name: str):
        value = F.col(name).try_cast("double")
        return F.when(~F.isnan(value), value)

    return df.select(
        strip(F.col("invoice").cast("string")).alias("invoice"),
        strip(F.col("stock_code").cast("string")).alias("stock_code"),
        strip(F.coalesce(F.col("description").cast("string"), F.lit(""))).alias("description"),
        number("quantity").alias("quantity"),
        F.col("invoice_date").try_cast("timestamp_ntz").alias("invoice_date"),
        number("price").alias("price"),
        number("customer_id").cast("bigint").alias("customer_id"),
        strip(F.coalesce(F.col("country").cast("string"), F.lit("Unspecified"))).alias("country"),
    )


def read_sheet(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """One sheet: a file or a folder of CSV (each file with its own header) or Parquet."""
    if fmt == "csv":
        parts = [spark.read.option("header", True).csv(files) for _, files in layouts(spark, [path])]
        if not parts:
            raise DataValidationError(f"no lines in {path}")
        for part in parts:
            check_raw_schema(part)
        return reduce(DataFrame.unionByName, [part.select(*RAW_COLUMNS) for part in parts])
    sheet = spark.read.format(fmt).load(path)
    check_raw_schema(sheet)
    return sheet.select(*RAW_COLUMNS)


def load_raw(
    spark: SparkSession,
    paths: Sequence[str],
    fmt: str = "parquet",
    cache_path: str | None = None,
    use_cache: bool = True,
) -> DataFrame:
    """All sheets as one table of typed raw lines, from the cache table if there is one."""
    if use_cache and cache_path:
        try:
            return spark.read.parquet(cache_path)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
    sheets = [read_sheet(spark, p, fmt) for p in paths]
    if not sheets:
        raise DataValidationError("no raw sheets given")
    combined = sheets[0]
    for sheet in sheets[1:]:
        combined = combined.unionByName(sheet)
    typed = coerce_raw_types(rename_raw_columns(combined))
    if use_cache and cache_path:
        typed.write.mode("overwrite").parquet(cache_path)
        return spark.read.parquet(cache_path)
    return typed
