"""Scoring input files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from custlens.functions.stages import written
from custlens.sources.headers import read_by_header
from custlens.sources.invoices import DataValidationError

CORRUPT = "_corrupt"


def number_or_null(name: str) -> Column:
    """A double column in which "not a number" is missing."""
    return F.when(~F.isnan(F.col(f"`{name}`")), F.col(f"`{name}`")).alias(name)


def read_records(spark: SparkSession, paths: Sequence[str], schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """Rows that parse, and the texts of those that do not.

    Columns are matched by the header of each file; columns that a file lacks come back null, others are left out.
    """
    known = {f.name: f.dataType for f in schema.fields}
    rows = read_by_header(spark, paths, lambda name: known.get(name, T.StringType()), CORRUPT)
    if rows is None:
        raise DataValidationError("scoring input has no rows")
    # Spark parses only the columns a query asks for; written whole, every bad cell is seen.
    rows = written(rows, "upload")

    def given(f: T.StructField) -> Column:
        if f.name not in rows.columns:
            return F.lit(None).cast(f.dataType).alias(f.name)
        return number_or_null(f.name) if f.dataType == T.DoubleType() else F.col(f"`{f.name}`")

    good = rows.filter(F.col(CORRUPT).isNull()).select(*[given(f) for f in schema.fields])
    return good, rows.filter(F.col(CORRUPT).isNotNull()).select(CORRUPT)


def read_scoring_csv(spark: SparkSession, path: str, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """A CSV file or a folder of CSV files, whose headers may differ."""
    if not path.rstrip("/").endswith((".csv", ".txt")) and not _is_folder(spark, path):
        raise DataValidationError("scoring input must be a CSV file or a folder of CSV files")
    good, bad = read_records(spark, [path], schema)
    if good.isEmpty() and bad.isEmpty():
        raise DataValidationError("scoring input has no rows")
    return good, bad


def _is_folder(spark: SparkSession, path: str) -> bool:
    jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(jpath) and fs.getFileStatus(jpath).isDirectory()
