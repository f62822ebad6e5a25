"""CSV files whose columns are found by the names in each file's own header."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

#: Different headers of one input at most; more is an input error, not data.
MOST_LAYOUTS = 200


def layouts(spark: SparkSession, paths: Sequence[str]) -> list[tuple[str, list[str]]]:
    """The headers of the files, each with its files.

    The first line of a file is the first row of its first split; one pass finds all of them.
    """
    lines = spark.read.text(list(paths)).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("nth"))
    heads = lines.where("start = 0").groupBy("file").agg(F.min_by("value", "nth").alias("header"))
    found = heads.groupBy("header").agg(F.sort_array(F.collect_list("file")).alias("files")).orderBy("header").limit(
        MOST_LAYOUTS + 1).collect()
    if len(found) > MOST_LAYOUTS:
        raise ValueError(f"more than {MOST_LAYOUTS} different headers")
    return [(r["header"], r["files"]) for r in found]


def read_by_header(
    spark: SparkSession, paths: Sequence[str], kind: Callable[[str], T.DataType], corrupt: str | None = None,
) -> DataFrame | None:
    """All files as one table; ``kind`` gives the type of a column by its name, ``corrupt`` names the column for bad rows.

    Columns that a file lacks are null. Null for no files.
    """
    whole = None
    for _, files in layouts(spark, paths):
        names = spark.read.option("header", True).csv(files[0]).columns
        fields = [T.StructField(n, kind(n)) for n in names]
        reader = spark.read.option("header", True).option("mode", "PERMISSIVE")
        if corrupt:
            fields.append(T.StructField(corrupt, T.StringType()))
            reader = reader.option("columnNameOfCorruptRecord", corrupt)
        part = reader.schema(T.StructType(fields)).csv(files)
        whole = part if whole is None else whole.unionByName(part, allowMissingColumns=True)
    return whole
