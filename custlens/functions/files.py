"""Small text files and listings in any store that Spark reaches, from the driver."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _path(spark: SparkSession, path: str):
    jvm_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path, jvm_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    jvm_path, fs = _path(spark, path)
    return fs.exists(jvm_path)


def write_new(spark: SparkSession, path: str, text: str) -> None:
    """Writes a file that must not be there yet; it appears when it is whole."""
    jvm_path, fs = _path(spark, path)
    if fs.exists(jvm_path):
        raise FileExistsError(path)
    draft, _ = _path(spark, f"{path}.draft")
    out = fs.create(draft, True)
    out.write(bytearray(text.encode()))
    out.close()
    if not fs.rename(draft, jvm_path):
        raise FileExistsError(path)


def read_text(spark: SparkSession, path: str) -> str:
    jvm_path, fs = _path(spark, path)
    source = fs.open(jvm_path)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8")
    finally:
        source.close()


def names(spark: SparkSession, folder: str) -> list[str]:
    """Names of the files and folders in a folder, in order; none if it isn't there."""
    jvm_path, fs = _path(spark, folder)
    if not fs.exists(jvm_path):
        return []
    return sorted(f.getPath().getName() for f in fs.listStatus(jvm_path))
