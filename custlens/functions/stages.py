"""Intermediate tables in the cluster's shared folder.

A stage is a Parquet table written once per application and input. Later jobs
read it column-pruned, and a lost executor costs a re-read instead of the
whole lineage.
"""

from __future__ import annotations

import atexit
import tempfile
import threading
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"
_tables: dict[tuple, str] = {}
_hooked: list = []
_lock = threading.Lock()
_local_folders: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; local sessions get their own if unset."""
    folder = spark.conf.get(CHECKPOINT_CONF, None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {CHECKPOINT_CONF} to a folder that all executors can reach")
    app = spark.sparkContext.applicationId
    if app not in _local_folders:
        _local_folders[app] = tempfile.mkdtemp(prefix="custlens-")
    return _local_folders[app]


def _application_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/custlens/{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, name: str) -> str:
    with _lock:
        if not _hooked:
            _hooked.append(atexit.register(_release_at_exit))
    return f"{_application_folder(spark)}/{uuid.uuid4().hex}/{name}"


def release(spark: SparkSession) -> None:
    """Deletes the stage tables of this application, for the end of a job whose results are written."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_application_folder(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    with _lock:
        for key in [k for k in _tables if k[0] == spark.sparkContext.applicationId]:
            del _tables[key]


def _release_at_exit() -> None:
    """At the end of the driver, if its session is still there."""
    spark = SparkSession.getActiveSession()
    if spark is not None:
        try:
            release(spark)
        except Exception:  # the session ends at the same time; what remains lies in the application's own folder
            pass


def written(df: DataFrame, name: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Writes ``df`` to a new stage table and returns the table."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.mode("errorifexists").partitionBy(*partition_by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def input_version(spark: SparkSession, folder: str) -> tuple:
    """Paths, lengths and change times of all files of a folder, those in folders inside it included."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listFiles(path, True)
    found = []
    while files.hasNext():
        f = files.next()
        found.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return tuple(sorted(found))


def stage(
    spark: SparkSession, folder: str, name: str, build: Callable[[], DataFrame],
    partition_by: tuple[str, ...] = (),
) -> DataFrame:
    """The stage ``name`` of an input folder, built at its first use in the application."""
    key = (spark.sparkContext.applicationId, folder, input_version(spark, folder), name)
    with _lock:
        path = _tables.get(key)
    if path is None:
        path = new_path(spark, name)
        build().write.partitionBy(*partition_by).parquet(path)
        with _lock:  # of two that were built at the same time, the first stays
            path = _tables.setdefault(key, path)
    return spark.read.parquet(path)
