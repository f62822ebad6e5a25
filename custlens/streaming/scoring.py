"""Continuous scoring of a folder that receives CSV files."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from custlens.operators.scoring import SCORING_SCHEMA, score_batch
from custlens.sources.uploads import CORRUPT, read_records
from custlens.streaming.store import ServingStore


def utc_now() -> datetime:
    return datetime.now(timezone.utc).replace(tzinfo=None)


def write_scored_batch(
    records: DataFrame, unreadable: DataFrame, batch_id: int, folder: str, scorer: Callable[[DataFrame], DataFrame],
    version: str, scored_at: datetime,
) -> None:
    """Scores the records of one micro-batch into its own folder: every record is scored or rejected.

    A batch that is run again after a failure replaces its folder, so no record is counted twice.
    """
    scored, rejected = score_batch(records, scorer, version, scored_at)
    rejected = rejected.withColumn(CORRUPT, F.lit(None).cast("string")).unionByName(
        unreadable.select(CORRUPT).withColumn("reject_reasons", F.array(F.lit("unreadable cell"))), allowMissingColumns=True
    )
    scored.write.mode("overwrite").parquet(f"{folder}/predictions/batch_id={batch_id}")
    rejected.write.mode("overwrite").parquet(f"{folder}/rejected/batch_id={batch_id}")


def start_scoring(
    spark: SparkSession, source: str, folder: str, scorer: Callable[[DataFrame], DataFrame],
    version: str, files_per_batch: int = 100, once: bool = False, clock: Callable[[], datetime] = utc_now,
    store: ServingStore | None = None,
) -> StreamingQuery:
    """Reads new CSV files under ``source`` and writes results under ``folder``.

    The stream tells which files are new; each micro-batch reads its files by their own headers. Its records carry the
    time at which it was scored. With a ``store``, each batch also updates the serving tables, once, however often it runs.
    """
    lines = spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(source)
    files = lines.select(F.col("_metadata.file_path").alias("file"))

    def score(batch: DataFrame, batch_id: int) -> None:
        if store is not None and store.committed(batch_id):
            return
        paths = [r["file"] for r in batch.distinct().collect()]  # at most files_per_batch
        if paths:
            records, unreadable = read_records(batch.sparkSession, sorted(paths), SCORING_SCHEMA)
            write_scored_batch(records, unreadable, batch_id, folder, scorer, version, clock())
            if store is not None:
                store.commit(batch_id, f"{folder}/predictions/batch_id={batch_id}")

    writer = files.writeStream.option("checkpointLocation", f"{folder}/checkpoint").foreachBatch(score)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="1 minute")).start()


def read_scored(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.option("basePath", f"{folder}/predictions").parquet(f"{folder}/predictions")
