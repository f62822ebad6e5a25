"""The four serving tables in plain Parquet folders, kept up to date by batches of scored records.

No format with row updates is needed. A batch is a folder of scored rows and, written after it, a commit: a small file named by
the batch. The tables are a snapshot and the committed batches behind it; what a batch does to them (customers added, segments
set, predictions and anomalies appended) is worked out when they are read, by merging each customer's newest row. ``compact``
writes that as a new snapshot and then a pointer to it, so readers see the old or the new one and never a half.

A batch whose commit is there is not run again, so a stream that repeats its last batch after a failure changes nothing; a
batch that failed before its commit left a folder that the next attempt replaces.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from custlens.functions import files
from custlens.operators import serving

TABLES = ("customers", "customer_segments", "predictions", "anomaly_reports")


def _name(batch_id: int) -> str:
    return f"{batch_id:012d}"


class ServingStore:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    # ---- what is there ----

    def pointer(self) -> dict:
        """The newest snapshot, and the last batch in it."""
        names = files.names(self.spark, f"{self.folder}/pointers")
        whole = [n for n in names if n.endswith(".json")]
        if not whole:
            raise FileNotFoundError(f"no snapshot in {self.folder}")
        return json.loads(files.read_text(self.spark, f"{self.folder}/pointers/{whole[-1]}"))

    def committed(self, batch_id: int) -> bool:
        return files.exists(self.spark, f"{self.folder}/commits/{_name(batch_id)}")

    def pending(self) -> list[str]:
        """Folders of the committed batches behind the snapshot, in their order."""
        through = self.pointer()["through"]
        found = [n for n in files.names(self.spark, f"{self.folder}/commits") if n.isdigit() and int(n) > through]
        return [json.loads(files.read_text(self.spark, f"{self.folder}/commits/{n}"))["path"] for n in found]

    def snapshot(self) -> dict[str, DataFrame]:
        base = self.pointer()
        return {t: self.spark.read.parquet(f"{base['snapshot']}/{t}") for t in TABLES}

    def tables(self) -> dict[str, DataFrame]:
        """The tables as of the last committed batch."""
        base, paths = self.snapshot(), self.pending()
        if not paths:
            return base
        scored = self.spark.read.parquet(*paths)
        limit = F.lit(self.pointer()["p99"])
        return {
            "customers": serving.upsert_customers(base["customers"], scored),
            "customer_segments": serving.upsert_segments(base["customer_segments"], scored),
            "predictions": serving.append_predictions(base["predictions"], scored),
            "anomaly_reports": serving.append_anomalies(base["anomaly_reports"], scored, limit),
        }

    # ---- changes ----

    def _point(self, tables: dict[str, DataFrame], through: int, p99: float, seq: int) -> None:
        place = f"{self.folder}/snapshots/{_name(through + 1)}-{uuid.uuid4().hex}"
        for name in TABLES:
            tables[name].write.parquet(f"{place}/{name}")
        files.write_new(self.spark, f"{self.folder}/pointers/{seq:08d}.json", json.dumps(
            {"snapshot": place, "through": through, "p99": p99, "seq": seq}))

    def create(self, tables: dict[str, DataFrame], p99: float) -> None:
        """The first snapshot, from a full load; ``p99`` is the error above which an account is flagged in 99 %."""
        self._point(tables, -1, p99, 0)

    def commit(self, batch_id: int, path: str) -> bool:
        """Makes a written folder of scored rows count as the batch; false if the batch is there already."""
        if self.committed(batch_id):
            return False
        if batch_id <= self.pointer()["through"]:
            raise ValueError(f"batch {batch_id} comes behind a snapshot that should hold it")
        files.write_new(self.spark, f"{self.folder}/commits/{_name(batch_id)}", json.dumps({"path": path}))
        return True

    def apply(self, batch_id: int, scored: DataFrame) -> bool:
        """Adds a batch of scored rows; false, and nothing done, if it is there already."""
        if self.committed(batch_id):
            return False
        path = f"{self.folder}/deltas/{_name(batch_id)}"
        scored.write.mode("overwrite").parquet(path)
        return self.commit(batch_id, path)

    def compact(self) -> None:
        """Merges the committed batches into a new snapshot. One writer at a time; readers go on with the old one."""
        names = [n for n in files.names(self.spark, f"{self.folder}/commits") if n.isdigit()]
        old = self.pointer()
        if names and int(names[-1]) > old["through"]:
            self._point(self.tables(), int(names[-1]), old["p99"], old["seq"] + 1)

