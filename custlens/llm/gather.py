"""Places found by many tasks, brought together by text in few large rows."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

BLOBS = "bucket int, entry binary, size binary, place binary"


def blobs(found: Iterable[tuple[bytes, bytes]], buckets: int) -> list[tuple[int, bytes, bytes, bytes]]:
    """(entry, places) pairs as one row for each bucket of texts; an entry begins with its text's 64-bit key."""
    by_bucket: dict[int, list[tuple[bytes, bytes]]] = {}
    for entry, places in found:
        by_bucket.setdefault(int.from_bytes(entry[:8], "little") % buckets, []).append((entry, places))
    return [
        (bucket, b"".join(e for e, _ in own), np.array([len(p) for _, p in own], dtype="<i4").tobytes(), b"".join(p for _, p in own))
        for bucket, own in by_bucket.items()
    ]


def blob_batches(rows: list[tuple[int, bytes, bytes, bytes]], at_once: int = 64) -> Iterator[pa.RecordBatch]:
    for a in range(0, len(rows), at_once):
        some = list(zip(*rows[a:a + at_once]))
        yield pa.RecordBatch.from_arrays(
            [pa.array(some[0], pa.int32()), *(pa.array(c, pa.binary()) for c in some[1:])], names=["bucket", "entry", "size", "place"])


def by_text(rows: DataFrame, entry_size: int) -> DataFrame:
    """(text_id, entry, places): all places of an entry in one row. A task holds the places of its buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, list[bytes]] = {}
        for batch in batches:
            for entries, sizes, places in zip(*(batch.column(c).to_pylist() for c in ("entry", "size", "place"))):
                at = 0
                for k, n in enumerate(np.frombuffer(sizes, "<i4").tolist()):
                    held.setdefault(entries[k * entry_size:(k + 1) * entry_size], []).append(places[at:at + n])
                    at += n
        found = list(held.items())
        for a in range(0, len(found), 2000):
            some = found[a:a + 2000]
            yield pa.RecordBatch.from_arrays(
                [pa.array([int.from_bytes(e[:8], "little", signed=True) for e, _ in some], pa.int64()),
                 pa.array([e for e, _ in some], pa.binary()), pa.array([b"".join(p) for _, p in some], pa.binary())],
                names=["text_id", "entry", "places"])

    return rows.repartition("bucket").mapInArrow(run, "text_id bigint, entry binary, places binary")
