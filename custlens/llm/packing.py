"""Best-fit packing of token sequences.

Documents are cut into pieces of at most ``capacity`` tokens, and the pieces are packed by best-fit decreasing: longest
first, each into the open sequence with the least room that still holds it. A segment tree over the remaining capacities
finds that room in logarithmic time.

What decides a packing is only how many pieces there are of each length, at most ``capacity`` numbers however large the
corpus. So the driver packs the histogram: sequences with the same room are one class, and pieces of one length fill a
class in one step, with the same outcome as one after another. The plan that results says, for a range of ranks among
the pieces of a length, which sequences they go to. The ranks come from counts by task and length, so no task sees all
pieces of a length, and the pieces themselves are placed where they are.

Defined results: a missing or empty text is the end token alone; every row is packed, so repeated rows and repeated or
missing ids are pieces of their own; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from custlens.functions.stages import written
from custlens.llm.common import arrow_bytes, slices
from custlens.llm.tokens import encoder, word_tokenizer

CAPACITY = 4096
END = 1
#: Text that is encoded at a time, and about the most that is handed to a worker at a time.
SLICE_BYTES, BATCH_BYTES = 1 << 20, 4 << 20


PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, part int, nth bigint"


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """The pieces of all documents with their task and their number among the task's pieces of that length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, dtype=np.int64)
        for whole in batches:
            for batch in slices(whole, "text", SLICE_BYTES):
                ids, offsets = encoder(tokenizer).ids(batch.column("text"), END)
                raw, places = memoryview(ids.tobytes()), offsets.tolist()
                rows: list[tuple] = []
                for doc, first, last in zip(batch.column("doc_id").to_pylist(), places, places[1:]):
                    for k, at in enumerate(range(first, last, capacity)):
                        n = min(capacity, last - at)
                        rows.append((doc, k, at - first, n, zlib.crc32(raw[4 * at:4 * (at + n)]), part, int(seen[n])))
                        seen[n] += 1
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(zip(*rows), kinds)],
                    names=["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"])

    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return texts.mapInArrow(run, PIECES)


# ---- the plan ----


class CapacityTree:
    """A segment tree over remaining capacities: which have open sequences, and the least one that is large enough."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.any = [False] * (2 * self.leaves)

    def mark(self, room: int, open_: bool) -> None:
        k = room + self.leaves
        self.any[k] = open_
        while k > 1:
            k //= 2
            self.any[k] = self.any[2 * k] or self.any[2 * k + 1]

    def tightest(self, need: int) -> int | None:
        k = need + self.leaves
        if self.any[k]:
            return need
        while k > 1:  # up to the first subtree to the right that has one, then down its left side
            if k % 2 == 0 and self.any[k + 1]:
                k += 1
                while k < self.leaves:
                    k = 2 * k if self.any[2 * k] else 2 * k + 1
                return k - self.leaves
            k //= 2
        return None


#: length, first rank, pieces, pieces per sequence, first sequence, place in the sequence
Step = tuple[int, int, int, int, int, int]


def best_fit_plan(histogram: dict[int, int], capacity: int = CAPACITY) -> tuple[list[Step], int]:
    """Best-fit decreasing over a histogram of lengths: the steps by length and rank, and the number of sequences."""
    tree = CapacityTree(capacity)
    rooms: dict[int, list[tuple[int, int]]] = {}  # remaining capacity: ranges of sequences (first, how many)
    opened, steps = 0, []

    def put(room: int, first: int, count: int) -> None:
        if room > 0 and count > 0:
            if not rooms.setdefault(room, []):
                tree.mark(room, True)
            rooms[room].append((first, count))

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            room = tree.tightest(length)
            if room is None:
                room = capacity
                per = room // length
                first, bins = opened, -(-left // per)
                opened += bins
            else:
                first, bins = rooms[room].pop()
                if not rooms[room]:
                    tree.mark(room, False)
                per = room // length
            count = min(left, bins * per)
            steps.append((length, rank, count, per, first, capacity - room))
            full, rest = divmod(count, per)
            put(room - per * length, first, full)
            if rest:
                put(room - rest * length, first + full, 1)
            put(room, first + full + bool(rest), bins - full - bool(rest))
            left, rank = left - count, rank + count
    return steps, opened


def packed(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    with arrow_bytes(docs.sparkSession, BATCH_BYTES):
        found = written(pieces(docs, tokenizer or word_tokenizer(), capacity), "pieces")
    counts = found.groupBy("part", "length").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = written(counts.withColumn("first", F.coalesce(F.sum("n").over(earlier), F.lit(0))), "piece_ranks")
    histogram = {r["length"]: r["n"] for r in firsts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    steps, _ = best_fit_plan(histogram, capacity)
    plan = np.array(sorted(steps), dtype=np.int64).reshape(-1, 6)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shift = np.int64(1) << 48
        keys = plan[:, 0] * shift + plan[:, 1]
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            _, first_rank, _, per, first, used = plan[np.searchsorted(keys, length * shift + rank, side="right") - 1].T
            nth = rank - first_rank
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(first + nth // per, pa.int64()), pa.array(used + nth % per * length, pa.int64())],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    # the ranks grow with tasks times lengths, so they are shuffled and not broadcast
    ranked = found.join(firsts.select("part", "length", "first").hint("merge"), ["part", "length"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("first") + F.col("nth")).alias("rank"))
    return ranked.mapInArrow(
        place, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint")
