"""Deduplication of repeated byte strings with run-length indexes.

Every byte under a string of ``window`` bytes (100 if not told otherwise) that also starts earlier, in a document before
or further up, is removed; the first occurrence stays. Strings are judged on the input and never cross documents.

1. A sieve. Each window has an anchor: the smallest hash among its short runs of bytes. Equal windows have equal anchors
   at the same distance, so only windows whose anchor occurs twice go on, as segments: the bytes under the successive
   windows that share an anchor. A passage of any length is a chain of segments.
2. Equal segments in a task are one; all but its first occurrence are known to be repeats.
3. Segments meet by anchor, in as many buckets as there are shuffle partitions. Of each anchor, the earliest segment
   goes into the bucket's run-length index, and the others stream their matching statistics against it: a match of
   window length is a repeat, as the indexed segment is the earlier one. What only later segments share is settled by
   their suffix ranks at window depth.

Equal texts are one text; of its documents all but the first are repeats as a whole. The texts move once, and meet the
spans to remove.

Defined results: a missing text counts as empty; texts shorter than a window lose nothing; a missing id comes before all
others; rows with the same id and the same text are one document, so each of them gets its result; of different texts
with the same id, the one whose digest is smaller comes first; an empty table gives an empty result; other columns are
not read. Segments are told apart by their length and 128 bits of hash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from custlens.llm.common import shuffle_partitions, slices
from custlens.llm.gather import BLOBS, blob_batches, blobs, by_text
from custlens.llm.hashing import INVERSE, byte_run_hashes, byte_sums, mix, powers, text_bytes, window_minima
from custlens.llm.run_index import BREAK, RunLengthIndex, doubled_ranks
from custlens.llm.substring_dedup import ANCHOR_ROWS, anchor_batch, repeated

WINDOW = 100
ANCHOR = 24
SLICE = 1 << 20
#: Bytes of text that a task holds at a time before equal segments become one, and of segments in one index.
HELD = 16 << 20
INDEXED = 2 << 20

#: A text in a block of segments: its key, its document, its digest as two numbers that order like it.
_ENTRY = np.dtype([("text_id", "<i8"), ("doc", "<i8"), ("high", "<u8"), ("low", "<u8")])


def _order(entries: np.ndarray) -> np.ndarray:
    """The rank of each entry among them: by document, then by digest; equal entries share a rank."""
    order = np.lexsort((entries["low"], entries["high"], entries["doc"]))
    own = entries[order]
    new = np.ones(len(own), dtype=np.int64)
    if len(own):
        new[1:] = (own["doc"][1:] != own["doc"][:-1]) | (own["high"][1:] != own["high"][:-1]) | (own["low"][1:] != own["low"][:-1])
    rank = np.empty(len(own), dtype=np.int64)
    rank[order] = np.cumsum(new)
    return rank


def _anchored(batch: pa.RecordBatch, window: int):
    """The bytes of a batch, where its texts begin, and for each window inside one text its start and its anchor's place."""
    data, offsets = text_bytes(batch.column("text"))
    count = len(data) - window + 1
    if count <= 0:
        none = np.zeros(0, np.int64)
        return data, offsets, none, none, np.zeros(0, np.uint64)
    runs = byte_run_hashes(data, ANCHOR)
    places = window_minima(runs, window - ANCHOR + 1)
    crosses = np.zeros(count + 1, dtype=np.int64)  # windows that begin less than a window before a text's end
    cuts = offsets[1:-1]
    np.add.at(crosses, np.clip(cuts - window + 1, 0, count), 1)
    np.subtract.at(crosses, np.clip(cuts, 0, count), 1)
    start = np.flatnonzero(np.cumsum(crosses[:-1]) == 0)
    return data, offsets, start, places[start], runs


def anchors(texts: DataFrame, window: int) -> DataFrame:
    """The anchors of all texts; a task gives a text once, up to a bounded memory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for whole in batches:
            for batch in slices(whole, "text", SLICE):
                fresh = []
                for d in batch.column("digest").to_pylist():
                    fresh.append(d not in seen)
                    seen.add(d)
                if len(seen) > 300_000:
                    seen.clear()
                batch = batch.filter(pa.array(fresh))
                _, offsets, _, places, runs = _anchored(batch, window)
                new = np.ones(len(places), dtype=bool)
                new[1:] = places[1:] != places[:-1]
                places = places[new]
                doc = np.searchsorted(offsets, places, side="right") - 1
                yield anchor_batch(runs[places], batch.column("text_id").to_numpy()[doc], places - offsets[doc])

    return texts.select("text", "digest", "text_id").mapInArrow(run, ANCHOR_ROWS)


def _spans(text: np.ndarray, start: np.ndarray, count: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """For each text its runs of window starts as pairs (first, how many)."""
    order = np.lexsort((start, text))
    text, pairs = text[order], np.stack([start[order], count[order]], axis=1).astype("<i4")
    cuts = np.flatnonzero(text[1:] != text[:-1]) + 1
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(text)]):
        if b > a:
            yield int(text[a]), pairs[a:b].tobytes()


def _content_hash(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    total = byte_sums(data)
    return mix((total[start + length] - total[start]) * powers(len(data) + 1, INVERSE)[start])


def _first_of_equal(anchor, content, length, rank, place) -> tuple[np.ndarray, np.ndarray]:
    """An order in which equal segments follow each other, the earliest first, and which rows of it begin a new one."""
    order = np.lexsort((place, rank, length, content, anchor))
    a, c, n = anchor[order], content[order], length[order]
    new = np.ones(len(order), dtype=bool)
    new[1:] = (a[1:] != a[:-1]) | (c[1:] != c[:-1]) | (n[1:] != n[:-1])
    return order, new


SEGMENTS = "bucket int, anchor binary, length binary, content binary, entry binary, place binary"


def segments(texts: DataFrame, window: int, buckets: int) -> DataFrame:
    """Blocks of distinct segments by bucket of their anchor, and, with ``anchor`` null, spans known to repeat.

    Rows: doc_id, text, digest, text_id and places, the anchors of the text that occur twice, equal texts in succession.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # bytes, anchor, start in the bytes, length, entry, place in the text, hash of the content
        entries: list[tuple] = []
        size, last = 0, b""

        def flush() -> Iterator[pa.RecordBatch]:
            base = np.cumsum([0, *(len(h[0]) for h in held)])
            data = np.concatenate([h[0] for h in held])
            anchor, length, entry, place, content_hash = (np.concatenate([h[k] for h in held]) for k in (1, 3, 4, 5, 6))
            start = np.concatenate([h[2] + b for h, b in zip(held, base)])
            table = np.array(entries, dtype=_ENTRY)
            rows: list[tuple] = []
            order, new = _first_of_equal(anchor, content_hash, length, _order(table)[entry], place)
            later = order[~new]
            known = ((table[t:t + 1].tobytes(), _merged(spans)) for t, spans in _spans(
                entry[later], place[later], length[later] - window + 1))
            rows += [(b, None, sizes, None, own, spans) for b, own, sizes, spans in blobs(known, buckets)]
            keep = order[new]
            bucket = (anchor[keep] >> np.uint64(20)) % np.uint64(buckets)
            keep = keep[np.argsort(bucket, kind="stable")]
            bucket = np.sort(bucket)
            cuts = np.flatnonzero(np.diff(bucket)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(keep)]):
                if b > a:
                    at = keep[a:b]
                    own, index = np.unique(entry[at], return_inverse=True)
                    content = b"".join([data[s:s + n].tobytes() for s, n in zip(start[at].tolist(), length[at].tolist())])
                    rows.append((int(bucket[a]), anchor[at].tobytes(), length[at].astype("<i4").tobytes(), content,
                                 table[own].tobytes(), index.astype("<i4").tobytes() + place[at].astype("<i4").tobytes()))
            held.clear()
            entries.clear()
            for a in range(0, len(rows), 32):
                some = list(zip(*rows[a:a + 32]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(some[0], pa.int32()), *(pa.array(c, pa.binary()) for c in some[1:])],
                    names=["bucket", "anchor", "length", "content", "entry", "place"])

        for whole in batches:
            for batch in slices(whole, "text", SLICE):
                digests = batch.column("digest").to_pylist()
                fresh = [d != before for d, before in zip(digests, [last, *digests])]
                last = digests[-1]
                batch = batch.filter(pa.array(fresh))
                if not batch.num_rows:
                    continue
                data, offsets, start, places, runs = _anchored(batch, window)
                twice = np.zeros(len(data) + 1, dtype=bool)
                listed = batch.column("places")
                marks = listed.flatten().to_numpy() + np.repeat(offsets[:-1], listed.value_lengths().to_numpy())
                twice[marks[marks < len(twice)]] = True
                chosen = twice[places]
                start, places = start[chosen], places[chosen]
                if not len(start):
                    continue
                # successive windows with the same anchor are one segment
                begins = np.ones(len(start), dtype=bool)
                begins[1:] = (places[1:] != places[:-1]) | (start[1:] != start[:-1] + 1)
                first = np.flatnonzero(begins)
                length = np.diff(np.append(first, len(start))) + window - 1
                begin = start[first]
                doc = np.searchsorted(offsets, begin, side="right") - 1
                held.append((data, runs[places[first]], begin, length, doc + len(entries), begin - offsets[doc],
                             _content_hash(data, begin, length)))
                for i, d, doc_id in zip(*(batch.column(c).to_pylist() for c in ("text_id", "digest", "doc"))):
                    entries.append((i, doc_id, int.from_bytes(d[:8], "big"), int.from_bytes(d[8:], "big")))
                size += len(data)
                if size > HELD:
                    yield from flush()
                    size = 0
        if held:
            yield from flush()

    return texts.mapInArrow(run, SEGMENTS)


def later_windows(
    anchor: np.ndarray, rank: np.ndarray, place: np.ndarray, data: np.ndarray, start: np.ndarray, length: np.ndarray, window: int,
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Windows of distinct segments that occur in an earlier one of the same anchor: (segment, place of the window in it).

    Anchors are independent of each other, so they are worked off in parts whose segments fit one index.
    """
    order = np.lexsort((place, rank, anchor))
    own = anchor[order]
    begins = np.ones(len(own), dtype=bool)
    begins[1:] = own[1:] != own[:-1]
    group = np.cumsum(begins) - 1
    several = np.bincount(group)[group] > 1
    order, begins, group = order[several], begins[several], group[several]
    if not len(order):
        return
    # parts end where an anchor ends
    part = np.cumsum(length[order]) // INDEXED
    part = part[np.maximum.accumulate(np.where(begins, np.arange(len(order)), 0))]
    cuts = np.flatnonzero(np.diff(part)) + 1
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(order)]):
        at, is_first = order[a:b], begins[a:b]
        pieces = [data[s:s + n] for s, n in zip(start[at[is_first]].tolist(), length[at[is_first]].tolist())]
        stop = np.full(1, BREAK, dtype=np.uint8)
        index = RunLengthIndex(np.concatenate([x for p in pieces for x in (p, stop)]), window)
        lanes = at[~is_first]  # by anchor, earliest first
        by_length = np.argsort(-length[lanes], kind="stable")
        streamed = lanes[by_length]
        match = index.match_lengths(data, start[streamed], length[streamed])
        matched, open_ = [], []  # (lane, place of the window): found in the index, or not
        for step, have in enumerate(match, 1):
            if step >= window:
                hit = have >= window
                lane, at_place = by_length[:len(have)], length[streamed[:len(have)]] - step
                matched.append((lane[hit], at_place[hit]))
                open_.append((lane[~hit], at_place[~hit]))
        lane, at_place = (np.concatenate([m[k] for m in matched]) for k in range(2))
        yield lanes[lane], at_place
        lane, at_place = (np.concatenate([m[k] for m in open_]) for k in range(2))
        if len(lane):
            yield from _shared_later(lanes, lane, at_place, data, start, length, window)


def _shared_later(lanes, lane, at_place, data, start, length, window) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Among windows that the index doesn't have, those that an earlier lane has too."""
    some = np.unique(lane)
    new_start = np.zeros(len(lanes), dtype=np.int64)
    sizes = length[lanes[some]]
    new_start[some] = np.cumsum(sizes) - sizes
    text = np.concatenate([data[s:s + n] for s, n in zip(start[lanes[some]].tolist(), sizes.tolist())])
    depth = 8
    while depth * 2 <= window:
        depth *= 2
    rank = doubled_ranks(text, depth)
    at = new_start[lane] + at_place
    # a window is covered by two overlapping strings of that depth
    high, low = rank[at], rank[at + window - depth]
    order = np.lexsort((lane, low, high))
    high, low = high[order], low[order]
    repeat = np.zeros(len(order), dtype=bool)
    repeat[1:] = (high[1:] == high[:-1]) & (low[1:] == low[:-1])
    found = order[repeat]
    yield lanes[lane[found]], at_place[found]


def repeats(blocks: DataFrame, window: int, buckets: int) -> DataFrame:
    """Runs of windows that start earlier too, by bucket of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, entries, n_entries = [], [], 0
        for batch in batches:
            known = []
            for b, a, n, c, e, p in zip(*(batch.column(x).to_pylist() for x in (
                    "bucket", "anchor", "length", "content", "entry", "place"))):
                if a is None:
                    known.append((b, e, n, p))
                    continue
                both = np.frombuffer(p, "<i4").reshape(2, -1).astype(np.int64)
                size, content = np.frombuffer(n, "<i4").astype(np.int64), np.frombuffer(c, np.uint8)
                held.append((np.frombuffer(a, np.uint64), size, content, both[0] + n_entries, both[1],
                             _content_hash(content, np.cumsum(size) - size, size)))
                entries.append(np.frombuffer(e, dtype=_ENTRY))
                n_entries += len(entries[-1])
            yield from blob_batches(known)
        if not held:
            return
        anchor, length, data, entry, place, content_hash = (np.concatenate([h[k] for h in held]) for k in range(6))
        held.clear()
        table = np.concatenate(entries)
        rank, start = _order(table), np.cumsum(length) - length
        order, new = _first_of_equal(anchor, content_hash, length, rank[entry], place)
        later, keep = order[~new], order[new]
        out_entry, out_start, out_count = [entry[later]], [place[later]], [length[later] - window + 1]
        for segment, at in later_windows(
                anchor[keep], rank[entry[keep]], place[keep], data, start[keep], length[keep], window):
            segment = keep[segment]
            out_entry.append(entry[segment])
            out_start.append(place[segment] + at)
            out_count.append(np.ones(len(at), dtype=np.int64))
        found = ((table[t:t + 1].tobytes(), _merged(spans)) for t, spans in _spans(
            np.concatenate(out_entry), np.concatenate(out_start), np.concatenate(out_count)))
        yield from blob_batches(blobs(found, buckets))

    return blocks.repartition("bucket").mapInArrow(run, BLOBS)


def _merged(spans: bytes) -> bytes:
    """Runs of window starts in order, with those that touch as one."""
    pairs = np.frombuffer(spans, "<i4").reshape(-1, 2).astype(np.int64)
    first, end = pairs[:, 0], np.maximum.accumulate(pairs.sum(axis=1))
    new = np.ones(len(first), dtype=bool)
    new[1:] = first[1:] > end[:-1]
    at = np.flatnonzero(new)
    last = np.append(at[1:], len(first)) - 1
    return np.stack([first[at], end[last] - first[at]], axis=1).astype("<i4").tobytes()


def _judged(docs: DataFrame, window: int, finish, name: str) -> DataFrame:
    buckets = shuffle_partitions(docs.sparkSession)
    digest = F.unhex(F.md5("text"))
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).select(
        "doc_id", "text", digest.alias("digest"), F.xxhash64(digest).alias("text_id"),
        F.coalesce("doc_id", F.lit(-(1 << 63)).cast("bigint")).alias("doc"))
    # the same rows are dealt by text for both joins, so the texts move once
    columns = ["doc_id", "text", "digest", "text_id", "doc"]
    twice = repeated(anchors(texts, window)).groupBy("text_id").agg(
        F.collect_list("place").alias("places"))
    with_anchors = texts.join(twice, "text_id").select(*columns, "places").sortWithinPartitions("text_id", "digest", "doc")
    found = by_text(repeats(segments(with_anchors, window, buckets), window, buckets), _ENTRY.itemsize)
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    found = found.select("text_id", "entry", F.col("places").alias("spans"), none("bigint", "doc"), none("binary", "digest"))
    copies = texts.groupBy("text_id", "digest").agg(F.min("doc").alias("doc"), F.max("doc").alias("last")).where(
        "doc <> last").select("text_id", none("binary", "entry"), none("binary", "spans"), "doc", "digest")
    gathered = found.union(copies).groupBy("text_id").agg(
        F.collect_list(F.struct("doc", "digest", "entry", "spans")).alias("found"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", SLICE):
                out = []
                for doc_id, text, own, text_id, doc, lists in zip(*(batch.column(c).to_pylist() for c in (
                        "doc_id", "text", "digest", "text_id", "doc", "found"))):
                    raw = text.encode()
                    removed = np.zeros((0, 2), dtype=np.int64)
                    if len(raw) >= window and lists:
                        mine = np.array(
                            [(text_id, doc, int.from_bytes(own[:8], "big"), int.from_bytes(own[8:], "big"))], dtype=_ENTRY).tobytes()
                        if any(f["digest"] == own and f["doc"] != doc for f in lists):  # a copy of an earlier document
                            removed = np.array([[0, len(raw)]])
                        elif spans := b"".join(f["spans"] for f in lists if f["entry"] == mine):
                            runs = np.frombuffer(spans, "<i4").reshape(-1, 2).astype(np.int64)
                            runs = runs[np.argsort(runs[:, 0], kind="stable")]
                            first, end = runs[:, 0], np.maximum.accumulate(runs.sum(axis=1) + window - 1)
                            new = np.ones(len(first), dtype=bool)
                            new[1:] = first[1:] > end[:-1]
                            at = np.flatnonzero(new)
                            removed = np.stack([first[at], end[np.append(at[1:], len(first)) - 1]], axis=1)
                    parts, at = [], 0
                    for a, b in removed.tolist():
                        parts.append(raw[at:a])
                        at = b
                    rest = b"".join([*parts, raw[at:]])
                    out.append((doc_id, len(raw), len(raw) - len(rest), len(removed), finish(rest)))
                kinds = (pa.int64(),) * 4 + (pa.binary() if name == "kept" else pa.string(),)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=["doc_id", "n_bytes", "n_removed", "n_spans", name])

    joined = texts.join(gathered, "text_id", "left").select(*columns, "found")
    kind = "binary" if name == "kept" else "string"
    return joined.mapInArrow(run, f"doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, {name} {kind}")


def deduplicated(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, and the remaining bytes as ``kept``."""
    return _judged(docs, window, bytes, "kept")


def report(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """The same with the SHA-256 of the remaining bytes instead of them."""
    return _judged(docs, window, lambda rest: hashlib.sha256(rest).hexdigest(), "kept_sha256")
