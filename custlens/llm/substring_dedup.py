"""Substring deduplication by prefix-partitioned suffix trees over words.

A window is a number of consecutive words (35 if not told otherwise). Every word under a window whose words also start
anywhere else, in the same text or another, is removed. Windows are judged on the input.

The suffixes of all texts are dealt into groups by their prefix of a whole window, each group's suffixes are ordered into a
subtree, and the leaves under its internal nodes of window depth are the places of repeats. Depth is counted in blocks of
words (a fifth of a window each) and a node's children are told apart by the hash of the next block. Prefixes are not of
variable length: only leaves that agree in a whole window matter, so a shorter prefix that many texts share, followed by
different words, need not meet in one task, and is spread over all of them. A task's share is not sized to memory; it is
that of all suffixes by the number of shuffle partitions.

Three things keep the amount small without losing a repeat:

- A sieve. Each window has an anchor: the smallest hash among its short runs of words. Equal windows have equal anchors,
  so only windows whose anchor occurs twice need a suffix. Anchors are a tenth of the words.
- Equal texts are one text. A text that occurs twice is a repeat as a whole; its suffixes are still there for others.
- Each task first builds the subtrees of its own suffixes. Places that repeat there are known, and one suffix for all
  of them goes on; a passage that a third of all documents share becomes one row per task.

Defined results: a missing text counts as empty; words are runs of characters other than ASCII white space; texts shorter
than a window lose nothing; rows with the same text get the same result whatever their ids, and repeated rows count as
two places; missing ids are kept; an empty table gives an empty result; other columns are not read. Hashes have 64 bits
for anchors, and 192 for windows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from custlens.llm.common import shuffle_partitions, slices
from custlens.llm.gather import BLOBS, blob_batches, blobs, by_text
from custlens.llm.hashing import mix, run_hashes, window_minima, words

WINDOW = 35
BLOCKS = 5
ANCHOR = 8
SLICE = 2 << 20
#: Suffixes that a task holds at a time before it builds their subtrees.
HELD = 1_000_000


def deep_leaves(codes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The leaves under nodes of full depth that have several, and for each of them its node.

    ``codes`` holds the hash of each suffix's first block, second block, and so on. A level at a time, suffixes are
    ordered below their node by the next block; nodes with a single leaf are dropped.
    """
    alive = np.arange(len(codes[0]))
    node = np.zeros(len(alive), dtype=np.int64)
    for code in codes:
        if not len(alive):
            break
        own = code[alive]
        order = np.argsort(own, kind="stable")
        if node.any():
            order = order[np.argsort(node[order], kind="stable")]
        own, at = own[order], node[order]
        begins = np.ones(len(own), dtype=bool)
        begins[1:] = (own[1:] != own[:-1]) | (at[1:] != at[:-1])
        child = np.cumsum(begins) - 1
        several = np.diff(np.append(np.flatnonzero(begins), len(own)))[child] > 1
        alive, node = alive[order][several], child[several]
    return alive, node


def _text_key() -> tuple:
    digest = F.unhex(F.md5("text"))
    return digest.alias("digest"), F.xxhash64(digest).alias("text_id")


def _windows(batch: pa.RecordBatch, window: int):
    """The words of a batch, and the first word of every window inside one text with its anchor's place."""
    found = words(batch.column("text"))
    count = len(found.hash) - window + 1
    if count <= 0:
        none = np.zeros(0, np.int64)
        return found, none, none, np.zeros(0, np.uint64)
    runs = run_hashes(found.hash, ANCHOR)
    places = window_minima(runs, window - ANCHOR + 1)[:count]
    inside = np.flatnonzero(found.doc[:count] == found.doc[window - 1:])
    return found, inside, places[inside], runs


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
                found, _, places, runs = _windows(batch, window)
                places = np.unique(places)
                doc = found.doc[places] if len(places) else places
                ids = batch.column("text_id").to_numpy()
                yield anchor_batch(runs[places], ids[doc], places - found.first[doc])

    return texts.select("text", "digest", "text_id").mapInArrow(run, ANCHOR_ROWS)


ANCHOR_ROWS = "anchor bigint, known boolean, text_id bigint, place int"


def anchor_batch(anchor: np.ndarray, text_id: np.ndarray, place: np.ndarray) -> pa.RecordBatch:
    """The anchors of a few texts, so that the rows of an anchor don't grow with the texts that have it.

    Those that occur twice here are ``known``; such a row needs no partner, and is dealt by its place. One row of each
    anchor looks for partners elsewhere.
    """
    order = np.argsort(anchor, kind="stable")
    own = anchor[order]
    begins = np.ones(len(own), dtype=bool)
    begins[1:] = own[1:] != own[:-1]
    ends = np.append(begins[1:], True)
    looks, known = order[begins], order[~(begins & ends)]
    spread = mix(text_id[known].astype(np.int64).view(np.uint64) ^ mix(place[known].astype(np.uint64)))
    at = np.concatenate([looks, known])
    return pa.RecordBatch.from_arrays(
        [pa.array(np.concatenate([anchor[looks], spread]).view(np.int64)), pa.array(np.arange(len(at)) >= len(looks)),
         pa.array(text_id[at], pa.int64()), pa.array(place[at].astype(np.int32))], names=["anchor", "known", "text_id", "place"])


def repeated(rows: DataFrame) -> DataFrame:
    """(text_id, place) of known rows and of anchors with several distinct rows. Groups of any size stream through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = [np.zeros(0, k) for k in (np.int64, bool, np.int64, np.int32)]  # the last row so far
        open_ = False  # whether its anchor has had another row before
        for batch in batches:
            anchor, known, text, place = (
                np.concatenate([r, batch.column(c).to_numpy(zero_copy_only=False)])
                for r, c in zip(rest, ("anchor", "known", "text_id", "place")))
            if not len(anchor):
                continue
            new = np.ones(len(anchor), dtype=bool)
            new[1:] = (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1]) | (place[1:] != place[:-1])
            anchor, known, text, place = anchor[new], known[new], text[new], place[new]
            same = anchor[1:] == anchor[:-1]
            several = np.append(same, False)
            several[1:] |= same
            several[0] |= open_
            open_ = bool(several[-1])
            out = several | known
            out[-1] = False  # it may be the first of a group
            yield pa.RecordBatch.from_arrays([pa.array(text[out]), pa.array(place[out])], names=["text_id", "place"])
            rest = [v[-1:] for v in (anchor, known, text, place)]
        if len(rest[0]) and (open_ or rest[1][0]):
            yield pa.RecordBatch.from_arrays([pa.array(rest[2]), pa.array(rest[3])], names=["text_id", "place"])

    return rows.repartition("anchor").sortWithinPartitions("anchor", "text_id", "place").mapInArrow(
        run, "text_id bigint, place int")


SUFFIXES = "bucket int, first binary, rest binary, text binary, place binary"
_ENTRY = np.dtype([("text_id", "<i8"), ("digest", "V16")])


def _by_text(text: np.ndarray, place: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """For each text its places as 32-bit numbers."""
    order = np.lexsort((place, text))
    text, place = text[order], place[order].astype("<i4")
    cuts = np.flatnonzero(text[1:] != text[:-1]) + 1
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(text)]):
        if b > a:
            yield int(text[a]), place[a:b].tobytes()


def group_of(first: np.ndarray, rest: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of each suffix, from the hashes of all its blocks."""
    whole = mix(first)
    for k in range(rest.shape[1]):
        whole = mix(whole ^ rest[:, k].astype(np.uint64))
    return (whole >> np.uint64(20)) % np.uint64(buckets)


def suffixes(texts: DataFrame, window: int, buckets: int) -> DataFrame:
    """Blocks of suffixes by bucket of their group, and, with ``first`` null, places known to repeat by bucket of texts.

    Rows: text, digest, text_id and places, the anchors of the text that occur twice, ordered by text_id.
    """
    lengths = [window // BLOCKS] * (BLOCKS - 1)
    lengths.append(window - sum(lengths))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # first block's hash, the others', entry of the text, place
        entries: list[bytes] = []
        count, last = 0, b""

        def flush() -> Iterator[pa.RecordBatch]:
            first, rest, text, place = (np.concatenate([h[k] for h in held]) for k in range(4))
            entry = np.frombuffer(b"".join(entries), dtype=_ENTRY)
            rows: list[tuple] = []
            leaves, node = deep_leaves([first, *(rest[:, k] for k in range(BLOCKS - 1))])
            go_on = np.ones(len(first), dtype=bool)
            if len(leaves):
                known = ((entry[t:t + 1].tobytes(), places) for t, places in _by_text(text[leaves], place[leaves]))
                rows += [(b, None, sizes, own, places) for b, own, sizes, places in blobs(known, buckets)]
                begins = np.ones(len(node), dtype=bool)
                begins[1:] = node[1:] != node[:-1]
                go_on[leaves[~begins]] = False
            first, rest, text, place = first[go_on], rest[go_on], text[go_on], place[go_on]
            bucket = group_of(first, rest, buckets)
            order = np.argsort(bucket, kind="stable")
            cuts = np.flatnonzero(np.diff(bucket[order])) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(order)]):
                if b > a:
                    at = order[a:b]
                    own, index = np.unique(text[at], return_inverse=True)
                    rows.append((int(bucket[at[0]]), first[at].tobytes(), rest[at].tobytes(),
                                 entry[own].tobytes(), index.astype("<i4").tobytes() + place[at].astype("<i4").tobytes()))
            held.clear()
            entries.clear()
            for a in range(0, len(rows), 64):
                some = list(zip(*rows[a:a + 64]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(some[0], pa.int32()), *(pa.array(c, pa.binary()) for c in some[1:])],
                    names=["bucket", "first", "rest", "text", "place"])

        for whole in batches:
            for batch in slices(whole, "text", SLICE):
                digests = batch.column("digest").to_pylist()
                fresh = [d != before for d, before in zip(digests, [last, *digests])]
                last = digests[-1]
                batch = batch.filter(pa.array(fresh))
                if not batch.num_rows:
                    continue
                found, inside, places, _ = _windows(batch, window)
                twice = np.zeros(len(found.hash) + 1, dtype=bool)
                listed = batch.column("places")
                marks = listed.flatten().to_numpy() + np.repeat(found.first[:-1], listed.value_lengths().to_numpy())
                twice[marks[marks < len(twice)]] = True
                begin = inside[twice[places]]
                if not len(begin):
                    continue
                hashed = {n: run_hashes(found.hash, n) for n in set(lengths)}
                starts = np.cumsum([0, *lengths[:-1]])
                codes = [hashed[n][begin + s] for n, s in zip(lengths, starts.tolist())]
                rest = np.stack([c.astype(np.uint32) for c in codes[1:]], axis=1)
                doc = found.doc[begin]
                held.append((codes[0], rest, doc + len(entries), begin - found.first[doc]))
                ids = batch.column("text_id").to_pylist()
                entries.extend(np.array([(i, d)], dtype=_ENTRY).tobytes() for i, d in zip(ids, batch.column("digest").to_pylist()))
                count += len(begin)
                if count > HELD:
                    yield from flush()
                    count = 0
        if held:
            yield from flush()

    return texts.mapInArrow(run, SUFFIXES)


def repeats(blocks: DataFrame, buckets: int) -> DataFrame:
    """Where windows that repeat begin, by bucket of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, rest, text, place, entries = [], [], [], [], []
        for batch in batches:
            known = []
            for b, f, r, t, p in zip(*(batch.column(c).to_pylist() for c in ("bucket", "first", "rest", "text", "place"))):
                if f is None:
                    known.append((b, t, r, p))
                    continue
                first.append(np.frombuffer(f, np.uint64))
                rest.append(np.frombuffer(r, np.uint32).reshape(-1, BLOCKS - 1))
                both = np.frombuffer(p, "<i4").reshape(2, -1)
                text.append(both[0] + len(entries))
                place.append(both[1])
                entries.extend(t[a:a + 24] for a in range(0, len(t), 24))
            yield from blob_batches(known)
        if first:
            code, rest, text, place = np.concatenate(first), np.concatenate(rest), np.concatenate(text), np.concatenate(place)
            leaves, _ = deep_leaves([code, *(rest[:, k] for k in range(BLOCKS - 1))])
            # one text can have an entry from each block; they meet when places are gathered by text
            yield from blob_batches(blobs(((entries[t], p) for t, p in _by_text(text[leaves], place[leaves])), buckets))

    return blocks.repartition("bucket").mapInArrow(run, BLOBS)


def _judged(docs: DataFrame, window: int, finish, schema: str) -> DataFrame:
    """``finish`` (its words, which of them stay) for every document; ``schema`` names what it returns."""
    buckets = shuffle_partitions(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    texts = texts.select("*", *_text_key())
    # the same rows are dealt by text for both joins, so the texts move once
    dealt = texts.select("doc_id", "text", "digest", "text_id")
    twice = repeated(anchors(texts, window)).groupBy("text_id").agg(
        F.collect_list("place").alias("places"))
    with_anchors = dealt.join(twice, "text_id").select("doc_id", "text", "digest", "text_id", "places")
    found = by_text(repeats(suffixes(with_anchors.sortWithinPartitions("text_id", "digest"), window, buckets), buckets), 24)
    found = found.select("text_id", F.substring("entry", 9, 16).alias("digest"), "places")
    copies = texts.groupBy("text_id", "digest").agg(F.count("*").alias("n")).where("n > 1").select(
        "text_id", "digest", F.lit(None).cast("binary").alias("places"))
    gathered = found.unionByName(copies).groupBy("text_id").agg(F.collect_list(F.struct("digest", "places")).alias("found"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", SLICE):
                out = []
                for doc, text, own, lists in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "digest", "found"))):
                    parts = text.encode().split()
                    keep = np.ones(len(parts), dtype=bool)
                    lists = [f["places"] for f in lists or () if f["digest"] == own]
                    if lists and len(parts) >= window:
                        if None in lists:
                            keep[:] = False
                        else:
                            begin = np.unique(np.frombuffer(b"".join(lists), "<i4"))
                            delta = np.zeros(len(parts) + 1, dtype=np.int64)
                            delta[begin] += 1
                            np.subtract.at(delta, begin + window, 1)
                            keep = np.cumsum(delta[:-1]) == 0
                    out.append((doc, len(parts), int(len(parts) - keep.sum()), finish(parts, keep)))
                a, b, c, d = zip(*out)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.int64()), pa.array(d, pa.string())],
                    names=["doc_id", "n_words", "n_removed", schema])

    joined = dealt.join(gathered, "text_id", "left").select("doc_id", "text", "digest", "found")
    return joined.mapInArrow(run, f"doc_id bigint, n_words bigint, n_removed bigint, {schema} string")


def deduplicated(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, and the kept words joined by one blank as ``text``."""
    return _judged(docs, window, lambda parts, keep: b" ".join(compress(parts, keep)).decode(), "text")


def report(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """The same with the SHA-256 of the kept text instead of it."""
    return _judged(docs, window, lambda parts, keep: hashlib.sha256(b" ".join(compress(parts, keep))).hexdigest(), "kept_sha256")
