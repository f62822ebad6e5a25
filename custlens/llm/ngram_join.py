"""Jaccard join of documents over word shingles by count vectors in an R-tree.

Shingles are hashed into groups, and a document's point is the number of its shingles in each group. The overlap of two
documents is at most the sum of the smaller coordinates, which holds for boxes of points too, so an R-tree over the
points prunes pairs that can't reach the similarity; the survivors are compared set by set.

So that no task holds all points, documents meet by keys first. With a similarity of t or more, two sets differ in few
shingles: when a set is dealt by hash into more parts than that, some part is untouched and equal in both. The digests
of the parts are the keys (sizes are banded so that both sides use the same number of parts; the parts of the next band
are added where a partner can lie there). No linked pair is lost, and a key is shared only by documents that are equal
in a whole part.

Equal sets are one point, and linked. What is asked for is components, so pairs inside one need no further look:

1. Each set is compared with one of those that it shares a key with, the one with most shared keys. The links found make components, and a
   group of many copies mostly becomes one here, in linear work.
2. For keys that still hold sets of several components, the sets outside the largest component of the key are looked up
   in an R-tree over the key's sets. Survivors of the bound are compared, and links between components added.
3. A key with more than ``FEW`` sets may be a template that many texts share without being linked, and its pairs would grow
   with its square. Its sets are dealt once more, by their rarest shingles (of all such sets): of two linked sets, the
   first few of one and the first few of the other have one in common, so sets that share only what is common to all no
   longer meet. Trees are built over the sets of a shingle, in blocks, and those that ask are cut into blocks, too.

Defined results: A-Z count as a-z and words are runs of characters other than ASCII white space; a missing, empty or
blank text has no shingles and is linked with nothing; fewer words than a shingle has are one shingle; rows with equal
sets are linked whatever their ids, repeated rows included; a missing id is greater than all others, and a component
of missing ids only has a missing id; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from custlens.functions.stages import written
from custlens.llm.common import document_key, slices
from custlens.llm.graph import components
from custlens.llm.hashing import mix, run_hashes, words

#: Coordinates of a point, a power of two. The overlap of two sets that share nothing is bounded by about the square of
#: their size over this number, so a few hundred tell texts of usual length apart.
DIMENSIONS = 256
#: Points in a leaf of the tree, and in one block of a key's points.
LEAF, BLOCK = 16, 2048
#: Sets of a key up to which they are all looked up among each other.
FEW = 64
#: Shingles of a chunk of sets, and of a bucket in which they are counted.
CHUNK_HASHES = 1 << 20
SLICE = 1 << 20


# ---- sets and points ----


def shingle_sets(texts: pa.Array, n: int) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its shingles."""
    found = words(texts, lower=True)
    runs = run_hashes(found.hash, n)
    for a, b in zip(found.first[:-1].tolist(), found.first[1:].tolist()):
        if b - a >= n:
            yield np.unique(runs[a:b - n + 1])
        elif b > a:
            yield run_hashes(found.hash[a:b], b - a) ^ np.uint64(b - a)
        else:
            yield np.zeros(0, np.uint64)


def digest(values: np.ndarray) -> bytes:
    return hashlib.blake2b(values.tobytes(), digest_size=16).digest()


def point(values: np.ndarray) -> np.ndarray:
    """How many hashes fall into each group."""
    return np.bincount((values % np.uint64(DIMENSIONS)).astype(np.int64), minlength=DIMENSIONS).astype(np.int32)


def packed(point: np.ndarray) -> bytes:
    """A point as a short text, since one goes along with every key of its set: a byte or four for a count, deflated."""
    width = 1 if point.max() < 256 else 4
    return bytes([width]) + zlib.compress(point.astype(f"<u{width}").tobytes(), 6, -15)


def unpacked(texts: list[bytes]) -> np.ndarray:
    """The points of :func:`packed`, one in a row."""
    rows = [np.frombuffer(zlib.decompress(t[1:], -15), f"<u{t[0]}") for t in texts]
    return np.stack(rows).astype(np.int32) if rows else np.zeros((0, DIMENSIONS), np.int32)


class Bands:
    """Bands of set sizes for a similarity, and the number of parts in each."""

    def __init__(self, percent: int):
        self.percent = percent
        self.limits = [1]  # first size of each band
        while self.limits[-1] < 1 << 40:
            self.limits.append(max(self.limits[-1] + 1, int(self.limits[-1] * (100 / percent) ** 3)))

    def differ(self, size: int) -> int:
        """The most shingles in which a set of this size and a linked one can differ."""
        return (100 - self.percent) * size // self.percent

    def of(self, size: int) -> list[int]:
        """The band of a size, and the next one if a linked partner can lie there."""
        own = int(np.searchsorted(self.limits, size, side="right")) - 1
        return [own, own + 1] if size * 100 // self.percent >= self.limits[own + 1] else [own]

    def parts(self, band: int) -> int:
        """More parts than two sets of which the larger is in this band can differ in, and some to allow for empty ones."""
        most = self.differ(self.limits[band + 1] - 1)
        return 1 if most == 0 else most + 2 + most // 8

    def keys(self, values: np.ndarray) -> np.ndarray:
        """The digests of a set's parts.

        An empty part says nothing. With more full parts than the set can differ in, a full one is untouched; only a set
        with fewer needs its empty parts as keys, and so does every linked partner then.
        """
        out = []
        for band in self.of(len(values)):
            parts = self.parts(band)
            seed = mix(np.array([band * 2 + 1], dtype=np.uint64))
            spread = mix(values ^ seed)
            part = (spread % np.uint64(parts)).astype(np.int64)
            content = np.zeros(parts, dtype=np.uint64)
            np.add.at(content, part, mix(spread))
            full = np.zeros(parts, dtype=bool)
            full[part] = True
            if full.sum() <= self.differ(len(values)):
                full[:] = True
            at = np.flatnonzero(full)
            out.append(mix(content[at] ^ mix(at.astype(np.uint64) * seed)))
        return np.concatenate(out)


def _short(digest16: bytes) -> int:
    return int.from_bytes(digest16[:8], "little", signed=True)


SETS = "doc_id bigint, doc_key binary, n_shingles bigint, set binary, node bigint, point binary"


def document_sets(docs: DataFrame, n: int) -> DataFrame:
    """One row per document: size, digest (whole, and short as ``node``) and point of its set; null for an empty set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", SLICE):
                sizes, sets, nodes, points = [], [], [], []
                for values in shingle_sets(batch.column("text"), n):
                    own = digest(values) if len(values) else None
                    sizes.append(len(values))
                    sets.append(own)
                    nodes.append(_short(own) if own else None)
                    points.append(packed(point(values)) if own else None)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), batch.column("doc_key"), pa.array(sizes, pa.int64()), pa.array(sets, pa.binary()),
                     pa.array(nodes, pa.int64()), pa.array(points, pa.binary())],
                    names=["doc_id", "doc_key", "n_shingles", "set", "node", "point"])

    return docs.select("doc_id", document_key().alias("doc_key"), "text").mapInArrow(run, SETS)


def part_keys(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """(key, node) for the sets of documents; a task gives each set once, up to a bounded memory of sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands, seen = Bands(percent), set()
        for whole in batches:
            for batch in slices(whole, "text", SLICE):
                keys, nodes = [], []
                for values in shingle_sets(batch.column("text"), n):
                    if not len(values) or bands.differ(len(values)) == 0:
                        continue
                    own = digest(values)
                    if own in seen:
                        continue
                    if len(seen) > 200_000:
                        seen.clear()
                    seen.add(own)
                    found = bands.keys(values)
                    keys.append(found)
                    nodes.append(np.full(len(found), _short(own), dtype=np.int64))
                if keys:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(nodes))], names=["key", "node"])

    return docs.select("text").mapInArrow(run, "key bigint, node bigint")


def shared_keys(keys: DataFrame) -> DataFrame:
    """The distinct (key, node) of keys that several sets have. Groups of any size stream through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_key = last_node = np.zeros(0, np.int64)
        open_ = False  # whether the last row's key has had another row before
        for batch in batches:
            key = np.concatenate([last_key, batch.column("key").to_numpy()])
            node = np.concatenate([last_node, batch.column("node").to_numpy()])
            if not len(key):
                continue
            new = np.ones(len(key), dtype=bool)
            new[1:] = (key[1:] != key[:-1]) | (node[1:] != node[:-1])
            key, node = key[new], node[new]
            same = key[1:] == key[:-1]
            several = np.append(same, False)
            several[1:] |= same
            several[0] |= open_
            open_ = bool(several[-1])
            several[-1] = False  # the last row waits, as it may repeat or begin a shared group
            yield pa.RecordBatch.from_arrays([pa.array(key[several]), pa.array(node[several])], names=["key", "node"])
            last_key, last_node = key[-1:], node[-1:]
        if open_:
            yield pa.RecordBatch.from_arrays([pa.array(last_key), pa.array(last_node)], names=["key", "node"])

    return keys.repartition("key").sortWithinPartitions("key", "node").mapInArrow(run, "key bigint, node bigint")


# ---- the tree ----


def _overlap(points: np.ndarray, point: np.ndarray) -> np.ndarray:
    """The sums of the smaller coordinates."""
    return np.minimum(points, point).sum(axis=1, dtype=np.int64)


class CountTree:
    """A static R-tree over points: leaves of near points, and boxes of growing numbers of leaves above."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray):
        self.order = self._packed(points, np.arange(len(points)))
        self.points, self.sizes = points[self.order], sizes[self.order]
        self.levels = []  # from the leaves up: (smallest size, largest size, largest coordinates) of each box
        low, high, top, width = self.sizes, self.sizes, self.points, LEAF
        while len(low) > 1:
            at = np.arange(0, len(low), width)
            low, high, top = np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.maximum.reduceat(top, at, axis=0)
            self.levels.append((low, high, top, width))
            width = 8

    @staticmethod
    def _packed(points: np.ndarray, index: np.ndarray) -> np.ndarray:
        """An order in which neighbours are near: halves by the coordinate of the widest spread, again and again."""
        if len(index) <= LEAF:
            return index
        own = points[index]
        by = int(np.argmax(own.max(axis=0) - own.min(axis=0)))
        order = index[np.argsort(own[:, by], kind="stable")]
        middle = -(-len(order) // 2 // LEAF) * LEAF
        return np.concatenate([CountTree._packed(points, order[:middle]), CountTree._packed(points, order[middle:])])

    def near(self, point: np.ndarray, size: int, percent: int) -> np.ndarray:
        """The numbers of all points that can reach the similarity with this one."""
        alive = np.zeros(1, dtype=np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            low, high, top, _ = self.levels[k]
            # the overlap is at most the sum of smaller coordinates; the size that suits best is the overlap itself
            bound = _overlap(top[alive], point)
            possible = np.minimum(bound, high[alive])
            fits = possible * 100 >= percent * (size + np.maximum(low[alive], possible) - possible)
            alive = alive[fits]
            width, count = self.levels[k][3], len(self.levels[k - 1][0]) if k else len(self.points)
            alive = (alive[:, None] * width + np.arange(width)).ravel()
            alive = alive[alive < count]
        bound = _overlap(self.points[alive], point)
        fits = bound * 100 >= percent * (size + self.sizes[alive] - bound)
        return self.order[alive[fits]]


def bounded(pairs: DataFrame, percent: int) -> DataFrame:
    """(a, b) of the pairs whose points (point_a, point_b) and sizes (size_a, size_b) can reach the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            left, right = (unpacked(batch.column(c).to_pylist()) for c in ("point_a", "point_b"))
            least = np.minimum(left, right).sum(axis=1, dtype=np.int64)
            size = batch.column("size_a").to_numpy() + batch.column("size_b").to_numpy()
            fits = pa.array(least * 100 >= percent * (size - least))
            yield batch.select(["a", "b"]).filter(fits)

    return pairs.select("a", "b", "size_a", "size_b", "point_a", "point_b").mapInArrow(run, "a bigint, b bigint")


def candidate_pairs(blocks: DataFrame, percent: int, larger_asks: bool = False) -> DataFrame:
    """Pairs (a, b) of different components within a block that the bound lets through.

    Rows: key, block, asks (whether the row is looked up or is looked in), node, component, size, point. With
    ``larger_asks`` a set is looked up among sets that are not larger.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def answer(rows: pa.Table) -> pa.RecordBatch:
            node, component, size = (rows[c].to_numpy() for c in ("node", "component", "size"))
            asks = rows["asks"].to_numpy(zero_copy_only=False)
            points = unpacked(rows["point"].to_pylist())
            inside = np.flatnonzero(~asks)
            pairs: list[tuple[int, int]] = []
            if len(inside):
                tree = CountTree(points[inside], size[inside])
                for q in np.flatnonzero(asks):
                    for at in inside[tree.near(points[q], int(size[q]), percent)]:
                        if component[at] != component[q] and not (larger_asks and size[at] > size[q]):
                            pairs.append((min(node[at], node[q]), max(node[at], node[q])))
            pairs = sorted(set(pairs))
            return pa.RecordBatch.from_arrays(
                [pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], names=["a", "b"])

        def groups(table: pa.Table) -> Iterator[pa.Table]:
            key, block = table["key"].to_numpy(), table["block"].to_numpy()
            cuts = np.flatnonzero((key[1:] != key[:-1]) | (block[1:] != block[:-1])) + 1
            bounds = [0, *cuts.tolist(), len(key)]
            for a, b in zip(bounds[:-1], bounds[1:]):
                yield table.slice(a, b - a)

        for batch in batches:
            held.append(batch)
            *done, last = groups(pa.Table.from_batches(held))
            for rows in done:
                yield answer(rows)
            held = last.to_batches()
        if held:
            yield answer(pa.Table.from_batches(held))

    by = blocks.repartition("key", "block").sortWithinPartitions("key", "block")
    return by.mapInArrow(run, "a bigint, b bigint").distinct()


# ---- the join ----


def contents_of(nodes: DataFrame, docs: DataFrame, sets: DataFrame, n: int) -> DataFrame:
    """The sets of ``nodes`` with their shingles, written: set, node, hashes."""
    # one document for every set in question
    some = sets.where("set is not null").join(nodes, "node", "left_semi").groupBy("set").agg(
        F.min("doc_id").alias("doc_id"), F.max(F.col("doc_id").isNull()).alias("missing"))
    some = written(some, "sets_in_question")
    ids = some.select("doc_id").distinct()
    texts = docs.join(ids, docs["doc_id"].eqNullSafe(ids["doc_id"]), "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", SLICE):
                found = [v for v in shingle_sets(batch.column("text"), n) if len(v)]
                own = [digest(v) for v in found]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(own, pa.binary()), pa.array([_short(d) for d in own], pa.int64()),
                     pa.array([v.view(np.int64) for v in found], pa.list_(pa.int64()))], names=["set", "node", "hashes"])

    contents = texts.select("text").mapInArrow(run, "set binary, node bigint, hashes array<bigint>")
    return written(contents.join(some.select("set"), "set", "left_semi").dropDuplicates(["set"]), "set_contents")


def verified(pairs: DataFrame, docs: DataFrame, sets: DataFrame, n: int, percent: int) -> DataFrame:
    """The pairs of nodes whose sets reach the similarity, as pairs of whole digests."""
    asked = written(pairs, "pairs")
    nodes = asked.select(F.col("a").alias("node")).union(asked.select("b")).distinct()
    contents = contents_of(nodes, docs, sets, n)
    a = contents.select(F.col("node").alias("a"), F.col("set").alias("set_a"), F.col("hashes").alias("hashes_a"))
    b = contents.select(F.col("node").alias("b"), F.col("set").alias("set_b"), F.col("hashes").alias("hashes_b"))
    both = F.size(F.array_intersect("hashes_a", "hashes_b"))
    return asked.join(a, "a").join(b, "b").where(
        both * 100 >= percent * (F.size("hashes_a") + F.size("hashes_b") - both)).select("set_a", "set_b")


def _prefixes(size: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """How many of its first shingles a set asks with, and with how many of them it is looked in."""
    asks = size + size * -percent // 100 + 1
    return asks, size + -2 * size * percent // (100 + percent) + 1


CHUNKS = "chunk bigint, nodes binary, sizes binary, hashes binary"
ASKED = "chunk bigint, bucket int, hashes binary, counts binary"
TOLD = "chunk bigint, bucket int, ranks binary"


def set_chunks(contents: DataFrame) -> DataFrame:
    """The sets of ``contents`` in written chunks of about ``CHUNK_HASHES`` hashes, a larger set in one of its own."""
    most = CHUNK_HASHES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, nodes, sizes, hashes, held = TaskContext.get().partitionId() << 32, [], [], [], 0
        for batch in batches:
            lists = batch.column("hashes")
            values, cut = lists.values.to_numpy(), lists.offsets.to_numpy()
            for node, a, b in zip(batch.column("node").to_pylist(), cut[:-1].tolist(), cut[1:].tolist()):
                nodes.append(node)
                sizes.append(b - a)
                hashes.append(values[a:b])
                held += b - a
                if held >= most:
                    yield _chunk(chunk, nodes, sizes, hashes)
                    chunk, nodes, sizes, hashes, held = chunk + 1, [], [], [], 0
        if nodes:
            yield _chunk(chunk, nodes, sizes, hashes)

    return written(contents.select("node", "hashes").mapInArrow(run, CHUNKS), "set_chunks")


def _chunk(chunk: int, nodes: list[int], sizes: list[int], hashes: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([chunk], pa.int64()), pa.array([np.array(nodes, "<i8").tobytes()]), pa.array([np.array(sizes, "<i8").tobytes()]),
         pa.array([np.concatenate(hashes).astype("<i8").tobytes()])], names=["chunk", "nodes", "sizes", "hashes"])


def _bucket_of(unique: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(unique.view(np.uint64)) % np.uint64(buckets)).astype(np.int64)


def frequency_ranks(chunks: DataFrame, buckets: int) -> DataFrame:
    """For each chunk and bucket of hashes a byte for each different hash: how often it comes in all sets, by eighths of
    powers of two, 0 for a single set.

    A chunk asks for each of its hashes once; a bucket, sized by the number of hashes, adds up and answers.
    """

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, raw in zip(batch.column("chunk").to_pylist(), batch.column("hashes").to_pylist()):
                unique, counts = np.unique(np.frombuffer(raw, "<i8"), return_counts=True)
                bucket = _bucket_of(unique, buckets)
                order = np.argsort(bucket, kind="stable")
                cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
                for k in np.flatnonzero(cuts[1:] > cuts[:-1]).tolist():
                    own = order[cuts[k]:cuts[k + 1]]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([chunk], pa.int64()), pa.array([k], pa.int32()), pa.array([unique[own].astype("<i8").tobytes()]),
                         pa.array([counts[own].astype("<u4").tobytes()])], names=["chunk", "bucket", "hashes", "counts"])

    def answer(asked: pa.Table) -> pa.Table:
        rows = [np.frombuffer(h, "<i8") for h in asked.column("hashes").to_pylist()]
        counts = np.concatenate([np.frombuffer(c, "<u4") for c in asked.column("counts").to_pylist()])
        _, back = np.unique(np.concatenate(rows), return_inverse=True)
        total = np.bincount(back, weights=counts)
        ranks = np.minimum(np.ceil(8.0 * np.log2(total)), 255).astype(np.uint8)[back]
        cut = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).tolist()
        told = [ranks[a:b].tobytes() for a, b in zip(cut, cut[1:])]
        return pa.table([asked.column("chunk"), asked.column("bucket"), pa.array(told, pa.binary())], names=["chunk", "bucket", "ranks"])

    return chunks.select("chunk", "hashes").mapInArrow(ask, ASKED).groupBy("bucket").applyInArrow(answer, TOLD)


def rare_shingles(contents: DataFrame, percent: int, hashes: int) -> DataFrame:
    """(key, node, indexed): the first shingles of each set in the order of their frequency among ``contents``.

    Of two sets with overlap o, the first size - o + 1 shingles of one and those of the other have one in common, in any order
    that is the same for all. A set of size s has overlap s * t or more with a smaller one that is linked, and
    2 * s * t / (1 + t) or more with a larger one; so it asks with the first s - s * t + 1 and is looked in for the fewer that
    the second bound leaves (``indexed``). Shingles that no other set has come first, and nobody meets there. ``hashes`` is the
    number of all shingles.
    """
    buckets = max(1, -(-hashes // CHUNK_HASHES))
    chunks = set_chunks(contents)

    def deal(own: pa.Table, told: pa.Table) -> pa.Table:
        nodes, size, values = (np.frombuffer(own.column(c)[0].as_py(), "<i8") for c in ("nodes", "sizes", "hashes"))
        unique, back = np.unique(values, return_inverse=True)
        order = np.argsort(_bucket_of(unique, buckets), kind="stable")
        by_bucket = sorted(zip(told.column("bucket").to_pylist(), told.column("ranks").to_pylist()))
        rank = np.zeros(len(unique), dtype=np.uint8)
        rank[order] = np.frombuffer(b"".join(r for _, r in by_bucket), np.uint8)
        each = rank[back]
        row = np.repeat(np.arange(len(size)), size)
        sorted_ = np.lexsort((values, each, row))
        place = np.arange(len(values)) - np.repeat(np.cumsum(size) - size, size)
        asks, indexed = _prefixes(size, percent)
        row, each = row[sorted_], each[sorted_]
        some = (place < asks[row]) & (each > 0)
        return pa.table([pa.array(values[sorted_][some], pa.int64()), pa.array(nodes[row[some]], pa.int64()),
                         pa.array((place < indexed[row])[some], pa.bool_())], names=["key", "node", "indexed"])

    ranks = frequency_ranks(chunks, buckets)
    return chunks.groupBy("chunk").cogroup(ranks.groupBy("chunk")).applyInArrow(deal, "key bigint, node bigint, indexed boolean")


def rare_blocks(dealt: DataFrame, named: DataFrame) -> DataFrame:
    """The rows of :func:`candidate_pairs` for sets dealt by shingles.

    In a shingle's group the sets outside the largest component ask among all, and those of the largest one among the
    others. Both sides are cut: those looked in into blocks, those that ask into slices, and every block meets every slice.
    """
    rows = written(dealt.join(named.select("node", "component"), "node"), "rare_members")
    of_component = rows.groupBy("key", "component").agg(F.count("*").alias("n"), F.count_if("indexed").alias("inside"))
    groups = of_component.groupBy("key").agg(
        F.count("*").alias("components"), F.max(F.struct("n", "component", "inside")).alias("top"), F.sum("n").alias("n"),
        F.sum("inside").alias("inside")).where("components > 1 and inside > 0")
    few = lambda c: F.ceil(c / F.lit(BLOCK)).cast("bigint")
    groups = groups.select(
        "key", F.col("top.component").alias("largest"), few(F.col("inside")).alias("blocks_0"),
        few(F.col("inside") - F.col("top.inside")).alias("blocks_1"), few(F.col("n") - F.col("top.n")).alias("slices_0"),
        few(F.col("top.n")).alias("slices_1"))
    placed = rows.join(groups, "key")
    parts = []
    for side in (0, 1):
        blocks, slices_ = F.col(f"blocks_{side}"), F.col(f"slices_{side}")
        other = F.col("component") != F.col("largest")
        some = placed.where(blocks > 0)
        key = F.xxhash64("key", F.lit(side)).alias("key")
        spot = F.pmod(F.xxhash64("node"), blocks)
        inside = some.where("indexed" if side == 0 else (F.col("indexed") & other)).select(
            key, "node", F.lit(False).alias("asks"), spot.alias("_b"), slices_.alias("_n"), F.explode(F.sequence(F.lit(0).cast("bigint"), slices_ - 1)).alias("_s"))
        asking = some.where(other if side == 0 else ~other).select(
            key, "node", F.lit(True).alias("asks"), F.pmod(F.xxhash64("node"), slices_).alias("_s"), slices_.alias("_n"),
            F.explode(F.sequence(F.lit(0).cast("bigint"), blocks - 1)).alias("_b"))
        parts += [x.select("key", (F.col("_b") * F.col("_n") + F.col("_s")).alias("block"), "asks", "node") for x in (inside, asking)]
    every = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    return every.join(named, "node").select("key", "block", "asks", "node", "component", "size", "point")


def _labelled(docs: DataFrame, n: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """The sets of all documents, and the component of every set that is linked with another: node, label."""
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    sets = written(document_sets(texts, n), "document_sets")
    shared = written(shared_keys(part_keys(texts, n, percent)), "shared_keys")
    points = written(
        sets.where("set is not null").groupBy("set").agg(
            F.first("node").alias("node"), F.first("n_shingles").alias("size"), F.first("point").alias("point")), "points")

    def side(x: str) -> DataFrame:
        return points.select(F.col("node").alias(x), F.col("size").alias(f"size_{x}"), F.col("point").alias(f"point_{x}"))

    # 1. each set and the one of those that it shares a key with that shares most keys itself: an original rather than
    # one of its copies
    degree = shared.groupBy("node").agg(F.count("*").alias("keys"))
    hubs = shared.join(degree, "node").groupBy("key").agg(F.max(F.struct("keys", "node")).alias("hub"))
    stars = shared.join(hubs, "key").groupBy(F.col("node").alias("b")).agg(F.max("hub")["node"].alias("a")).where("a <> b")
    stars = bounded(stars.join(side("a"), "a").join(side("b"), "b"), percent)
    first = written(verified(stars, texts, sets, n, percent), "links_1")

    def by_set(links: DataFrame) -> DataFrame:
        return components(links.select(F.col("set_a").alias("a"), F.col("set_b").alias("b")))

    labels = by_set(first)
    # 2. keys that hold several components still
    named = points.join(labels.withColumnRenamed("node", "set"), "set", "left").select(
        "node", "size", "point", F.xxhash64(F.coalesce("label", "set")).alias("component"))
    members = written(shared.join(named.select("node", "component"), "node"), "key_members")
    by_component = members.groupBy("key", "component").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("node")).alias("x"))
    mixed = by_component.groupBy("key").agg(
        F.count("*").alias("components"), F.sum("n").alias("n"), F.max(F.struct("n", "component"))["component"].alias("largest"),
        F.bit_xor("x").alias("x")).where("components > 1")
    # of keys with the same members one is enough
    mixed = written(mixed.groupBy("x", "n", "largest").agg(F.min("key").alias("key")), "mixed_keys")
    rows = members.join(mixed.select("key", "n", "largest"), "key")
    some = rows.where(F.col("n") <= FEW).join(named.drop("component"), "node").withColumn("block", F.lit(0).cast("bigint"))
    inside, asking = some.withColumn("asks", F.lit(False)), some.where("component <> largest").withColumn("asks", F.lit(True))
    blocks = inside.unionByName(asking).select("key", "block", "asks", "node", "component", "size", "point")
    # 3. keys with many sets: dealt by their rarest shingles
    many = written(rows.where(F.col("n") > FEW).select("node").distinct(), "sets_of_large_keys")
    hashes = points.join(many, "node").agg(F.sum("size")).first()[0] or 0
    dealt = rare_shingles(contents_of(many, texts, sets, n), percent, hashes)
    pairs = candidate_pairs(blocks, percent).unionByName(candidate_pairs(rare_blocks(dealt, named), percent, larger_asks=True))
    second = written(verified(pairs.distinct(), texts, sets, n, percent), "links_2")
    labels = by_set(first.unionByName(second))

    return sets, labels


def linked(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (the smallest doc_id that links lead to)."""
    sets, labels = _labelled(docs, n, percent)
    ids = sets.where("set is not null").groupBy("set").agg(F.min("doc_id").alias("least_id"))
    named = ids.join(labels.withColumnRenamed("node", "set"), "set", "left").withColumn("label", F.coalesce("label", "set"))
    smallest = named.groupBy("label").agg(F.min("least_id").alias("component_id"))
    of_set = written(named.join(smallest, "label").select("set", "component_id"), "components")
    return sets.join(of_set, "set", "left").select(
        "doc_id", "n_shingles", F.when(F.col("set").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def one_of_each(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """One document of each component, and all without shingles; all columns are kept.

    The one with the smallest id stays, missing ids last, then the smallest digest of id and text; of rows with the same
    id and text any one.
    """
    sets, labels = _labelled(docs, n, percent)
    full = sets.where("set is not null").select("doc_id", "doc_key", "set")
    best = F.struct(F.col("doc_id").isNull(), "doc_id", "doc_key")
    firsts = full.groupBy("set").agg(F.min(best).alias("best"), F.count("*").alias("rows"))
    firsts = firsts.join(labels.withColumnRenamed("node", "set"), "set", "left").withColumn("label", F.coalesce("label", "set"))
    stays = written(firsts.groupBy("label").agg(F.min("best")["doc_key"].alias("doc_key"), F.sum("rows").alias("rows")), "stays")
    gone = full.join(stays, "doc_key", "left_anti").select("doc_key").distinct()
    twice = full.join(stays.where("rows > 1"), "doc_key", "left_semi").groupBy("doc_key").count().where("count > 1")
    decided = written(gone.withColumn("goes", F.lit(True)).unionByName(
        twice.select("doc_key", F.lit(False).alias("goes"))), "decisions")
    base = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), document_key().alias("doc_key"))
    left = base.join(decided.where("goes"), "doc_key", "left_anti")
    repeated = decided.where("not goes").select("doc_key")
    if repeated.limit(1).count():  # rows that are there more than once
        left = left.join(repeated, "doc_key", "left_anti").unionByName(
            left.join(repeated, "doc_key", "left_semi").dropDuplicates(["doc_key"]))
    return left.select("row.*")
