"""Merkle manifest of a dataset, with membership proofs.

Every row is a leaf with a digest; the leaves of a source form a tree in which each run of 16 consecutive nodes has one
parent, and the roots of the sources form a tree in the same way, whose root stands for the whole table.

Nodes are labelled with nested intervals: a node covers the leaves ``lo`` up to (not including) ``hi`` of its tree. A level
is cut into buckets as wide as the intervals of the level above, so that a node meets its ancestor in a join by tree and
bucket in which the ancestor's interval contains its own; a bucket has 16 members at most, whatever the size of a source.
Within a parent, the interval less the node's own leaves the siblings. Paths pass down level by level, so a leaf takes the
path of its run and no table holds all pairs of leaves and ancestors.

Ranks of leaves come from one sort by range; rows of one source may fill many ranges, and only the number of leaves before
the first and the last source of each range goes to the driver.

Defined results: a missing value is ``-`` in the digest, an empty one ``0:``; a missing source is a source of its own, the
first; leaves with the same id are in the order of their digests, repeated rows are leaves of their own; a missing id comes
first and is never tampered with; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from custlens.functions.stages import written

RUN = 16
LEAF_COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


# ---- digests ----


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def stated(value: Column) -> Column:
    """The length in bytes, a colon and the value; ``-`` for a missing one."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(columns: Sequence[str] = LEAF_COLUMNS, text: Column | None = None) -> Column:
    """The digest of a row; ``text`` stands in for the column of that name."""
    return digest(*[stated(text if text is not None and c == "text" else F.col(c)) for c in columns])


def tree_key(source: Column) -> Column:
    """The source as a key without nulls, in the same order of bytes, the missing one first."""
    return F.coalesce(F.concat(F.lit("="), source), F.lit(""))


# ---- ranks ----


def ranked(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """``rows`` with their number within their ``tree`` in the order of the columns ``order``, from 0: rank.

    Rows equal in all of these may come in any order. A further column deals them out, so that a range holds no more of
    them than of others.
    """
    by = [F.col("tree"), *[F.asc_nulls_first(c) for c in order], F.col("_tie")]
    dealt = rows.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(*by).sortWithinPartitions(*by)
    schema = [(f.name, f.dataType.simpleString()) for f in rows.schema]

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, tree, seen = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            n = batch.num_rows
            if n == 0:
                continue
            trees = batch.column("tree")
            starts = np.zeros(n, dtype=bool)
            starts[1:] = pc.not_equal(trees[1:], trees[:-1]).to_numpy(zero_copy_only=False)
            at = np.arange(n, dtype=np.int64)
            if trees[0].as_py() == tree:
                first = np.maximum.accumulate(np.where(starts, at, -seen))
            else:
                first = np.maximum.accumulate(np.where(starts, at, 0))
            nth = at - first
            tree, seen = trees[n - 1].as_py(), int(nth[-1]) + 1
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(np.full(n, part, dtype=np.int32)), pa.array(nth)],
                names=[*[c for c, _ in schema], "_part", "_nth"])

    placed = written(
        dealt.mapInArrow(number, ", ".join(f"`{c}` {t}" for c, t in [*schema, ("_part", "int"), ("_nth", "bigint")])), "ranked")
    ends = placed.groupBy("_part").agg(
        F.min("tree").alias("first"), F.max(F.struct("tree", "_nth")).alias("last")).orderBy("_part").collect()
    offsets, tree, before = [], None, 0  # one row for each range, as many as shuffle partitions at most
    for row in ends:
        offsets.append((row["_part"], row["first"], before if row["first"] == tree else 0))
        earlier = before if row["last"]["tree"] == tree else 0
        tree, before = row["last"]["tree"], earlier + row["last"]["_nth"] + 1
    spark = rows.sparkSession
    table = spark.createDataFrame(offsets, "_part int, tree string, _before bigint")
    return placed.join(F.broadcast(table), ["_part", "tree"], "left").select(
        *rows.columns, (F.col("_nth") + F.coalesce("_before", F.lit(0))).alias("rank"))


# ---- nodes ----


@dataclass
class Levels:
    """Nodes by level, the leaves first, and the trees whose root is in that level."""

    nodes: list[DataFrame]
    roots: list[DataFrame]


def built(leaves: DataFrame, run: int = RUN) -> Levels:
    """All nodes above ``leaves`` (tree, lo, hi, digest): tree, lo, hi, digest, and the members of a node's run.

    A tree ends with the level in which it has one node; that shows as a run of one member that begins at 0.
    """
    nodes, roots, width = [leaves], [], run
    while True:
        runs = nodes[-1].groupBy("tree", F.expr(f"lo div {width}").alias("bucket")).agg(
            F.sort_array(F.collect_list(F.struct("lo", "hi", "digest"))).alias("members"))
        runs = written(runs.select(
            "tree", F.col("members")[0]["lo"].alias("lo"), F.element_at("members", -1)["hi"].alias("hi"), "members",
            digest(F.concat_ws("", F.col("members.digest"))).alias("digest"),
            ((F.col("members")[0]["lo"] == 0) & (F.size("members") == 1)).alias("single")), "merkle_nodes")
        roots.append(runs.filter("single").select("tree", "hi", F.col("members")[0]["digest"].alias("top")))
        higher = runs.filter("not single").drop("single")
        if not higher.limit(1).count():
            return Levels(nodes, roots)
        nodes.append(higher)
        width *= run


def attached(levels: Levels, seeds: DataFrame, run: int = RUN) -> DataFrame:
    """The leaves with their paths from the bottom to the root: for each ancestor, what stands left and right of the node.

    ``seeds`` holds for every tree the path above its root, and further columns that all its leaves get.
    """
    carried = [c for c in seeds.columns if c not in ("tree", "path")]
    none = F.lit(None).cast("array<struct<lo:bigint,hi:bigint,digest:string>>")
    above = None
    for level in reversed(range(len(levels.nodes))):
        ancestors = levels.roots[level].join(seeds, "tree").select(
            "tree", F.lit(0).cast("bigint").alias("bucket"), F.lit(0).cast("bigint").alias("from"), F.col("hi").alias("to"),
            none.alias("around"), "path", *carried)
        if above is not None:
            ancestors = ancestors.unionByName(above)
        nodes = levels.nodes[level].withColumn("bucket", F.expr(f"lo div {run ** (level + 1)}"))
        met = nodes.join(ancestors, ["tree", "bucket"]).filter((F.col("from") <= F.col("lo")) & (F.col("hi") <= F.col("to")))
        left = F.concat_ws("", F.transform(F.filter("around", lambda m: m["hi"] <= F.col("lo")), lambda m: m["digest"]))
        right = F.concat_ws("", F.transform(F.filter("around", lambda m: m["lo"] >= F.col("hi")), lambda m: m["digest"]))
        path = F.when(F.col("around").isNull(), F.col("path")).otherwise(
            F.concat(F.array(F.struct(left.alias("left"), right.alias("right"))), "path"))
        met = met.withColumn("path", path)
        if level == 0:
            return met.drop("bucket", "from", "to", "around")
        above = met.select(
            "tree", F.expr(f"lo div {run ** level}").alias("bucket"), F.col("lo").alias("from"), F.col("hi").alias("to"),
            F.col("members").alias("around"), "path", *carried)
    raise AssertionError("no level")


def folded(start: Column, path: Column) -> Column:
    """The root that follows from a leaf's digest and its path."""
    return F.aggregate(path, start, lambda own, step: F.sha2(F.concat(step["left"], own, step["right"]), 256))


def proof_text(path: Column) -> Column:
    """The digests of all siblings, level by level, from left to right."""
    return F.concat_ws("", F.transform(path, lambda step: F.concat(step["left"], step["right"])))


NO_PATH = "array<struct<left:string,right:string>>"


def manifest(leaves: DataFrame, run: int = RUN) -> DataFrame:
    """``leaves`` (tree, rank, digest, more) with their path and the digests of their source and of the table.

    More columns come through. A proof is checked by ``folded(digest, path) == root``, without any other row.
    """
    low = leaves.withColumn("lo", F.col("rank")).withColumn("hi", F.col("rank") + 1)
    trees = built(low, run)
    subroots = trees.roots[0]
    for more in trees.roots[1:]:
        subroots = subroots.unionByName(more)
    subroots = written(subroots.select("tree", F.col("top").alias("subroot")), "merkle_subroots")
    sources = ranked(subroots.select(F.lit("").alias("tree"), F.col("tree").alias("source_key"), "subroot"), ["source_key"])
    tops = built(sources.select(
        "tree", F.col("rank").alias("lo"), (F.col("rank") + 1).alias("hi"), F.col("subroot").alias("digest"), "source_key"), run)
    root = tops.roots[0]
    for more in tops.roots[1:]:
        root = root.unionByName(more)
    whole = root.select("tree", F.array().cast(NO_PATH).alias("path"), F.col("top").alias("root"))
    seeds = attached(tops, whole, run).select(
        F.col("source_key").alias("tree"), "path", F.col("digest").alias("subroot"), "root")
    return attached(trees, written(seeds, "merkle_seeds"), run).drop("lo", "hi")


def report(docs: DataFrame) -> DataFrame:
    """One row per row: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified, source, rank.

    The check runs on rows as they might have been tampered with: where 5 divides the checksum of the id, A-Z of the text
    are lowered before the leaf is computed again.
    """
    chosen = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    lowered = leaf_digest(text=F.translate(F.col("text"), UPPER, LOWER))
    leaves = docs.select(*LEAF_COLUMNS).select(
        "doc_id", "source", tree_key(F.col("source")).alias("tree"), leaf_digest().alias("digest"),
        F.when(chosen, lowered).alias("tampered"))
    placed = ranked(written(leaves, "merkle_digests"), ["doc_id", "digest"])
    proved = manifest(placed).withColumn("folded_root", folded(F.coalesce("tampered", "digest"), F.col("path")))
    return proved.select(
        "doc_id", F.col("digest").alias("leaf"), "subroot", "root", F.sha2(proof_text(F.col("path")), 256).alias("proof_sha256"),
        "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"), "source", "rank")
