"""Synthetic rows of the smaller class, for training only.

A synthetic row lies between a training row of the class and one of its nearest neighbours in the class. How many a row gives,
which neighbour is taken and where between the two the new row lies all follow from hashes of the row's key and the number of
the synthetic row, so the result does not depend on layout or order. Neighbours are searched among a bounded number of the
class's rows (see :mod:`custlens.operators.neighbours`); every row of the class gives synthetic ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from custlens.functions.ranking import ordered_row_numbers
from custlens.operators.neighbours import FIT_ROWS, nearest_neighbours
from custlens.operators.splits import SEED

NEIGHBOURS = 5


def _hashed(*parts: Column | str, seed: int = SEED) -> Column:
    """Eight hex digits of a digest, as a number."""
    text = F.concat_ws(":", *[F.col(p).cast("string") if isinstance(p, str) else p for p in parts], F.lit(f"smote:{seed}"))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("bigint")


def quotas(minority: DataFrame, wanted: int, size: int, key: str = "customer_id", seed: int = SEED) -> DataFrame:
    """(key, quota): how many synthetic rows each of ``size`` rows gives, ``wanted`` in all; the rest goes to the first by hash."""
    keyed = minority.select(key).withColumn("_hash", F.md5(F.concat(F.col(key).cast("string"), F.lit(f":quota:{seed}")).cast("binary")))
    placed = ordered_row_numbers(keyed, F.substring("_hash", 1, 3), ["_hash", key], "_place")
    return placed.select(key, (F.lit(wanted // size) + (F.col("_place") <= wanted % size).cast("int")).cast("int").alias("quota"))


def smote(train: DataFrame, label: str = "churn", k: int = NEIGHBOURS, rows: int = FIT_ROWS, seed: int = SEED) -> DataFrame:
    """Synthetic rows with which both classes are equal: source_id, neighbour_id, nr, gap, x, label.

    ``train`` has customer_id, x (array of scaled numbers) and the label; only training rows may be given. No rows come back
    if the classes are equal, or the smaller one has a single row.
    """
    sizes = {r[label]: r["n"] for r in train.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()}  # two rows
    if len(sizes) != 2:
        raise ValueError("smote needs two classes")
    small, large = sorted(sizes, key=lambda v: (sizes[v], v))
    minority = train.filter(F.col(label) == small).select("customer_id", "x")
    schema = "source_id bigint, neighbour_id bigint, nr int, gap double, x array<double>"
    if sizes[small] < 2 or sizes[small] == sizes[large]:
        return train.sparkSession.createDataFrame([], f"{schema}, label double")
    queries = minority.select(F.col("customer_id").alias("qid"), "x")
    found = nearest_neighbours(queries, minority.select(F.col("customer_id").alias("tid"), "x", F.lit(1.0).alias("y")), k + 1, rows)
    order = Window.partitionBy("qid").orderBy("d", "tid")  # k + 1 rows
    near = found.filter("qid <> tid").withColumn("_nr", F.row_number().over(order)).filter(F.col("_nr") <= k).groupBy("qid").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("_nr", "tid"))), lambda s: s["tid"]).alias("near"))
    plan = minority.join(quotas(minority, sizes[large] - sizes[small], sizes[small], seed=seed), "customer_id").join(
        near.withColumnRenamed("qid", "customer_id"), "customer_id").where("quota > 0")
    each = plan.withColumn("nr", F.explode(F.sequence(F.lit(1), F.col("quota"))))
    chosen = F.element_at("near", (F.pmod(_hashed("customer_id", "nr", F.lit("which"), seed=seed), F.size("near")) + 1).cast("int"))
    gap = _hashed("customer_id", "nr", F.lit("gap"), seed=seed) / F.lit(float(1 << 32))
    picked = each.select(F.col("customer_id").cast("bigint").alias("source_id"), chosen.cast("bigint").alias("neighbour_id"), "nr", gap.alias("gap"), F.col("x").alias("_x"))
    other = minority.select(F.col("customer_id").alias("neighbour_id"), F.col("x").alias("_y"))
    between = F.zip_with("_x", "_y", lambda a, b: a + F.col("gap") * (b - a))
    return picked.join(other, "neighbour_id").select("source_id", "neighbour_id", "nr", "gap", between.alias("x"), F.lit(float(small)).alias("label"))
