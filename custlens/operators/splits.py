"""Exact stratified splits, scaling and class weights."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from custlens.functions.stages import written

NON_FEATURES = ("customer_id", "primary_country", "engagement_tier", "churn", "clv_next_90d", "target_orders_count")
SEED = 42
TEST_SHARE = VAL_SHARE = 0.15
MAX_STRATA = 5


def model_inputs(features: DataFrame) -> list[str]:
    return [c for c in features.columns if c not in (*NON_FEATURES, "split")]


def is_stratified(df: DataFrame, target: str) -> bool:
    """A class label, or a target with at most five values."""
    return target == "churn" or df.select(target).distinct().limit(MAX_STRATA + 1).count() <= MAX_STRATA


def split_quotas(strata: DataFrame, test_share: float, val_share: float) -> DataFrame:
    """Test and validation sizes per stratum (at most five rows) by largest remainder."""
    everything = Window.partitionBy()
    total = F.sum("n").over(everything)

    def share_out(rows: DataFrame, pool: str, seats: Column, name: str) -> DataFrame:
        ideal = F.col(pool) * seats / F.sum(pool).over(everything)
        base = F.floor(ideal)
        rows = rows.withColumn("_base", base).withColumn("_rest", ideal - base).withColumn("_seats", seats)
        order = F.row_number().over(Window.partitionBy().orderBy(F.desc("_rest"), "stratum"))
        left = F.col("_seats") - F.sum("_base").over(everything)
        return (
            rows.withColumn("_order", order).withColumn("_left", left)
            .withColumn(name, (F.col("_base") + (F.col("_order") <= F.col("_left")).cast("int")).cast("bigint"))
            .drop("_base", "_rest", "_seats", "_order", "_left")
        )

    test = share_out(strata, "n", F.ceil(F.lit(test_share) * total), "test_n").withColumn(
        "rest_n", F.col("n") - F.col("test_n")
    )
    rest = F.sum("rest_n").over(everything)
    val = share_out(test, "rest_n", F.ceil(F.lit(val_share / (1.0 - test_share)) * rest), "val_n")
    return val.select("stratum", "test_n", "val_n")


def assign_splits(
    df: DataFrame, target: str = "churn", test_share: float = TEST_SHARE, val_share: float = VAL_SHARE,
    seed: int = SEED, key: str = "customer_id",
) -> DataFrame:
    """Adds ``split`` (train, val, test): exact sizes per class, repeatable by hash of the key.

    Rows are counted by class and the first digits of the hash. Nearly all of these buckets lie in one split as a whole, so
    their rows stay where they are; only the few that a split ends in are put in order.
    """
    stratum = F.col(target).cast("string") if is_stratified(df, target) else F.lit("all")
    keyed = df.withColumn("stratum", stratum).withColumn(
        "_hash", F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}")).cast("binary"))
    )
    # The first three hex digits order the rows into 4096 even buckets.
    keyed = keyed.withColumn("_bucket", F.substring("_hash", 1, 3))

    def split_of(place: Column) -> Column:
        return (
            F.when(place <= F.col("test_n"), "test")
            .when(place <= F.col("test_n") + F.col("val_n"), "val").otherwise("train")
        )

    counts = keyed.groupBy("stratum", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    quotas = split_quotas(counts.groupBy("stratum").agg(F.sum("_n").alias("n")), test_share, val_share)
    upto = Window.partitionBy("stratum").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    bounds = written(
        counts.withColumn("_end", F.sum("_n").over(upto)).withColumn("_before", F.col("_end") - F.col("_n"))
        .join(F.broadcast(quotas), "stratum")  # one row per stratum
        .withColumn("_first", split_of(F.col("_before") + 1)).withColumn("_last", split_of(F.col("_end")))
        .drop("_n", "_end"),
        "split_bounds",
    )
    placed = keyed.join(F.broadcast(bounds), ["stratum", "_bucket"])  # at most 4096 rows per stratum
    same = F.col("_first") == F.col("_last")
    inside = F.row_number().over(Window.partitionBy("stratum", "_bucket").orderBy("_hash", key))
    ordered = placed.filter(~same).withColumn("split", split_of(F.col("_before") + inside))
    whole = placed.filter(same).withColumn("split", F.col("_first"))
    return whole.select(*df.columns, "split").unionByName(ordered.select(*df.columns, "split"))


@dataclass(frozen=True)
class Scaler:
    """Means and population deviations of some columns; a constant column has deviation 1."""

    means: dict[str, float]
    deviations: dict[str, float]

    @property
    def columns(self) -> list[str]:
        return list(self.means)

    def scaled(self, name: str) -> Column:
        return (F.col(name).cast("double") - F.lit(self.means[name])) / F.lit(self.deviations[name])

    def apply(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: self.scaled(c) for c in self.columns})


def fit_scaler(df: DataFrame, columns: list[str]) -> Scaler:
    """One pass; two numbers per column come to the driver. Nulls count as 0."""
    filled = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns]
    row = df.agg(
        *[F.avg(x).alias(f"m{i}") for i, x in enumerate(filled)],
        *[F.stddev_pop(x).alias(f"s{i}") for i, x in enumerate(filled)],
    ).first()
    return Scaler(
        {c: float(row[f"m{i}"]) for i, c in enumerate(columns)},
        {c: float(row[f"s{i}"]) or 1.0 for i, c in enumerate(columns)},
    )


def scaled_vectors(df: DataFrame, scaler: Scaler, output: str = "x") -> DataFrame:
    """Adds the scaled columns as one vector; nulls count as 0."""
    names = [f"_s{i}" for i in range(len(scaler.columns))]
    filled = df.withColumns({
        n: (F.coalesce(F.col(c).cast("double"), F.lit(0.0)) - F.lit(scaler.means[c])) / F.lit(scaler.deviations[c])
        for n, c in zip(names, scaler.columns)
    })
    return VectorAssembler(inputCols=names, outputCol=output).transform(filled).drop(*names)


TASKS_PER_CORE = 4


def spread(rows: DataFrame, key: str = "customer_id") -> DataFrame:
    """``rows`` dealt by a hash of their key over all cores, for work that takes long per row.

    A customer table is small for its work: read as it lies in its files, it would keep a few tasks busy.
    """
    return rows.repartition(TASKS_PER_CORE * rows.sparkSession.sparkContext.defaultParallelism, key)


#: Partitions of the rows of a fit. Forests, boosting and k-means draw their samples by partition, so the number belongs to
#: the model's parameters like a seed: equal numbers give equal models on any cluster. Set it with the table's size.
FIT_PARTITIONS = 8
FITS_AT_ONCE = 4


def in_parallel(fit: Callable, items: Iterable) -> list:
    """Independent fits from a few driver threads, as Spark's own cross-validation runs them."""
    with ThreadPool(FITS_AT_ONCE) as pool:
        return pool.map(inheritable_thread_target(SparkSession.active())(fit), items)


@contextmanager
def fitting_rows(rows: DataFrame, partitions: int = FIT_PARTITIONS) -> Iterator[DataFrame]:
    """``rows`` cached for an iterative fit, dealt by a hash of their key and in the order of the key.

    The key is the customer, or the vector ``x`` where there is none, so neither the layout nor the order of the input
    matters.
    """
    key = F.col("customer_id") if "customer_id" in rows.columns else vector_to_array("x")
    cached = rows.repartition(partitions, key).sortWithinPartitions(key).cache()
    try:
        yield cached
    finally:
        cached.unpersist()


def class_weights(df: DataFrame, label: str = "churn") -> DataFrame:
    """Balanced weight per class: rows / (classes * rows of the class)."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    everything = Window.partitionBy()  # one row per class
    weight = F.sum("n").over(everything) / (F.count(F.lit(1)).over(everything) * F.col("n"))
    return counts.select(label, "n", weight.alias("weight"))

