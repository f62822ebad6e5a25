"""Exact order statistics without an unbounded one-task sort.

A window without PARTITION BY moves the whole table into one task, and an
exact percentile aggregate keeps all values of a group in one buffer. Here a
column is first reduced to (value, count), and that table is written and cut
into ordered buckets whose number is bounded. Values are ordered inside
buckets, and only the per-bucket totals meet in one task, at every size.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from custlens.functions.joins import HOT_KEYS, lookup_join
from custlens.functions.stages import written

BUCKETS_PER_E = 1024.0

#: Groups are counted by a hash of their key into this many cells. A cell is heavy from 1/2000 of all rows, if that is
#: more than a task sorts with ease.
CELLS = 1 << 14
CELL_ROWS = 1 << 17


def heavy_cells(rows: DataFrame, keys: Sequence[str], cells: int = CELLS, least: int = CELL_ROWS) -> Column | None:
    """Whether a row's keys fall into a cell with a large share of all rows: at most 2000 cells, in one narrow pass.

    None if there is no such cell. The keys of every other cell together have fewer rows than that share, or than ``least``, and may meet in one task.
    """
    cell = F.pmod(F.xxhash64(*keys), F.lit(cells))
    sizes = rows.groupBy(cell.alias("cell")).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy())  # one row per cell
    large = sizes.withColumn("total", total).filter((F.col("n") > least) & (F.col("n") * F.lit(HOT_KEYS) >= F.col("total")))
    found = [r["cell"] for r in large.select("cell").collect()]
    return cell.isin(found) if found else None


def value_bucket(x: Column) -> Column:
    """A monotone bucket number of a double.

    Spark's ``log`` is StrictMath, hence equal on all executors. Money up to a
    billion spans about 21,000 buckets; all doubles together 1.5 million.
    """
    size = F.floor(F.log(F.abs(x) + 1.0) * BUCKETS_PER_E)
    return F.when(x >= 0, size).otherwise(-size - 1)


def cumulative_counts(
    df: DataFrame,
    value: Column | str,
    by: Sequence[str] = (),
    sums: dict[str, Column] | None = None,
    keep_buckets: Column | None = None,
) -> DataFrame:
    """One row per distinct non-null value with ``n`` rows of it, ``below``
    smaller ones and ``total`` in its group. ``sums`` adds per-value sums.

    ``keep_buckets`` is a condition over ``before``, ``bucket_n`` and ``total``
    that drops buckets before their values are ordered.
    """
    value = F.col(value) if isinstance(value, str) else value
    by = list(by)
    sums = sums or {}
    rows = df.select(*by, value.cast("double").alias("value"), *[c.alias(k) for k, c in sums.items()])
    present = F.col("value").isNotNull() & ~F.isnan("value")
    for key in by:
        present = present & F.col(key).isNotNull()
    counts = written(
        rows.filter(present).groupBy(*by, "value").agg(F.count(F.lit(1)).alias("n"), *[F.sum(k).alias(k) for k in sums]),
        "value_counts",
    )
    running = lambda w: w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    group = Window.partitionBy(*by)
    counts = counts.withColumn("bucket", value_bucket(F.col("value")))
    totals = (
        counts.groupBy(*by, "bucket")
        .agg(F.sum("n").alias("bucket_n"))
        .withColumn("before", F.sum("bucket_n").over(running(group.orderBy("bucket"))) - F.col("bucket_n"))
        .withColumn("total", F.sum("bucket_n").over(group))
    )
    if keep_buckets is not None:
        totals = totals.filter(keep_buckets)
    inside = running(Window.partitionBy(*by, "bucket").orderBy("value"))
    return (
        counts.join(totals, [*by, "bucket"])
        .withColumn("below", F.col("before") + F.sum("n").over(inside) - F.col("n"))
        .select(*by, "value", "n", "below", "total", *sums)
    )


def _counts_of_small_groups(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """What :func:`cumulative_counts` gives, for groups of which each may meet in one task: one shuffle, by group."""
    group = Window.partitionBy(*by)
    counts = rows.repartition(*by).groupBy(*by, "value").agg(F.count(F.lit(1)).alias("n"))
    upto = group.orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return counts.withColumn("below", F.sum("n").over(upto) - F.col("n")).withColumn("total", F.sum("n").over(group))


def exact_quantiles(
    df: DataFrame, value: Column | str, probs: dict[str, float], by: Sequence[str] = (), many_groups: bool = False
) -> DataFrame:
    """Linear-interpolation quantiles and the ``total`` of values, one row per
    group, one column per name.

    Only buckets that hold a wanted rank are ordered. With ``many_groups`` a
    group is ordered in one task, unless it may have a large share of all rows:
    with few rows in a group nearly every value has its own bucket, and the
    buckets cost more than the values.
    """
    def ranks(p: float) -> tuple[Column, Column, Column]:
        position = (F.col("total") - 1).cast("double") * F.lit(float(p))
        low = F.floor(position)
        return position, low, F.ceil(position)

    wanted = F.lit(False)
    for p in probs.values():
        _, low, high = ranks(p)
        wanted = wanted | (
            (F.col("before") <= high) & (low < F.col("before") + F.col("bucket_n"))
        )

    def value_at(rank: Column) -> Column:
        hit = (F.col("below") <= rank) & (rank < F.col("below") + F.col("n"))
        return F.max(F.when(hit, F.col("value")))

    aggs, outs = [F.max("total").alias("total")], []
    for name, p in probs.items():
        position, low, high = ranks(p)
        aggs += [value_at(low).alias(f"{name}_lo"), value_at(high).alias(f"{name}_hi")]
        t = position - low.cast("double")
        lo, hi = F.col(f"{name}_lo"), F.col(f"{name}_hi")
        mix = (
            (lo + hi) / 2.0 if p == 0.5 else
            F.when(t >= 0.5, hi - (hi - lo) * (1.0 - t)).otherwise(lo + (hi - lo) * t)
        )
        outs.append(F.when(t == 0, lo).otherwise(mix).alias(name))

    def at_ranks(cdf: DataFrame) -> DataFrame:
        return cdf.groupBy(*by).agg(*aggs).select(*by, *outs, "total")

    if not many_groups:
        return at_ranks(cumulative_counts(df, value, by, keep_buckets=wanted))
    value = F.col(value) if isinstance(value, str) else value
    rows = df.select(*by, value.cast("double").alias("value"))
    present = F.col("value").isNotNull() & ~F.isnan("value")
    for key in by:
        present = present & F.col(key).isNotNull()
    rows = rows.filter(present)
    heavy = heavy_cells(rows, by)
    if heavy is None:
        return at_ranks(_counts_of_small_groups(rows, by))
    small = at_ranks(_counts_of_small_groups(rows.filter(~heavy), by))
    return small.unionByName(at_ranks(cumulative_counts(rows.filter(heavy), "value", by, keep_buckets=wanted)))


def average_percent_ranks(df: DataFrame, key: str, measures: dict[str, Column]) -> DataFrame:
    """Adds, per name, the average rank of a measure divided by its non-null count.

    All measures are ranked together in long form, so ``df`` is read twice
    however many there are. Values shared by many rows (one order, no spend)
    are hot join keys; :func:`lookup_join` salts them.
    """
    long = df.select(key, F.inline(F.array(*[
        F.struct(F.lit(name).alias("measure"), x.cast("double").alias("value"))
        for name, x in measures.items()
    ])))
    pct = (F.col("below") + (F.col("n") + 1).cast("double") / 2.0) / F.col("total").cast("double")
    table = cumulative_counts(long, "value", ["measure"]).select("measure", "value", "n", pct.alias("pct"))
    ranked = lookup_join(long, table, ["measure", "value"], weight="n", spread_by=[key])
    wide = ranked.groupBy(key).agg(*[
        F.max(F.when(F.col("measure") == name, F.col("pct"))).alias(name) for name in measures
    ])
    return df.join(wide, key, "left")


def ordered_row_numbers(
    df: DataFrame, bucket: Column, order: Sequence[Column | str], name: str, by: Sequence[str] = ()
) -> DataFrame:
    """``row_number() over (partition by by order by order)`` in parallel.

    ``bucket`` must be monotone in ``order`` and have a bounded number of
    values; rows are ordered inside buckets, buckets by their totals.
    """
    by = list(by)
    rows = df.withColumn("_bucket", bucket)
    upto = (
        Window.partitionBy(*by).orderBy("_bucket")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    offsets = (
        rows.groupBy(*by, "_bucket").agg(F.count(F.lit(1)).alias("_bn"))
        .withColumn("_before", F.sum("_bn").over(upto) - F.col("_bn"))
        .drop("_bn")
    )
    inside = Window.partitionBy(*by, "_bucket").orderBy(*order)
    numbered = rows.withColumn("_rn", F.row_number().over(inside).cast("bigint"))
    return (
        numbered.join(offsets, [*by, "_bucket"])
        .withColumn(name, F.col("_before") + F.col("_rn"))
        .drop("_bucket", "_before", "_rn")
    )
