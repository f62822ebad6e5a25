"""Fixed-length purchase sequences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from custlens.functions.columns import days_between

LENGTH = 6
STEP = ("amount", "gap", "quantity", "is_return")


def _log_scaled(x: Column) -> Column:
    return F.log1p(F.greatest(x.cast("double"), F.lit(0.0))) / 10.0


def purchase_sequences(events: DataFrame, length: int = LENGTH) -> DataFrame:
    """One row per customer: ``sequence``, the last ``length`` orders oldest first,
    zero steps in front.

    Only the last ``length + 1`` orders of a customer pass the first filter.
    Spark applies that limit before the shuffle too, so a customer with very
    many orders sends a few rows per task.
    """
    newest = Window.partitionBy("customer_id").orderBy(F.desc("invoice_date"), F.desc("invoice"))
    last = events.withColumn("_back", F.row_number().over(newest)).filter(F.col("_back") <= length + 1)
    oldest = Window.partitionBy("customer_id").orderBy(F.desc("_back"))
    gap = days_between(F.lag("invoice_date").over(oldest), F.col("invoice_date"))
    steps = last.withColumn("_gap", F.coalesce(F.least(F.greatest(gap, F.lit(0.0)), F.lit(365.0)), F.lit(0.0)))
    step = F.array(
        _log_scaled(F.col("total_amount")), F.col("_gap") / 100.0, _log_scaled(F.col("total_quantity")),
        F.col("is_return").cast("double"),
    )
    found = steps.filter(F.col("_back") <= length).groupBy("customer_id").agg(
        F.array_sort(F.collect_list(F.struct((-F.col("_back")).alias("place"), step.alias("step")))).alias("steps")
    )
    zeros = F.array_repeat(F.array(*[F.lit(0.0)] * len(STEP)), F.lit(length) - F.size("steps"))
    return found.select(
        "customer_id", F.concat(zeros, F.transform("steps", lambda s: s["step"])).alias("sequence")
    )


def sequence_steps(sequences: DataFrame) -> DataFrame:
    """Long form: one row per customer and position (1 = oldest)."""
    return sequences.select("customer_id", F.posexplode("sequence").alias("pos", "step")).select(
        "customer_id", (F.col("pos") + 1).alias("position"),
        *[F.col("step")[i].alias(name) for i, name in enumerate(STEP)],
    )
