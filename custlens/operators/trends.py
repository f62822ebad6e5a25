"""Trends over calendar bins: the slope of a customer's order counts, a revenue forecast, and the next category.

Bins without orders count as zero without being built: with bins numbered 0 to n - 1, all sums over the bins themselves are
closed forms of n, so only the bins that hold something are summed.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window, functions as F

from custlens.functions.columns import cents, timestamp
from custlens.functions.stages import written
from custlens.operators.orders import order_table, sale, upto

BIN_DAYS = 30
ALPHA = 0.3
LEAST_HISTORY = 3
LEAST_SEEN = 5


def frequency_slope(lines: DataFrame, cutoff: datetime, bin_days: int = BIN_DAYS) -> DataFrame:
    """customer_id, bins, orders, slope (orders per bin and bin) by least squares over the bins from the first order to the cutoff.

    Bins count back from the cutoff, so the last one is whole; a customer with one bin has slope 0.
    """
    back = F.floor(F.datediff(F.to_date(timestamp(cutoff)), F.to_date("order_date")) / bin_days).cast("bigint")
    sums = order_table(upto(lines, cutoff)).withColumn("back", back).groupBy("customer_id").agg(
        F.count(F.lit(1)).alias("orders"), F.sum("back").alias("backs"), (F.max("back") + 1).alias("bins"))
    n, y = F.col("bins").cast("double"), F.col("orders").cast("double")
    ty = (n - 1.0) * y - F.col("backs")  # bins numbered forward
    slope = (ty - (n - 1.0) / 2.0 * y) / (n * (n * n - 1.0) / 12.0)
    return sums.select("customer_id", "bins", "orders", F.when(F.col("bins") > 1, slope).otherwise(0.0).alias("slope"))


def monthly_series(lines: DataFrame) -> DataFrame:
    """One row per month from the first to the last with its net revenue in cents; months without lines have 0."""
    months = lines.groupBy(F.trunc("invoice_date", "month").alias("month")).agg(F.sum(cents("total_amount")).alias("cents"))
    span = months.agg(F.min("month").alias("a"), F.max("month").alias("b"))
    every = span.select(F.explode(F.sequence("a", "b", F.expr("interval 1 month"))).alias("month"))
    return every.join(months, "month", "left").select("month", F.coalesce("cents", F.lit(0).cast("bigint")).alias("cents"))


def revenue_forecast(lines: DataFrame, alpha: float = ALPHA, least: int = LEAST_HISTORY) -> DataFrame:
    """One row per month and one for the month behind them: month, revenue, level, forecast, absolute error.

    Simple exponential smoothing as a fold over the months in order (one row per month, so a few hundred). The forecast of a
    month uses the months before it only, so the errors are those of a rolling origin; there is none before ``least`` months.
    """
    series = monthly_series(lines).groupBy().agg(F.sort_array(F.collect_list(F.struct("month", "cents"))).alias("s"))
    step = "struct<month:date,revenue:double,level:double,forecast:double>"
    start = F.array().cast(f"array<{step}>")

    def fold(done: Column, now: Column) -> Column:
        y, last = now["cents"] / 100.0, F.element_at(done, -1)
        first = F.size(done) == 0
        level = F.when(first, y).otherwise(F.lit(alpha) * y + F.lit(1.0 - alpha) * F.when(~first, last["level"]))
        return F.concat(done, F.array(F.struct(
            now["month"].alias("month"), y.alias("revenue"), level.alias("level"), F.when(~first, last["level"]).alias("forecast"))))

    ended = series.where("size(s) > 0").select(F.aggregate("s", start, fold).alias("done"))
    last = F.element_at("done", -1)
    ahead = F.struct(
        F.add_months(last["month"], 1).alias("month"), F.lit(None).cast("double").alias("revenue"), F.lit(None).cast("double").alias("level"),
        last["level"].alias("forecast"))
    rows = ended.select(F.posexplode(F.concat("done", F.array(ahead))).alias("nr", "r"))
    shown = F.when(F.col("nr") >= least, F.col("r.forecast"))
    return rows.select(
        "r.month", "r.revenue", "r.level", shown.alias("forecast"), F.abs(F.col("r.revenue") - shown).alias("abs_error"))


def order_categories(lines: DataFrame) -> DataFrame:
    """customer_id, order_date, invoice, category: the two-character code with most spend in an order, ties by code."""
    prefix = F.substring("stock_code", 1, 2)
    spend = lines.filter(sale() & F.col("stock_code").isNotNull()).groupBy("customer_id", "invoice", prefix.alias("category")).agg(
        F.sum(cents("total_amount")).alias("cents"), F.min("invoice_date").alias("at"))
    best = spend.groupBy("customer_id", "invoice").agg(F.min(F.struct((-F.col("cents")).alias("c"), "category"))["category"].alias("category"), F.min("at").alias("order_date"))
    return best.select("customer_id", "order_date", "invoice", "category")


def next_category(lines: DataFrame, cutoff: datetime, segments: DataFrame, least: int = LEAST_SEEN) -> DataFrame:
    """customer_id, last_category, predicted, source, actual: the category of the next order.

    Transitions from one order's category to the next are counted up to the cutoff for each customer, each segment
    (``segments``: customer_id, segment) and all. A customer's own counts decide if there are at least ``least`` from the last
    category, else the segment's, else all; of equal counts the first code. ``actual`` is that of the first order behind the
    cutoff. Neighbouring orders are found inside a customer's day, and from one day to the next, so no window holds more than
    the orders of one day or one row per day.
    """
    orders = written(order_categories(upto(lines, cutoff)).withColumn("day", F.to_date("order_date")), "order_categories")
    in_day = Window.partitionBy("customer_id", "day").orderBy("order_date", "invoice")
    within = orders.select("customer_id", "category", F.lead("category").over(in_day).alias("next"))
    row = F.struct("order_date", "invoice", "category")
    days = orders.groupBy("customer_id", "day").agg(F.min(row)["category"].alias("first"), F.max(row)["category"].alias("category"))
    across = days.select("customer_id", "category", F.lead("first").over(Window.partitionBy("customer_id").orderBy("day")).alias("next"))
    steps = within.unionByName(across)
    newest = orders.groupBy("customer_id").agg(F.max(F.struct("order_date", "invoice", "category"))["category"].alias("last_category"))
    counts = written(steps.filter("next is not null").groupBy("customer_id", "category", "next").agg(F.count(F.lit(1)).alias("n")), "category_moves")
    of_segment = counts.join(segments, "customer_id").groupBy("segment", "category", "next").agg(F.sum("n").alias("n"))
    of_all = counts.groupBy("category", "next").agg(F.sum("n").alias("n"))

    def best(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
        top = rows.groupBy(*keys, F.col("category").alias("last_category")).agg(
            F.sum("n").alias(f"n_{name}"), F.min(F.struct((-F.col("n")).alias("c"), "next"))["next"].alias(name))
        return top

    actual = order_categories(lines.filter(F.col("invoice_date") > timestamp(cutoff))).groupBy("customer_id").agg(
        F.min(F.struct("order_date", "invoice", "category"))["category"].alias("actual"))
    # categories and segments are few, so the tables of the segments and of all are small; customers merge by their own key
    rows = newest.join(segments, "customer_id", "left").join(best(counts, ["customer_id"], "own"), ["customer_id", "last_category"], "left").join(
        best(of_segment, ["segment"], "segment_best"), ["segment", "last_category"], "left").join(best(of_all, [], "all_best"), ["last_category"], "left")
    own, seg = F.col("n_own") >= least, F.col("n_segment_best") >= least
    return rows.join(actual, "customer_id", "left").select(
        "customer_id", "last_category", F.when(own, F.col("own")).when(seg, F.col("segment_best")).otherwise(F.col("all_best")).alias("predicted"),
        F.when(own, "customer").when(seg, "segment").when(F.col("all_best").isNotNull(), "all").alias("source"), "actual")
