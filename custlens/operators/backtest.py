"""Customer features and labels at many cutoffs from one pass over the lines.

All cutoffs, the starts of their recent windows and the ends of their label windows are bounds on one time line. A line falls
between two bounds, once, so lines are combined into (customer, interval) states before any cutoff is looked at; running sums
over a customer's few intervals then hold what a separate run would find at each bound, and windows are differences of two of
them. The work on lines does not grow with the cutoffs; a customer has three states per cutoff at most.

What needs a whole table at each cutoff is not among the columns: the median price of a product (``discount_sensitivity``), the
most frequent country and the ranks behind the engagement score. :func:`customer_features` gives them for one cutoff.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window, functions as F

from custlens.functions.columns import cents, days_between, money, rounded_exact, timestamp
from custlens.functions.stages import written
from custlens.operators.features import VELOCITY_DIGITS, behavior_columns, rfm_columns, velocity_columns
from custlens.operators.orders import CATEGORIES, RECENT_DAYS, sale

SUMS = ("lines", "return_lines", "net_cents", "gross_cents", "return_cents", "q4_cents", "items", *[f"cat_cents_{c}" for c in CATEGORIES])
COUNTS = ("orders", "q4_orders", "products")
NO_TABLE = ("discount_sensitivity",)


def interval_of(at: Column, bounds: Sequence[datetime]) -> Column:
    """How many bounds lie before ``at``; a time is at or before bound k if its interval is at most k."""
    return F.size(F.filter(F.array(*[timestamp(b) for b in bounds]), lambda b: b < at))


def order_parts(lines: DataFrame, bounds: Sequence[datetime]) -> DataFrame:
    """One row per customer, invoice and interval, with the interval of the invoice's sales before it, if any."""
    amount, q4 = cents("total_amount"), F.month("invoice_date").isin(10, 11, 12)
    prefix = F.substring("stock_code", 1, 2)
    total = lambda x, *conditions: F.sum(F.when(_all(*conditions), x))
    parts = lines.withColumn("interval", interval_of(F.col("invoice_date"), bounds)).groupBy("customer_id", "invoice", "interval").agg(
        F.min("invoice_date").alias("first_line"), F.min(F.when(sale(), F.col("invoice_date"))).alias("order_date"),
        F.max(F.when(sale(), F.col("invoice_date"))).alias("last_sale"), F.count(F.lit(1)).alias("lines"),
        F.count_if("is_return").alias("return_lines"), F.count_if(sale() & q4).alias("q4_lines"), F.sum(amount).alias("net_cents"),
        total(amount, sale()).alias("gross_cents"), total(amount, F.col("is_return")).alias("return_cents"),
        total(amount, sale(), q4).alias("q4_cents"), total(F.col("quantity"), sale()).alias("items"),
        *[total(amount, sale(), prefix == c).alias(f"cat_cents_{c}") for c in CATEGORIES])
    before = Window.partitionBy("customer_id", "invoice").orderBy("interval").rowsBetween(Window.unboundedPreceding, -1)  # one invoice
    return parts.withColumns({
        "earlier": F.max(F.when(F.col("order_date").isNotNull(), F.col("interval"))).over(before),
        "earlier_q4": F.max(F.when(F.col("q4_lines") > 0, F.col("interval"))).over(before),
    })


def _all(*conditions: Column) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def interval_states(parts: DataFrame, lines: DataFrame, bounds: Sequence[datetime]) -> DataFrame:
    """One row per customer and interval: sums, new orders and products, and the squares of the gaps that end in it.

    Gaps need neighbouring orders: they are taken inside a customer's day and interval, and from one such part to the next.
    """
    is_order = F.col("order_date").isNotNull() & F.col("earlier").isNull()
    placed = F.when(is_order, F.col("order_date"))
    inside = Window.partitionBy("customer_id", "interval", "day").orderBy("placed")
    gap = days_between(F.lag("placed").over(inside), F.col("placed"))
    by_day = (
        parts.withColumn("placed", placed).withColumn("day", F.to_date(F.coalesce("placed", "first_line"))).withColumn("gap", gap)
        .groupBy("customer_id", "interval", "day").agg(
            F.count("placed").alias("orders"), F.count_if((F.col("q4_lines") > 0) & F.col("earlier_q4").isNull()).alias("q4_orders"),
            F.min("placed").alias("first_order"), F.max("placed").alias("last_order"), F.max("last_sale").alias("last_sale"),
            F.sum(F.col("gap") * F.col("gap")).alias("gap_squares"), *[F.sum(s).alias(s) for s in SUMS]))
    across = Window.partitionBy("customer_id").orderBy("interval", "day").rowsBetween(Window.unboundedPreceding, -1)
    jump = days_between(F.last("last_order", ignorenulls=True).over(across), F.col("first_order"))
    states = by_day.withColumn("jump", jump).groupBy("customer_id", "interval").agg(
        F.sum("orders").alias("orders"), F.sum("q4_orders").alias("q4_orders"), F.min("first_order").alias("first_order"),
        F.max("last_order").alias("last_order"), F.max("last_sale").alias("last_sale"),
        (F.coalesce(F.sum("gap_squares"), F.lit(0.0)) + F.coalesce(F.sum(F.col("jump") * F.col("jump")), F.lit(0.0))).alias("gap_squares"),
        *[F.sum(s).alias(s) for s in SUMS])
    firsts = lines.filter(sale() & F.col("stock_code").isNotNull()).groupBy("customer_id", "stock_code").agg(F.min("invoice_date").alias("at"))
    products = firsts.groupBy("customer_id", interval_of(F.col("at"), bounds).alias("interval")).agg(F.count(F.lit(1)).alias("products"))
    return states.join(products, ["customer_id", "interval"], "left")


def backtest(lines: DataFrame, cutoffs: Sequence[datetime], window_days: int = 90) -> DataFrame:
    """Features and labels of every customer with a line up to the cutoff, for every cutoff: one row per cutoff and customer.

    The columns are those of separate runs at each cutoff; customers without sales have 0 in the numeric ones, as there.
    """
    if not cutoffs:
        raise ValueError("no cutoffs")
    cutoffs = sorted(set(cutoffs))
    moment = timedelta(microseconds=1)
    roles = {c: (c - timedelta(days=RECENT_DAYS) - moment, c, c + timedelta(days=window_days)) for c in cutoffs}
    bounds = sorted({b for three in roles.values() for b in three})
    nr = {b: k for k, b in enumerate(bounds)}
    lines = lines.filter(F.col("invoice_date") <= timestamp(bounds[-1]))
    # both are read several times; the lines behind them are combined once
    parts = written(order_parts(lines, bounds), "order_parts")
    states = written(interval_states(parts, lines, bounds), "interval_states")

    # running values at every bound: one empty state per bound, behind the state of its interval
    spark = lines.sparkSession
    marks = states.select("customer_id").distinct().withColumn("interval", F.explode(F.sequence(F.lit(0), F.lit(len(bounds) - 1))))
    every = states.withColumn("mark", F.lit(False)).unionByName(marks.withColumn("mark", F.lit(True)), allowMissingColumns=True)
    so_far = Window.partitionBy("customer_id").orderBy("interval", "mark").rowsBetween(Window.unboundedPreceding, 0)
    numbers = [*SUMS, *COUNTS, "gap_squares"]
    running = every.select(
        "customer_id", "interval", "mark", *[F.sum(c).over(so_far).alias(c) for c in numbers], F.min("first_order").over(so_far).alias("first_order"),
        F.max("last_order").over(so_far).alias("last_order"), F.max("last_sale").over(so_far).alias("last_sale")).filter("mark")

    # each cutoff takes three bounds
    table = spark.createDataFrame(
        [(nr[b], c, role) for c, three in roles.items() for role, b in zip(("low", "at", "high"), three)], "interval int, cutoff timestamp_ntz, role string")
    met = running.join(F.broadcast(table), "interval")
    at = lambda c: F.max(F.when(F.col("role") == "at", F.col(c)))
    other = lambda role, c: F.coalesce(F.max(F.when(F.col("role") == role, F.col(c))), F.lit(0))
    facts = met.groupBy("customer_id", "cutoff").agg(
        *[at(c).alias(c) for c in (*numbers, "first_order", "last_order", "last_sale")], other("low", "orders").alias("orders_low"),
        other("high", "orders").alias("orders_high"), other("high", "net_cents").alias("net_high"))
    facts = facts.filter("lines > 0").withColumn("recent_orders", F.col("orders") - F.col("orders_low"))

    # invoices with sales on both sides of a cutoff: they are orders of the label window, too
    spans = F.array(*[F.struct(timestamp(c).alias("cutoff"), F.lit(nr[three[1]]).alias("at"), F.lit(nr[three[2]]).alias("high")) for c, three in roles.items()])
    again = parts.filter("earlier is not null and order_date is not null").select("customer_id", F.explode(F.filter(
        spans, lambda s: (F.col("earlier") <= s["at"]) & (s["at"] < F.col("interval")) & (F.col("interval") <= s["high"]))).alias("s"))
    again = again.groupBy("customer_id", F.col("s.cutoff").alias("cutoff")).agg(F.count(F.lit(1)).alias("again"))
    facts = facts.join(again, ["customer_id", "cutoff"], "left")
    ahead = F.col("orders_high") - F.col("orders") + F.coalesce("again", F.lit(0))
    spend = F.coalesce(F.col("net_high") - F.col("net_cents"), F.lit(0))
    blank = {c: F.lit(None).cast("bigint") for c in ("discount_lines", "sale_lines")}
    when = F.col("cutoff")
    rows = facts.withColumns(blank).select(
        "cutoff", "customer_id", *rfm_columns(when), *velocity_columns(when), *behavior_columns(), (ahead == 0).cast("int").alias("churn"),
        F.greatest(F.lit(0.0), money(spend)).alias("clv_next_90d"), ahead.cast("bigint").alias("target_orders_count")).drop(*NO_TABLE)
    rows = rounded_exact(rows, VELOCITY_DIGITS)
    return rows.fillna(0, subset=[c for c in rows.columns if c not in ("cutoff", "customer_id")])
