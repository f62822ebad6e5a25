"""Roll-ups of invoice lines: per order, per customer.

Lines meet in their order first, those of an order with a large share of all
lines combined map-side, and orders are combined into days before the second
shuffle. A customer with a large share of all lines therefore never arrives as
one big group.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window, functions as F

from custlens.functions.columns import cents, days_between, timestamp
from custlens.functions.joins import lookup_join
from custlens.functions.ranking import exact_quantiles, heavy_cells

# Two-character stock-code prefixes whose spend share is tracked.
CATEGORIES = ("22", "21", "85", "84", "23", "20")
RECENT_DAYS = 90


def upto(lines: DataFrame, cutoff: datetime | None) -> DataFrame:
    return lines if cutoff is None else lines.filter(F.col("invoice_date") <= timestamp(cutoff))


def latest_date(lines: DataFrame) -> datetime:
    """The last invoice date: one value, used as a literal so that it reaches scans."""
    return lines.agg(F.max("invoice_date")).first()[0]


def sale() -> Column:
    return ~F.col("is_return")


def order_table(lines: DataFrame) -> DataFrame:
    """Distinct sale orders with the time of their first line."""
    return (
        lines.filter(sale()).groupBy("customer_id", "invoice")
        .agg(F.min("invoice_date").alias("order_date"))
    )


def order_events(lines: DataFrame) -> DataFrame:
    """All orders, returns included: first time, net amount, quantity, any return."""
    return lines.groupBy("customer_id", "invoice").agg(
        F.min("invoice_date").alias("invoice_date"),
        F.sum(cents("total_amount")).alias("cents"),
        F.sum("quantity").alias("total_quantity"),
        F.max("is_return").alias("is_return"),
    ).select(
        "customer_id", "invoice", "invoice_date",
        (F.col("cents") / 100.0).alias("total_amount"), "total_quantity", "is_return",
    )


def order_totals(lines: DataFrame, categories: tuple[str, ...] = CATEGORIES, all_sums: bool = True) -> DataFrame:
    """One row per (customer, invoice) with everything the customer features sum up.

    All sums together are wider than a line, and a task holds few lines of an order, so the lines go to their order, and only
    orders that may have a large share of all lines are summed up before. With ``all_sums`` off, for a few of the sums, all
    orders are.
    """
    narrow = lines.select(
        "customer_id", "invoice", "invoice_date", "is_return", "quantity",
        cents("total_amount").alias("amount"), F.substring("stock_code", 1, 2).alias("prefix"),
    )
    amount, prefix = F.col("amount"), F.col("prefix")
    q4 = F.month("invoice_date").isin(10, 11, 12)

    def sale_sum(x: Column, cond: Column | None = None) -> Column:
        return F.sum(F.when(sale() if cond is None else sale() & cond, x))

    def totals(part: DataFrame) -> DataFrame:
        return part.groupBy("customer_id", "invoice").agg(
            F.min("invoice_date").alias("first_line"),
            F.min(F.when(sale(), F.col("invoice_date"))).alias("order_date"),
            F.max(F.when(sale(), F.col("invoice_date"))).alias("last_sale"),
            F.count(F.lit(1)).alias("lines"),
            F.count_if("is_return").alias("return_lines"),
            F.count_if(sale() & q4).alias("q4_lines"),
            F.sum(amount).alias("net_cents"),
            sale_sum(amount).alias("gross_cents"),
            F.sum(F.when(F.col("is_return"), amount)).alias("return_cents"),
            sale_sum(amount, q4).alias("q4_cents"),
            sale_sum(F.col("quantity")).alias("items"),
            *[sale_sum(amount, prefix == c).alias(f"cat_cents_{c}") for c in categories],
        )

    if not all_sums:
        return totals(narrow)
    order = ("customer_id", "invoice")
    heavy = heavy_cells(narrow, order)
    if heavy is None:
        return totals(narrow.repartition(*order))
    return totals(narrow.filter(~heavy).repartition(*order)).unionByName(totals(narrow.filter(heavy)))


def customer_order_facts(
    lines: DataFrame, cutoff: datetime, categories: tuple[str, ...] = CATEGORIES, gaps: bool = True
) -> DataFrame:
    """One row per customer: sums over orders, and the gaps between them if wanted.

    Without gaps, orders merge into customers at once. Gaps need neighbouring orders. They are taken inside each (customer, day)
    and between a customer's consecutive days, so no window holds more than
    one day of orders or one row per day of history.
    """
    sums = [
        "lines", "return_lines", "net_cents", "gross_cents", "return_cents", "q4_cents", "items",
        *[f"cat_cents_{c}" for c in categories],
    ]
    recent = timestamp(cutoff) - F.expr(f"INTERVAL {RECENT_DAYS} DAYS")
    orders = order_totals(lines, categories, all_sums=gaps)
    from_orders = {
        "orders": F.count("order_date"),
        "q4_orders": F.count_if(F.col("q4_lines") > 0),
        "recent_orders": F.count_if(F.col("order_date") >= recent),
        "first_order": F.min("order_date"),
        "last_order": F.max("order_date"),
        "last_sale": F.max("last_sale"),
        **{s: F.sum(s) for s in sums},
    }
    if not gaps:
        return orders.groupBy("customer_id").agg(*[x.alias(name) for name, x in from_orders.items()])
    in_day = Window.partitionBy("customer_id", "day").orderBy("order_date")
    gap = days_between(F.lag("order_date").over(in_day), F.col("order_date"))
    per_day = (
        orders.withColumn("day", F.to_date(F.coalesce("order_date", "first_line")))
        .withColumn("gap", gap)
        .groupBy("customer_id", "day")
        .agg(*[x.alias(name) for name, x in from_orders.items()],
             F.sum(F.col("gap") * F.col("gap")).alias("gap_squares"))
    )
    # Days with returns only have no order; the last one before them counts.
    across = (
        Window.partitionBy("customer_id").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    )
    before = F.last("last_order", ignorenulls=True).over(across)
    jump = days_between(before, F.col("first_order"))
    added = ("orders", "q4_orders", "recent_orders", *sums)
    return (
        per_day.withColumn("jump", jump)
        .groupBy("customer_id")
        .agg(
            *[F.sum(x).alias(x) for x in added],
            F.min("first_order").alias("first_order"),
            F.max("last_order").alias("last_order"),
            F.max("last_sale").alias("last_sale"),
            (F.coalesce(F.sum("gap_squares"), F.lit(0.0))
             + F.coalesce(F.sum(F.col("jump") * F.col("jump")), F.lit(0.0))).alias("gap_squares"),
        )
    )


def product_reference_prices(lines: DataFrame) -> DataFrame:
    """Median sale price per product, and its number of sale lines."""
    sales = lines.filter(sale() & F.col("stock_code").isNotNull())
    median = exact_quantiles(sales, "price", {"reference_price": 0.5}, by=["stock_code"], many_groups=True)
    return median.withColumnRenamed("total", "sale_lines")


def customer_product_facts(lines: DataFrame, with_discounts: bool = True) -> DataFrame:
    """Distinct products, sale lines, and lines over 10 % below the product's median price."""
    sales = lines.filter(sale()).select("customer_id", "invoice", "stock_code", "price", "quantity")
    if with_discounts:
        prices = product_reference_prices(lines)
        sales = lookup_join(
            sales, prices, ["stock_code"], "sale_lines", spread_by=["customer_id", "invoice", "quantity", "price"]
        )
        cheap = F.coalesce(F.col("price") < F.col("reference_price") * 0.90, F.lit(False))
    else:
        cheap = F.lit(False)
    per_product = sales.groupBy("customer_id", "stock_code").agg(
        F.count(F.lit(1)).alias("sale_lines"), F.count_if(cheap).alias("discount_lines")
    )
    return per_product.groupBy("customer_id").agg(
        F.count("stock_code").alias("products"),
        F.sum("sale_lines").alias("sale_lines"),
        F.sum("discount_lines").alias("discount_lines"),
    )


def primary_country(lines: DataFrame) -> DataFrame:
    """Most frequent country over all lines of a customer; ties by alphabet."""
    counts = lines.filter(F.col("country").isNotNull()).groupBy("customer_id", "country").agg(
        F.count(F.lit(1)).alias("n")
    )
    best = F.min(F.struct((-F.col("n")).alias("rank"), F.col("country")))["country"]
    return counts.groupBy("customer_id").agg(best.alias("primary_country")).withColumn(
        "is_uk", (F.col("primary_country") == "United Kingdom").cast("int")
    )
