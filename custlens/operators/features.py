"""Point-in-time customer features.

Every block takes cleaned lines and a cutoff and returns one row per customer
with a line up to the cutoff. A customer with returns only has null sales
measures here; the merged table turns numeric nulls into 0.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F

from custlens.functions.columns import clip, days_before, days_between, money, ratio, round_even, rounded_exact, timestamp
from custlens.functions.ranking import average_percent_ranks
from custlens.functions.stages import written
from custlens.operators import orders as rollup
from custlens.operators.orders import CATEGORIES

RECENCY_WEIGHT, FREQUENCY_WEIGHT, MONETARY_WEIGHT = 0.35, 0.35, 0.30


def _bounded(lines: DataFrame, cutoff: datetime | None) -> tuple[DataFrame, datetime]:
    if cutoff is None:
        return lines, rollup.latest_date(lines)
    return rollup.upto(lines, cutoff), cutoff


def has_sales() -> Column:
    return F.coalesce(F.col("orders"), F.lit(0)) > 0


def rfm_columns(cutoff: datetime) -> list[Column]:
    sold = has_sales()
    orders = F.when(sold, F.col("orders"))
    recency = F.when(
        sold, F.greatest(F.lit(0.0), days_between(F.col("last_sale"), timestamp(cutoff)))
    )
    spend = money("net_cents")
    products = F.when(sold, F.col("products"))
    return [
        recency.alias("recency_days"),
        orders.alias("frequency"),
        money("gross_cents").alias("gross_spend"),
        spend.alias("total_spend"),
        F.col("items").alias("total_items"),
        products.alias("unique_products_count"),
        round_even(spend / orders, 2).alias("avg_order_value"),
        round_even(F.col("items") / orders, 2).alias("avg_basket_size"),
        round_even(products / orders, 2).alias("avg_unique_products_per_order"),
        round_even(F.log1p(clip(spend, low=0.0)), 4).alias("log_total_spend"),
        round_even(F.log1p(orders.cast("double")), 4).alias("log_frequency"),
    ]


def velocity_columns(cutoff: datetime) -> list[Column]:
    """Not rounded yet, see VELOCITY_DIGITS."""
    n = F.when(has_sales(), F.col("orders")).cast("double")
    tenure = clip(days_between(F.col("first_order"), timestamp(cutoff)), low=1.0)
    span = clip(days_between(F.col("first_order"), F.col("last_order")), low=0.0)
    gaps = n - 1.0
    # Sum of gaps = span; population variance from integer-friendly sums.
    spread = F.greatest(gaps * F.col("gap_squares") - span * span, F.lit(0.0))
    recent = F.when(has_sales(), F.col("recent_orders"))
    pace = recent / F.greatest(n / tenure * 90.0, F.lit(0.1))
    return [
        tenure.alias("tenure_days"),
        span.alias("days_active_span"),
        F.when(n > 1, span / gaps).otherwise(tenure).alias("inter_purchase_mean"),
        F.when(n.isNull(), None).when(gaps > 1, F.sqrt(spread) / gaps).otherwise(0.0).alias("inter_purchase_std"),
        F.when(n.isNotNull(), (n == 1).cast("int")).alias("is_single_order"),
        recent.alias("recent_orders_last_90d"),
        (recent / n).alias("recent_orders_ratio"),
        clip(pace, 0.0, 10.0).alias("velocity_acceleration"),
    ]


VELOCITY_DIGITS = {
    "tenure_days": 1, "days_active_span": 1, "inter_purchase_mean": 2, "inter_purchase_std": 2,
    "recent_orders_ratio": 4, "velocity_acceleration": 4,
}


def behavior_columns(categories: tuple[str, ...] = CATEGORIES) -> list[Column]:
    sold = has_sales()
    gross = money("gross_cents")
    returned = F.abs(money("return_cents"))
    base = F.greatest(gross, F.lit(1.0))
    zero = F.lit(0.0)
    shares = [
        F.when(sold, round_even(F.coalesce(money(f"cat_cents_{c}"), zero) / base, 4)).alias(f"cat_affinity_{c}")
        for c in categories
    ]
    return [
        F.when(sold, F.col("q4_orders") / F.col("orders")).alias("seasonal_q4_order_share"),
        F.when(sold, clip(ratio(F.coalesce(money("q4_cents"), zero), gross), 0.0, 1.0)).alias("seasonal_q4_spend_share"),
        (F.col("return_lines") / F.col("lines")).alias("return_line_rate"),
        F.when(sold, clip(F.coalesce(returned / base, zero), 0.0, 1.0)).otherwise(0.0).alias("return_spend_ratio"),
        (F.col("return_lines") > 0).cast("int").alias("has_returned"),
        F.when(sold, round_even(F.col("discount_lines") / F.col("sale_lines"), 4)).alias("discount_sensitivity"),
        *shares,
    ]


def customer_facts(
    lines: DataFrame, cutoff: datetime, products: bool = True, discounts: bool = True,
    country: bool = True, categories: tuple[str, ...] = CATEGORIES, gaps: bool = True,
) -> DataFrame:
    """The roll-ups the blocks need, joined on the customer they are all partitioned by."""
    facts = rollup.customer_order_facts(lines, cutoff, categories, gaps)
    if products:
        facts = facts.join(rollup.customer_product_facts(lines, discounts), "customer_id", "left")
    if country:
        facts = facts.join(rollup.primary_country(lines), "customer_id", "left")
    return facts


def rfm_features(lines: DataFrame, cutoff: datetime | None = None) -> DataFrame:
    lines, cutoff = _bounded(lines, cutoff)
    facts = customer_facts(lines, cutoff, discounts=False, country=False, gaps=False)
    return facts.select("customer_id", *rfm_columns(cutoff))


def velocity_features(lines: DataFrame, cutoff: datetime | None = None) -> DataFrame:
    """Customers with a sale only."""
    lines, cutoff = _bounded(lines, cutoff)
    facts = customer_facts(lines, cutoff, products=False, country=False)
    return rounded_exact(facts.filter(has_sales()).select("customer_id", *velocity_columns(cutoff)), VELOCITY_DIGITS)


def behavior_features(
    lines: DataFrame, cutoff: datetime | None = None, categories: tuple[str, ...] = CATEGORIES
) -> DataFrame:
    lines, cutoff = _bounded(lines, cutoff)
    facts = customer_facts(lines, cutoff, categories=categories)
    return facts.select("customer_id", *behavior_columns(categories), "primary_country", "is_uk")


def engagement_scores(
    df: DataFrame,
    recency_weight: float = RECENCY_WEIGHT,
    frequency_weight: float = FREQUENCY_WEIGHT,
    monetary_weight: float = MONETARY_WEIGHT,
) -> DataFrame:
    """Adds ``engagement_score`` (0-100) and ``engagement_tier``.

    Each measure ranks among its own non-null values. A customer without sales
    has no score and the tier text ``nan``.
    """
    total = recency_weight + frequency_weight + monetary_weight
    ranked = average_percent_ranks(df, "customer_id", {
        "_r": F.col("recency_days"),
        "_f": F.col("frequency"),
        "_m": clip(F.col("total_spend"), low=0.0),
    })
    score = round_even(
        100.0 * (
            (recency_weight / total) * (1.0 - F.col("_r"))
            + (frequency_weight / total) * F.col("_f")
            + (monetary_weight / total) * F.col("_m")
        ),
        2,
    )
    return (
        ranked.withColumn("engagement_score", score)
        .withColumn("engagement_tier", engagement_tier(F.col("engagement_score")))
        .select(*df.columns, "engagement_score", "engagement_tier")
    )


def engagement_tier(score: Column) -> Column:
    return (
        F.when(score.isNull(), "nan").when(score <= 40.0, "Low").when(score <= 70.0, "Medium").otherwise("High")
    )


def cohort(lines: DataFrame, cutoff: datetime) -> DataFrame:
    """Customers with any line up to the cutoff."""
    return rollup.upto(lines, cutoff).select("customer_id").distinct()


def forward_targets(
    lines: DataFrame, cutoff: datetime, window_days: int = 90, customers: DataFrame | None = None
) -> DataFrame:
    """Labels from the lines in (cutoff, cutoff + window]; every cohort customer is kept."""
    customers = cohort(lines, cutoff) if customers is None else customers
    end = timestamp(cutoff) + F.expr(f"INTERVAL {window_days} DAYS")
    ahead = lines.filter((F.col("invoice_date") > timestamp(cutoff)) & (F.col("invoice_date") <= end))
    orders = ahead.groupBy("customer_id", "invoice").agg(
        F.count_if(~F.col("is_return")).alias("sale_lines"),
        F.sum(F.expr("CAST(rint(total_amount * 100.0D) AS BIGINT)")).alias("cents"),
    )
    totals = orders.groupBy("customer_id").agg(
        F.count_if(F.col("sale_lines") > 0).alias("bought"), F.sum("cents").alias("cents")
    )
    bought = F.coalesce("bought", F.lit(0).cast("bigint"))
    return customers.select("customer_id").join(totals, "customer_id", "left").select(
        "customer_id",
        (bought == 0).cast("int").alias("churn"),
        F.greatest(F.lit(0.0), F.coalesce(money("cents"), F.lit(0.0))).alias("clv_next_90d"),
        bought.alias("target_orders_count"),
    )


FEATURE_DICTIONARY = {
    "recency_days": "Days from the last sale to the cutoff.",
    "frequency": "Distinct sale orders.",
    "total_spend": "Net spend, returns deducted.",
    "gross_spend": "Spend of sale lines.",
    "total_items": "Quantity of sale lines.",
    "unique_products_count": "Distinct products bought.",
    "avg_order_value": "Net spend per order.",
    "avg_basket_size": "Items per order.",
    "avg_unique_products_per_order": "Distinct products per order.",
    "log_total_spend": "log(1 + net spend), negative spend as 0.",
    "log_frequency": "log(1 + orders).",
    "tenure_days": "Days from the first order to the cutoff, at least 1.",
    "days_active_span": "Days from the first to the last order.",
    "inter_purchase_mean": "Mean days between orders; the tenure if there is one order.",
    "inter_purchase_std": "Population standard deviation of the days between orders.",
    "is_single_order": "1 if there is exactly one order.",
    "recent_orders_last_90d": "Orders in the 90 days up to the cutoff.",
    "recent_orders_ratio": "Share of the orders that are recent.",
    "velocity_acceleration": "Recent orders relative to the pace over the tenure, 0 to 10.",
    "seasonal_q4_order_share": "Share of orders in October to December.",
    "seasonal_q4_spend_share": "Share of gross spend in October to December.",
    "return_line_rate": "Share of lines that are returns.",
    "return_spend_ratio": "Returned amount relative to gross spend, 0 to 1.",
    "has_returned": "1 if there is a return.",
    "discount_sensitivity": "Share of sale lines over 10 % below the product's median price.",
    **{f"cat_affinity_{c}": f"Share of gross spend in stock codes {c}..." for c in CATEGORIES},
    "primary_country": "Most frequent country.",
    "is_uk": "1 if the primary country is the United Kingdom.",
    "engagement_score": "Weighted percent ranks of recency, orders and spend, 0 to 100.",
    "engagement_tier": "Low up to 40, Medium up to 70, High above.",
    "churn": "Label: 1 if no sale follows within the window.",
    "clv_next_90d": "Label: net spend in the window, at least 0.",
    "target_orders_count": "Sale orders in the window.",
}


def customer_features(
    lines: DataFrame, cutoff: datetime | None = None, window_days: int = 90
) -> DataFrame:
    """All feature blocks and labels, one row per cohort customer."""
    if cutoff is None:
        last = rollup.latest_date(lines)
        if last is None:
            raise ValueError("no transactions")
        cutoff = days_before(last, window_days)
    observed = rollup.upto(lines, cutoff)
    facts = customer_facts(observed, cutoff)
    blocks = facts.select(
        "customer_id", *rfm_columns(cutoff), *velocity_columns(cutoff), *behavior_columns(),
        "primary_country", "is_uk",
    )
    # Ranks read the blocks several times; the lines behind them only once.
    blocks = written(rounded_exact(blocks, VELOCITY_DIGITS), "feature_blocks")
    scored = engagement_scores(blocks)
    labels = forward_targets(lines, cutoff, window_days, customers=blocks)
    merged = scored.join(labels, "customer_id", "left")
    texts = ("customer_id", "primary_country", "engagement_tier")
    return merged.fillna(0, subset=[c for c in merged.columns if c not in texts])


def check_features(features: DataFrame, cohort_size: int) -> None:
    row = features.agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("churn").isNull()).alias("unlabelled")).first()
    if row.rows != cohort_size:
        raise AssertionError(f"{row.rows} feature rows for a cohort of {cohort_size}")
    if row.unlabelled:
        raise AssertionError(f"{row.unlabelled} customers without a label")
