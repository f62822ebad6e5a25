"""Exploratory aggregates over cleaned lines and customer features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from custlens.functions.columns import cents, days_between, round_even
from custlens.functions.ranking import exact_quantiles
from custlens.functions.stages import written
from custlens.operators.orders import sale


def _total(x: str) -> Column:
    """A table-wide sum of whole cents as money."""
    return F.sum(F.col(x).cast("decimal(38,0)")).cast("double") / 100.0


def _order_sums(lines: DataFrame, period: Column) -> DataFrame:
    return lines.groupBy(period, "customer_id", "invoice").agg(F.sum(cents("total_amount")).alias("cents"))


def monthly_sales(lines: DataFrame) -> DataFrame:
    """Sales by month: revenue, distinct orders, distinct customers."""
    orders = _order_sums(lines.filter(sale()), F.substring(F.to_date("invoice_date").cast("string"), 1, 7).alias("year_month"))
    return orders.groupBy("year_month").agg(
        _total("cents").alias("revenue"),
        F.count_distinct("invoice").alias("order_count"),
        F.count_distinct("customer_id").alias("active_customers"),
    )


def monthly_net(lines: DataFrame) -> DataFrame:
    """Net revenue by month start, returns included."""
    month = F.trunc("invoice_date", "month").cast("timestamp_ntz").alias("month")
    return _order_sums(lines, month).groupBy("month").agg(
        _total("cents").alias("total_revenue"), F.count_distinct("customer_id").alias("active_customers")
    )


def country_revenue(lines: DataFrame) -> DataFrame:
    return (
        lines.filter(sale()).groupBy("country")
        .agg(F.sum(cents("total_amount").cast("decimal(38,0)")).alias("cents"))
        .select("country", (F.col("cents").cast("double") / 100.0).alias("revenue"))
    )


def top_countries(lines: DataFrame, limit: int = 10) -> DataFrame:
    return country_revenue(lines).orderBy(F.desc("revenue"), "country").limit(limit)


def domestic_share(lines: DataFrame, home: str = "United Kingdom") -> DataFrame:
    amount = cents("total_amount").cast("decimal(38,0)")
    sums = lines.filter(sale()).agg(
        F.sum(F.when(F.col("country") == home, amount).otherwise(F.lit(0))).cast("double").alias("home"),
        F.sum(amount).cast("double").alias("all"),
    )
    return sums.select(F.when(F.col("all") != 0, F.col("home") / F.col("all")).alias("uk_revenue_share"))


def simple_rfm(lines: DataFrame) -> DataFrame:
    """Whole days since the last sale (to the last date of all lines), orders, spend."""
    last = lines.agg(F.max("invoice_date").alias("last")).scalar()
    orders = lines.filter(sale()).groupBy("customer_id", "invoice").agg(
        F.max("invoice_date").alias("last"), F.sum(cents("total_amount")).alias("cents")
    )
    return orders.groupBy("customer_id").agg(
        F.max("last").alias("last"), F.count("invoice").alias("frequency"), F.sum("cents").alias("cents")
    ).select(
        "customer_id",
        F.floor(days_between(F.col("last"), last)).alias("recency"),
        "frequency",
        (F.col("cents") / 100.0).alias("monetary"),
    )


def histogram(df: DataFrame, value: str, bins: int) -> DataFrame:
    """Equal-width bins between minimum and maximum, the last one closed.

    A single value gets a range of one around it. Empty bins are absent.
    """
    x = F.col(value).cast("double")
    limits = df.agg(F.min(x).alias("lo"), F.max(x).alias("hi"))
    span = limits.select(
        F.when(F.col("lo") == F.col("hi"), F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"),
        F.when(F.col("lo") == F.col("hi"), F.col("hi") + 0.5).otherwise(F.col("hi")).alias("hi"),
    )
    lo, hi = span.select("lo").scalar(), span.select("hi").scalar()
    place = F.floor((x - lo) / (hi - lo) * float(bins))
    return (
        df.filter(x.isNotNull())
        .groupBy(F.least(place, F.lit(bins - 1)).cast("int").alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.lit(value).alias("measure"), "bin", "n")
    )


def customer_return_rates(lines: DataFrame) -> DataFrame:
    return lines.groupBy("customer_id").agg(
        F.avg(F.col("is_return").cast("double")).alias("return_rate")
    )


HISTOGRAM_BINS = {"recency": 40, "frequency": 40, "log_spend": 40, "return_rate": 30}


def eda_histograms(lines: DataFrame) -> DataFrame:
    """40 bins of recency, orders and log spend, 30 of the return rate, as :func:`histogram` makes them.

    The customers' values are written once in long form; one aggregate gives all limits, another all counts.
    """
    rfm = simple_rfm(lines).withColumn("log_spend", F.log1p(F.greatest("monetary", F.lit(0.0))))
    long = rfm.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("measure"), F.col(c).cast("double").alias("value")) for c in HISTOGRAM_BINS if c != "return_rate"
    ]))).unionByName(customer_return_rates(lines).select(F.lit("return_rate").alias("measure"), F.col("return_rate").alias("value")))
    long = written(long.filter(F.col("value").isNotNull()), "customer_values")
    bins = F.lit(0)
    for name, n in HISTOGRAM_BINS.items():
        bins = F.when(F.col("measure") == name, n).otherwise(bins)
    limits = long.groupBy("measure").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    one = F.col("lo") == F.col("hi")
    limits = limits.select(
        "measure", F.when(one, F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"),
        F.when(one, F.col("hi") + 0.5).otherwise(F.col("hi")).alias("hi"), bins.alias("bins"))
    place = F.floor((F.col("value") - F.col("lo")) / (F.col("hi") - F.col("lo")) * F.col("bins").cast("double"))
    return (
        long.join(F.broadcast(limits), "measure")  # four rows
        .groupBy("measure", F.least(place, F.col("bins") - 1).cast("int").alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def findings(lines: DataFrame) -> DataFrame:
    """One row: customers, median and mean of recency, orders and spend, domestic share."""
    names = {"recency": "recency_days", "frequency": "frequency_orders", "monetary": "spend"}
    # one row per customer and measure, so that the lines are rolled up once for all of them
    long = written(simple_rfm(lines).select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("measure"), F.col(c).cast("double").alias("value")) for c in names
    ]))), "rfm_measures")
    medians = exact_quantiles(long, "value", {"median": 0.5}, by=["measure"]).select("measure", "median")
    means = long.groupBy("measure").agg(
        F.count(F.lit(1)).alias("rows"),
        (F.sum(cents("value").cast("decimal(38,0)")).cast("double") / 100.0 / F.count("value")).alias("mean"))
    both = means.join(medians, "measure", "left")  # three rows
    def of(source: str, column: str) -> Column:
        return F.max(F.when(F.col("measure") == source, F.col(column)))

    columns = [F.max("rows").alias("total_active_customers")]
    for source, name in names.items():
        columns += [of(source, "median").alias(f"median_{name}"), of(source, "mean").alias(f"mean_{name}")]
    share = domestic_share(lines).scalar()
    return both.agg(*columns, F.first(share).alias("uk_revenue_share"))


def returner_share(lines: DataFrame) -> DataFrame:
    per_customer = lines.groupBy("customer_id").agg(F.max("is_return").alias("returned"))
    return per_customer.agg(F.avg(F.col("returned").cast("double")).alias("returner_share"))


def class_balance(features: DataFrame, label: str = "churn") -> DataFrame:
    counts = features.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("t")).scalar()  # over the few label values
    return counts.select(label, "n", (F.col("n") / total).alias("share"))


def target_correlations(features: DataFrame, columns: list[str], label: str = "churn") -> DataFrame:
    """Pearson correlation of every column with the label, null where one is constant."""
    y = F.col(label).cast("double")
    def correlation(x: Column) -> Column:
        return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))

    pairs = [correlation(F.col(c).cast("double")).alias(c) for c in columns]
    row = features.agg(*pairs)
    return row.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("feature"), round_even(c, 6).alias("correlation")) for c in columns
    ])))


def churn_by_tier(features: DataFrame) -> DataFrame:
    return features.groupBy("engagement_tier").agg(
        F.count(F.lit(1)).alias("customers"), F.avg(F.col("churn").cast("double")).alias("churn_rate")
    )


def cohort_summary(features: DataFrame) -> DataFrame:
    """One row: size, churn, spend ahead and engagement of the cohort."""
    median = exact_quantiles(features, "clv_next_90d", {"m": 0.5}).select("m").scalar()
    whole = lambda c: F.sum(cents(c).cast("decimal(38,0)")).cast("double") / 100.0
    n = F.count(F.lit(1))
    return features.agg(
        n.alias("cohort_size"),
        F.avg(F.col("churn").cast("double")).alias("churn_rate"),
        F.count_if(F.col("churn") == 0).alias("retained_count"),
        F.count_if(F.col("churn") == 1).alias("churned_count"),
        (whole("clv_next_90d") / n).alias("mean_clv_90d"),
        F.first(median).alias("median_clv_90d"),
        F.max("clv_next_90d").alias("max_clv_90d"),
        (whole("engagement_score") / n).alias("mean_engagement_score"),
    )
