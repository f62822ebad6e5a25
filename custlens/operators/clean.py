"""Cleaning of invoice lines. Each step is DataFrame -> DataFrame."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from custlens.functions.columns import round_even, strip
from custlens.functions.joins import lookup_join
from custlens.functions.ranking import exact_quantiles
from custlens.functions.stages import written

# Administrative stock codes and prefixes.
ADMIN_CODES = ("POST", "D", "M", "PADS", "DOT", "CRUK", "BANK CHARGES", "TEST", "AMAZONFEE")
ADMIN_PREFIXES = ("POST", "BANK", "CRUK")

MIN_PRICE = 0.001
QUANTITY_FLOOR = 5000.0
PRICE_FLOOR = 2000.0

# Lines equal in these are copies; the country does not count.
COPY_KEYS = ("invoice", "stock_code", "description", "quantity", "invoice_date", "price", "customer_id")


def has_customer() -> Column:
    return F.col("customer_id").isNotNull()


def has_valid_price(min_price: float = MIN_PRICE) -> Column:
    return F.coalesce(F.col("price") >= min_price, F.lit(False))


def is_zero_quantity() -> Column:
    """False for a missing quantity, which is kept."""
    return F.col("quantity").eqNullSafe(F.lit(0.0))


def is_return() -> Column:
    cancelled = F.coalesce(strip("invoice").startswith("C"), F.lit(False))
    return cancelled | F.coalesce(F.col("quantity") < 0, F.lit(False))


def is_admin_code(codes: tuple[str, ...] = ADMIN_CODES) -> Column:
    code = F.upper(strip("stock_code"))
    hit = code.isin([c.strip().upper() for c in codes])
    for prefix in ADMIN_PREFIXES:
        hit = hit | code.startswith(prefix)
    return F.coalesce(hit, F.lit(False))


def drop_missing_customers(df: DataFrame) -> DataFrame:
    return df.filter(has_customer()).withColumn("customer_id", F.col("customer_id").cast("bigint"))


def drop_invalid_prices(df: DataFrame, min_price: float = MIN_PRICE) -> DataFrame:
    return df.filter(has_valid_price(min_price))


def drop_zero_quantities(df: DataFrame) -> DataFrame:
    return df.filter(~is_zero_quantity())


def flag_returns(df: DataFrame) -> DataFrame:
    """Marks cancellations and negative quantities; marked quantities become negative."""
    flagged = df.withColumn("is_return", is_return())
    negative = F.col("is_return") & (F.col("quantity") > 0)
    return flagged.withColumn("quantity", F.when(negative, -F.col("quantity")).otherwise(F.col("quantity")))


def drop_admin_codes(df: DataFrame, codes: tuple[str, ...] = ADMIN_CODES) -> DataFrame:
    return df.filter(~is_admin_code(codes))


def drop_copies(df: DataFrame, count_as: str | None = None) -> DataFrame:
    """One line per set of exact copies, with the smallest country.

    An aggregate instead of a row number: copies merge before the shuffle, so
    a line repeated very often costs one row per task.
    """
    aggs = [F.min("country").alias("country")]
    if count_as:
        aggs.append(F.count(F.lit(1)).alias(count_as))
    # is_return follows from the keys; grouping by it keeps the column.
    merged = df.groupBy(*COPY_KEYS, "is_return").agg(*aggs)
    return merged.select(*df.columns, *([count_as] if count_as else []))


def description_modes(df: DataFrame) -> DataFrame:
    """Most frequent clean description (over 2 characters) per stock code, ties by alphabet."""
    spelling = F.upper(strip(F.coalesce("description", F.lit(""))))
    counts = (
        df.filter(F.col("stock_code").isNotNull())
        .groupBy("stock_code", spelling.alias("spelling")).agg(F.count(F.lit(1)).alias("n"))
    )
    candidate = F.when(F.length("spelling") > 2, F.struct((-F.col("n")).alias("rank"), F.col("spelling")))
    return counts.groupBy("stock_code").agg(
        F.min(candidate)["spelling"].alias("mode_description"), F.sum("n").alias("lines")
    )


def standardize_descriptions(df: DataFrame) -> DataFrame:
    """The stock code's most frequent description on every line; the line's own where there is none.

    A line whose own description takes part in the vote gets one, so its own need not travel through the join.
    """
    modes = description_modes(df)
    own = F.upper(strip(F.coalesce("description", F.lit(""))))
    votes = F.col("stock_code").isNotNull() & (F.length(own) > 2)
    return (
        lookup_join(
            df.withColumn("description", F.when(~votes, own)), modes, ["stock_code"], "lines",
            spread_by=["customer_id", "invoice", "quantity", "price", "invoice_date"])
        .withColumn("description", F.coalesce("mode_description", "description"))
        .drop("mode_description")
    )


def add_line_amount(df: DataFrame) -> DataFrame:
    return df.withColumn("total_amount", round_even(F.col("quantity") * F.col("price"), 2))


def outlier_bounds(df: DataFrame, multiplier: float = 5.0) -> DataFrame:
    """One row: caps for quantity and price from the quartiles of the sale lines."""
    floors = {"quantity": QUANTITY_FLOOR, "price": PRICE_FLOOR}
    sales = df.filter(~F.col("is_return")).select(F.inline(F.array(*[
        F.struct(F.lit(name).alias("measure"), F.col(name).cast("double").alias("value")) for name in floors
    ])))
    quartiles = exact_quantiles(sales, "value", {"q1": 0.25, "q3": 0.75}, by=["measure"])
    cap = F.col("q3") + multiplier * (F.col("q3") - F.col("q1"))
    return quartiles.agg(*[
        F.greatest(F.max(F.when(F.col("measure") == name, cap)), F.lit(floor)).alias(f"max_{name}")
        for name, floor in floors.items()
    ])


def is_outlier(bounds: DataFrame) -> Column:
    """Condition with the caps as scalar subqueries; a line without quantity is kept."""
    max_quantity = bounds.select("max_quantity").scalar()
    max_price = bounds.select("max_price").scalar()
    return F.coalesce(F.abs("quantity") > max_quantity, F.lit(False)) | F.coalesce(
        F.col("price") > max_price, F.lit(False)
    )


def drop_outliers(df: DataFrame, multiplier: float = 5.0) -> DataFrame:
    return df.filter(~is_outlier(outlier_bounds(df, multiplier)))


@dataclass
class CleanResult:
    cleaned: DataFrame
    audit: DataFrame


CLEANED_COLUMNS = (
    "invoice", "stock_code", "description", "quantity", "invoice_date", "price",
    "customer_id", "country", "total_amount", "is_return",
)


def clean_transactions(
    df: DataFrame,
    drop_missing: bool = True,
    remove_admin: bool = True,
    cap_outliers: bool = True,
    multiplier: float = 5.0,
) -> CleanResult:
    """All steps in order, and the row counts of each.

    The lines left after the copy step feed the description vote, the
    quartiles and the result, so they are written once instead of being
    shuffled three times.
    """
    valid = drop_missing_customers(df) if drop_missing else df
    valid = flag_returns(drop_zero_quantities(drop_invalid_prices(valid)))
    if remove_admin:
        valid = drop_admin_codes(valid)
    distinct = written(drop_copies(valid, count_as="copies"), "distinct_lines")
    named = add_line_amount(standardize_descriptions(distinct))
    if cap_outliers:
        bounds = written(outlier_bounds(distinct, multiplier), "outlier_bounds")
        outlier = is_outlier(bounds)
    else:
        bounds, outlier = None, F.lit(False)
    cleaned = named.filter(~outlier).select(*CLEANED_COLUMNS)
    return CleanResult(cleaned, cleaning_audit(df, distinct, outlier, drop_missing, remove_admin))


def cleaning_audit(
    raw: DataFrame, distinct: DataFrame, outlier: Column, drop_missing: bool = True, remove_admin: bool = True
) -> DataFrame:
    """Rows in, out and dropped per step as (metric, value).

    One pass over the raw lines and one over the distinct ones: every raw line
    fails at most one step, the first it does not pass.
    """
    missing = ~has_customer()
    # With the step off, missing customers are counted but kept.
    passed = ~missing if drop_missing else F.lit(True)
    bad_price = passed & ~has_valid_price()
    passed = passed & has_valid_price()
    zero = passed & is_zero_quantity()
    admin = passed & ~is_zero_quantity() & is_admin_code() if remove_admin else F.lit(False)
    first = raw.agg(
        F.count(F.lit(1)).alias("initial_rows"),
        F.count_if(missing).alias("missing_customers_dropped"),
        F.count_if(bad_price).alias("invalid_prices_dropped"),
        F.count_if(zero).alias("zero_quantities_dropped"),
        F.count_if(admin).alias("admin_codes_removed"),
    )
    marked = distinct.withColumn("_outlier", outlier)
    kept = ~F.col("_outlier")
    second = marked.groupBy("customer_id").agg(
        F.sum(F.col("copies") - 1).alias("copies"),
        F.count_if("_outlier").alias("outliers"),
        F.count_if(kept).alias("kept"),
        F.count_if(kept & F.col("is_return")).alias("returns"),
    ).agg(
        F.sum("copies").alias("duplicates_removed"),
        F.sum("outliers").alias("extreme_records_removed"),
        F.sum("kept").alias("final_rows"),
        F.sum("returns").alias("return_rows_count"),
        F.count(F.when(F.col("kept") > 0, F.col("customer_id"))).alias("unique_customers"),
    )
    return _long(first).unionByName(_long(second))


def _long(row: DataFrame) -> DataFrame:
    pairs = [F.struct(F.lit(c).alias("metric"), F.coalesce(F.col(c).cast("bigint"), F.lit(0).cast("bigint")).alias("value")) for c in row.columns]
    return row.select(F.inline(F.array(*pairs)))
