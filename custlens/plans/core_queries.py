"""Queries on cleaning, validation, exploration and features."""

from __future__ import annotations

from pyspark.sql import functions as F

from custlens.functions.columns import round_even
from custlens.functions.ranking import average_percent_ranks
from custlens.operators import clean, eda, features as feat, orders, validate
from custlens.plans import tables


def _valid(s, d):
    return clean.drop_admin_codes(
        clean.flag_returns(clean.drop_zero_quantities(clean.drop_invalid_prices(clean.drop_missing_customers(tables.raw(s, d)))))
    )


def _distinct(s, d):
    return clean.drop_copies(_valid(s, d))


def clean_missing_customer(s, d):
    return clean.drop_missing_customers(tables.raw(s, d))


def clean_invalid_price(s, d):
    return clean.drop_invalid_prices(tables.raw(s, d))


def clean_zero_qty(s, d):
    return clean.drop_zero_quantities(tables.raw(s, d))


def clean_returns(s, d):
    return clean.flag_returns(tables.raw(s, d))


def clean_admin(s, d):
    return clean.drop_admin_codes(tables.raw(s, d))


def clean_description(s, d):
    named = clean.standardize_descriptions(_distinct(s, d))
    return named.select("invoice", "stock_code", "description", "quantity", "invoice_date", "price", "customer_id")


def clean_amount(s, d):
    return clean.add_line_amount(_distinct(s, d)).select("invoice", "stock_code", "quantity", "price", "total_amount")


def clean_outlier_bounds(s, d):
    bounds = clean.outlier_bounds(_distinct(s, d))
    return bounds.select(*[round_even(c, 6).alias(c) for c in bounds.columns])


def clean_outliers(s, d):
    return clean.drop_outliers(_distinct(s, d))


def clean_audit(s, d):
    return clean.clean_transactions(tables.raw(s, d)).audit


def cleaned_transactions(s, d):
    return clean.clean_transactions(tables.raw(s, d)).cleaned


def validate_rules(s, d):
    return validate.validation_rules(tables.cleaned(s, d))


def validate_summary(s, d):
    summary = validate.validate_cleaned(tables.cleaned(s, d))
    return summary.withColumn("return_rate", round_even("return_rate", 6))


def eda_uk_share(s, d):
    return eda.domestic_share(tables.cleaned(s, d)).select(round_even("uk_revenue_share", 6).alias("uk_revenue_share"))


def eda_return_rate(s, d):
    return eda.customer_return_rates(tables.cleaned(s, d)).withColumn("return_rate", round_even("return_rate", 6))


def eda_findings(s, d):
    row = eda.findings(tables.cleaned(s, d))
    return row.select(
        "total_active_customers",
        *[round_even(c, 6).alias(c) for c in row.columns if c != "total_active_customers"],
    )


def eda_returner_share(s, d):
    return eda.returner_share(tables.cleaned(s, d)).select(round_even("returner_share", 6).alias("returner_share"))


def eda_class_balance(s, d):
    return eda.class_balance(tables.features(s, d)).withColumn("share", round_even("share", 6))


def eda_correlation(s, d):
    f = tables.features(s, d)
    numeric = [c for c, t in f.dtypes if t != "string" and c not in ("customer_id", "churn")]
    return eda.target_correlations(f, numeric)


def eda_tier_churn(s, d):
    return eda.churn_by_tier(tables.features(s, d)).withColumn("churn_rate", round_even("churn_rate", 6))


def order_table(s, d):
    return orders.order_table(tables.observed(s, d))


def order_events(s, d):
    return orders.order_events(tables.observed(s, d))


def rfm_features(s, d):
    return feat.rfm_features(tables.cleaned(s, d), tables.cutoff(s, d))


def velocity_features(s, d):
    return feat.velocity_features(tables.cleaned(s, d), tables.cutoff(s, d))


def behavior_features(s, d):
    return feat.behavior_features(tables.cleaned(s, d), tables.cutoff(s, d))


def discount_sensitivity(s, d):
    facts = orders.customer_product_facts(tables.observed(s, d))
    return facts.select(
        "customer_id", round_even(F.col("discount_lines") / F.col("sale_lines"), 4).alias("discount_sensitivity")
    )


def category_affinity(s, d):
    out = feat.behavior_features(tables.cleaned(s, d), tables.cutoff(s, d))
    return out.select("customer_id", *[f"cat_affinity_{c}" for c in orders.CATEGORIES])


def primary_country(s, d):
    return orders.primary_country(tables.observed(s, d))


def avg_pct_rank(s, d):
    rfm = rfm_features(s, d).select("customer_id", "frequency")
    return average_percent_ranks(rfm, "customer_id", {"pct_rank": F.col("frequency")}).select("customer_id", "pct_rank")


def engagement(s, d):
    return feat.engagement_scores(rfm_features(s, d)).select("customer_id", "engagement_score", "engagement_tier")


def cohort(s, d):
    return feat.cohort(tables.cleaned(s, d), tables.cutoff(s, d))


def targets(s, d):
    return feat.forward_targets(tables.cleaned(s, d), tables.cutoff(s, d))


def customer_features(s, d):
    return feat.customer_features(tables.cleaned(s, d))


def cohort_summary(s, d):
    row = eda.cohort_summary(tables.features(s, d))
    exact = ("cohort_size", "retained_count", "churned_count")
    return row.select(*[F.col(c) if c in exact else round_even(c, 4).alias(c) for c in row.columns])


QUERIES = {
    f.__name__: f
    for f in (
        clean_missing_customer, clean_invalid_price, clean_zero_qty, clean_returns, clean_admin,
        clean_description, clean_amount, clean_outlier_bounds, clean_outliers, clean_audit,
        cleaned_transactions, validate_rules, validate_summary, eda_uk_share, eda_return_rate,
        eda_findings, eda_returner_share, eda_class_balance, eda_correlation, eda_tier_churn,
        order_table, order_events, rfm_features, velocity_features, behavior_features,
        discount_sensitivity, category_affinity, primary_country, avg_pct_rank, engagement,
        cohort, targets, customer_features, cohort_summary,
    )
}
QUERIES["clean_dedup"] = lambda s, d: _distinct(s, d)
QUERIES["eda_monthly"] = lambda s, d: eda.monthly_sales(tables.cleaned(s, d))
QUERIES["eda_monthly_net"] = lambda s, d: eda.monthly_net(tables.cleaned(s, d))
QUERIES["eda_country_top"] = lambda s, d: eda.top_countries(tables.cleaned(s, d))
QUERIES["eda_simple_rfm"] = lambda s, d: eda.simple_rfm(tables.cleaned(s, d))
QUERIES["eda_histogram"] = lambda s, d: eda.eda_histograms(tables.cleaned(s, d))
