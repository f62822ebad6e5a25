"""Checks of cleaning, validation, exploration and features."""

from __future__ import annotations

from oracle.base import BEHAVIOR, CTES, INPUTS, RFM, days, half_even, money_sum, with_ctes

CLEANED = "invoice, stock_code, description, quantity, invoice_date, price, customer_id, country, total_amount, is_return"

EXTRA = {
    "audit_counts": """
 select (select count(*) from raw_transactions) as a, (select count(*) from with_customer) as b, (select count(*) from with_price) as c,
        (select count(*) from with_quantity) as d, (select count(*) from without_admin) as e, (select count(*) from distinct_lines) as f,
        (select count(*) from cleaned) as g""",
    "simple": f"""
 select customer_id, floor({days('max(invoice_date)', '(select max(invoice_date) from cleaned)')})::bigint as recency,
        count(distinct invoice)::bigint as frequency, {money_sum()} as monetary
 from cleaned where not is_return group by customer_id""",
    "return_rates": "select customer_id, avg(is_return::int::double) as return_rate from cleaned group by customer_id",
    "measured": """
 select 'recency' as measure, 40 as bins, recency::double as x from simple
 union all select 'frequency', 40, frequency::double from simple
 union all select 'log_spend', 40, ln(1.0::double + greatest(monetary, 0.0::double)) from simple
 union all select 'return_rate', 30, return_rate from return_rates""",
    "limits": """
 select measure, case when min(x) = max(x) then min(x) - 0.5::double else min(x) end as lo,
        case when min(x) = max(x) then max(x) + 0.5::double else max(x) end as hi from measured group by 1""",
}


def q(sql: str) -> str:
    return with_ctes(sql, EXTRA)


def raw_filter(cond: str) -> str:
    return q(f"select * from raw_transactions where {cond}")


ADMIN = CTES["without_admin"].split("where", 1)[1]

_CORR = [c for c in INPUTS + ["clv_next_90d", "target_orders_count"]]
ORACLE = {
    "clean_missing_customer": raw_filter("customer_id is not null"),
    "clean_invalid_price": raw_filter("price >= 0.001"),
    "clean_zero_qty": raw_filter("quantity is distinct from 0"),
    "clean_returns": q("""select invoice, stock_code, description,
        case when (invoice like 'C%' or quantity < 0) and quantity > 0 then -quantity else quantity end as quantity,
        invoice_date, price, customer_id, country, (invoice like 'C%' or quantity < 0) as is_return from raw_transactions"""),
    "clean_admin": raw_filter(ADMIN),
    "clean_dedup": q("select * from distinct_lines"),
    "clean_description": q("select invoice, stock_code, description, quantity, invoice_date, price, customer_id from named"),
    "clean_amount": q("select invoice, stock_code, quantity, price, total_amount from named"),
    "clean_outlier_bounds": q(f"select {half_even('max_quantity', 6)} as max_quantity, {half_even('max_price', 6)} as max_price from bounds"),
    "clean_outliers": q("select d.* from distinct_lines d, bounds b where not (abs(quantity) > max_quantity or price > max_price)"),
    "clean_audit": q("""
 select unnest(['initial_rows', 'missing_customers_dropped', 'invalid_prices_dropped', 'zero_quantities_dropped', 'admin_codes_removed',
                'duplicates_removed', 'extreme_records_removed', 'final_rows', 'return_rows_count', 'unique_customers']) as metric,
        unnest([a, a - b, b - c, c - d, d - e, e - f, f - g, g, (select count(*) from cleaned where is_return),
                (select count(distinct customer_id) from cleaned)]::bigint[]) as value
 from audit_counts"""),
    "cleaned_transactions": q(f"select {CLEANED} from cleaned"),
    "validate_rules": q("""
 select 'non_empty' as rule, (count(*) = 0)::bigint as violations, 'error' as severity, count(*) > 0 as passed from cleaned
 union all select 'customer_id_null_rate', count(*) filter (where customer_id is null), 'error', count(*) filter (where customer_id is null) = 0 from cleaned
 union all select 'positive_price', count(*) filter (where price <= 0), 'error', count(*) filter (where price <= 0) = 0 from cleaned
 union all select 'non_zero_quantity', count(*) filter (where quantity = 0), 'error', count(*) filter (where quantity = 0) = 0 from cleaned
 union all select 'date_range', count(*) filter (where invoice_date < timestamp '2009-11-01' or invoice_date > timestamp '2011-12-31'), 'warning',
        count(*) filter (where invoice_date < timestamp '2009-11-01' or invoice_date > timestamp '2011-12-31') = 0 from cleaned"""),
    "validate_summary": q(f"""
 select count(*)::bigint as total_records, count(distinct customer_id)::bigint as unique_customers, count(distinct invoice)::bigint as unique_invoices,
        min(invoice_date) as min_date, max(invoice_date) as max_date, count(*) filter (where is_return)::bigint as return_transactions,
        {half_even('avg(is_return::int::double)', 6)} as return_rate, sum(total_amount::decimal(18,2))::double as total_revenue from cleaned"""),
    "eda_monthly": q(f"""
 select strftime(invoice_date, '%Y-%m') as year_month, {money_sum()} as revenue, count(distinct invoice)::bigint as order_count,
        count(distinct customer_id)::bigint as active_customers from cleaned where not is_return group by 1"""),
    "eda_monthly_net": q(f"""
 select date_trunc('month', invoice_date)::timestamp as month, {money_sum()} as total_revenue, count(distinct customer_id)::bigint as active_customers
 from cleaned group by 1"""),
    "eda_country_top": q(f"""
 select country, {money_sum()} as revenue from cleaned where not is_return group by 1 order by revenue desc, country limit 10"""),
    "eda_uk_share": q(f"""
 select {half_even(money_sum(where="country = 'United Kingdom'") + ' / ' + money_sum(), 6)} as uk_revenue_share from cleaned where not is_return"""),
    "eda_simple_rfm": q("select * from simple"),
    "eda_histogram": q("""
 select measure, least(floor((x - lo) / (hi - lo) * bins::double), bins - 1)::int as bin, count(*)::bigint as n
 from measured join limits using (measure) group by 1, 2"""),
    "eda_return_rate": q(f"select customer_id, {half_even('return_rate', 6)} as return_rate from return_rates"),
    "eda_findings": q(f"""
 select count(*)::bigint as total_active_customers,
        {half_even('median(recency)', 6)} as median_recency_days, {half_even('avg(recency)', 6)} as mean_recency_days,
        {half_even('median(frequency)', 6)} as median_frequency_orders, {half_even('avg(frequency)', 6)} as mean_frequency_orders,
        {half_even('median(monetary)', 6)} as median_spend, {half_even('sum(monetary::decimal(18,2))::double / count(*)', 6)} as mean_spend,
        (select {half_even(money_sum(where="country = 'United Kingdom'") + ' / ' + money_sum(), 6)} from cleaned where not is_return) as uk_revenue_share
 from simple"""),
    "eda_returner_share": q(f"""
 select {half_even('avg(r)', 6)} as returner_share from (select max(is_return::int)::double as r from cleaned group by customer_id)"""),
    "eda_class_balance": q(f"select churn, count(*)::bigint as n, {half_even('count(*)::double / sum(count(*)) over ()', 6)} as share from features group by churn"),
    "eda_correlation": q(" union all ".join(
        f"select '{c}' as feature, case when stddev_pop({c}) > 0 and stddev_pop(churn) > 0 then {half_even(f'corr({c}, churn)', 6)} end as correlation from features"
        for c in _CORR)),
    "eda_tier_churn": q(f"select engagement_tier, count(*)::bigint as customers, {half_even('avg(churn)', 6)} as churn_rate from features group by 1"),
    "rfm_features": q(f"select customer_id, {', '.join(RFM)} from rfm"),
    "order_table": q("select * from order_table"),
    "order_events": q(f"""
 select customer_id, invoice, min(invoice_date) as invoice_date, {money_sum()} as total_amount, sum(quantity) as total_quantity, bool_or(is_return) as is_return
 from observed group by 1, 2"""),
    "velocity_features": q("select * from velocity"),
    "behavior_features": q(f"select customer_id, {', '.join(BEHAVIOR)}, primary_country, is_uk from behavior"),
    "discount_sensitivity": q(f"select customer_id, {half_even('share', 4)} as discount_sensitivity from discounts"),
    "category_affinity": q(f"select customer_id, {', '.join(c for c in BEHAVIOR if c.startswith('cat'))} from behavior"),
    "primary_country": q("select * from countries"),
    "avg_pct_rank": q("select customer_id, f as pct_rank from ranks"),
    "engagement": q("select * from engagement"),
    "cohort": q("select * from cohort"),
    "targets": q("select * from targets"),
    "customer_features": q("select * from features"),
    "ingest_sheets": q("select invoice, trim(stock_code) as stock_code, trim(description) as description, quantity, invoice_date, price, customer_id, trim(country) as country from raw_transactions"),
    "cleaned_roundtrip": q(f"select {CLEANED} from cleaned, cutoff where invoice_date <= t"),
    "features_roundtrip": q("select * from features"),
    "cohort_summary": q(f"""
 select count(*)::bigint as cohort_size, {half_even('avg(churn)', 4)} as churn_rate, count(*) filter (where churn = 0)::bigint as retained_count,
        count(*) filter (where churn = 1)::bigint as churned_count, {half_even('sum(clv_next_90d::decimal(18,2))::double / count(*)', 4)} as mean_clv_90d,
        {half_even('median(clv_next_90d)', 4)} as median_clv_90d, {half_even('max(clv_next_90d)', 4)} as max_clv_90d,
        {half_even('sum(engagement_score::decimal(18,2))::double / count(*)', 4)} as mean_engagement_score from features"""),
}
