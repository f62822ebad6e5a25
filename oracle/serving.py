"""Checks of scoring, serving tables and reports."""

from __future__ import annotations

from oracle.base import days, exact, half_even, money_sum, with_ctes
from oracle.models import ANOMALY, EXTRA as MODEL_CTES, tier, z

T1, T2 = "timestamp '2001-08-02 00:00:00'", "timestamp '2001-08-09 00:00:00'"
SHARES = ("recent_orders_ratio seasonal_q4_order_share seasonal_q4_spend_share return_line_rate return_spend_ratio discount_sensitivity "
          "cat_affinity_22 cat_affinity_21 cat_affinity_85 cat_affinity_84 cat_affinity_23 cat_affinity_20").split()

F1 = "greatest(case when frequency = 0 then 1.0::double else frequency end, 1.0::double)"
REC = "(case when recency_days = 0 then 30.0::double else recency_days end)"
TENURE = f"greatest({REC}, 30.0::double)"
IMPUTED = {
    "recency_days": "recency_days", "frequency": "frequency", "total_spend": "total_spend",
    "gross_spend": "greatest(total_spend, 0.0::double)", "total_items": "total_items", "unique_products_count": "unique_products_count",
    "avg_order_value": f"total_spend / {F1}", "avg_basket_size": f"total_items / {F1}",
    "avg_unique_products_per_order": f"unique_products_count / {F1}",
    "log_total_spend": "ln(1.0::double + greatest(total_spend, 0.0::double))", "log_frequency": f"ln(1.0::double + {F1})",
    "tenure_days": TENURE, "days_active_span": f"greatest({TENURE} - {REC}, 0.0::double)",
    "inter_purchase_mean": f"{TENURE} / greatest({F1} - 1.0::double, 1.0::double)", "inter_purchase_std": "0.0::double",
    "is_single_order": f"case when {F1} <= 1 then 1.0::double else 0.0::double end", "recent_orders_last_90d": "0.0::double",
    "velocity_acceleration": "1.0::double", "has_returned": "0.0::double", **{c: "0.0::double" for c in SHARES}, "is_uk": "1.0::double",
    "engagement_score": f"least(greatest(50.0::double + {F1} * 3.0::double + total_spend / 100.0::double - {REC} / 5.0::double, 0.0::double), 100.0::double)",
}
# uploads give neither items nor products, which have their own defaults then
UPLOAD_IMPUTED = IMPUTED | {
    "total_items": "0.0::double", "unique_products_count": "0.0::double", "avg_basket_size": "10.0::double",
    "avg_unique_products_per_order": "3.0::double",
}
CLUSTER_ID = "(case when engagement_score <= 40 then 0 when engagement_score <= 70 then 1 else 2 end + case when recency_days > 90 then 3 else 0 end)::int"
ERROR = "(" + " + ".join(f"{z(c)} * {z(c)}" for c in ANOMALY) + f") / {len(ANOMALY)}.0::double"
RULE_P = "(1.0::double / (1.0::double + exp(-(recency_days / 100.0::double - frequency / 5.0::double))))"
RULE_CLV = "(0.45::double * greatest(total_spend, 0.0::double))"

EXTRA = {
    **MODEL_CTES,
    "records": f"""
 select customer_id, coalesce({days('max(invoice_date) filter (where not is_return)', '(select max(invoice_date) from cleaned)')}, 0.0::double) as recency_days,
        count(distinct invoice) filter (where not is_return)::double as frequency, {money_sum()} as total_spend,
        coalesce(sum(quantity) filter (where not is_return), 0.0::double) as total_items,
        count(distinct stock_code) filter (where not is_return)::double as unique_products_count
 from cleaned group by customer_id""",
    "imputed": "select customer_id, " + ", ".join(f"({e})::double as {c}" for c, e in IMPUTED.items()) + " from records",
    "uploaded": """
 select customer_id, case when customer_id % 50 <> 0 then recency_days end as recency_days,
        case when customer_id % 70 = 0 then -1.0::double else frequency end as frequency, total_spend, null::double as avg_order_value
 from records, range(2) t(copy) where copy = 0 or customer_id % 90 = 0""",
    "upload_checked": """
 select *, concat_ws('; ', case when recency_days is null then 'recency_days is missing' end, case when recency_days < 0 then 'recency_days < 0' end,
        case when frequency < 0 then 'frequency < 0' end) as reasons from uploaded""",
    "upload_imputed": "select customer_id, " + ", ".join(f"({e})::double as {c}" for c, e in UPLOAD_IMPUTED.items()) + " from upload_checked where reasons = ''",
    "errors": f"select {ERROR} as e from features, anomaly_stats",
    "limits95": f"select {half_even('quantile_cont(e, 0.95)', 4)} as p95, {half_even('quantile_cont(e, 0.99)', 4)} as p99 from errors",
    "rescored": f"""
 select customer_id, {exact('p', 4)} as churn_probability, p >= 0.5 as is_churn, {exact('clv', 2)} as predicted_clv, {tier('p')} as risk_tier,
        coalesce(segment_name, 'Cluster ' || cluster_id) as segment_name, e >= p95 as is_anomaly, {exact('e', 4)} as anomaly_score
 from (select *, {RULE_P} as p, {RULE_CLV} as clv, {CLUSTER_ID} as cluster_id, {ERROR} as e from imputed, anomaly_stats, limits95) r
 left join personas using (cluster_id)""",
    "upload_scored": f"""
 select customer_id, {exact('p', 4)} as churn_probability, p >= 0.5 as is_churn, {exact('clv', 2)} as predicted_clv, {tier('p')} as risk_tier,
        coalesce(segment_name, 'Cluster ' || cluster_id) as segment_name, e >= p95 as is_anomaly, {exact('e', 4)} as anomaly_score
 from (select *, {RULE_P} as p, {RULE_CLV} as clv, {CLUSTER_ID} as cluster_id, {ERROR} as e from upload_imputed, anomaly_stats, limits95) r
 left join personas using (cluster_id)""",
    "customers_t": """
 select customer_id, primary_country as country, first_order_date, last_order_date, is_uk = 1 as is_uk from features left join (
  select customer_id, min(invoice_date) as first_order_date, max(invoice_date) as last_order_date from cleaned group by 1) using (customer_id)""",
    "segmented": "select c.*, segment_name from clustered c join personas p on c.cluster_id = p.cluster_id",
    "segments_t": f"""
 select customer_id, cluster_id as segment_id, segment_name, engagement_score, {T1} as updated_at from segmented""",
    "predictions_t": f"""
 select customer_id, {exact('p', 4)} as churn_probability, p >= 0.5 as is_churn, {exact('clv', 2)} as predicted_clv, {tier('p')} as risk_tier,
        'v1.0.0' as model_version, {T1} as scored_at from scored""",
    "anomalies_t": f"""
 select customer_id, e4 as reconstruction_error, e4 >= p95 as is_anomaly_95, e4 >= p99 as is_anomaly_99, {T1} as flagged_at
 from (select customer_id, {exact(ERROR, 4)} as e4, p95, p99 from features, anomaly_stats, limits95)""",
    "customers_u": """
 select * from customers_t union all
 select customer_id, 'United Kingdom', null, null, true from rescored where customer_id not in (select customer_id from customers_t)""",
    "segments_u": f"""
 select coalesce(s.customer_id, r.customer_id) as customer_id, coalesce(segment_id, 0)::int as segment_id, coalesce(r.segment_name, s.segment_name) as segment_name,
        coalesce(engagement_score, 50.0::double) as engagement_score, case when r.customer_id is not null then {T2} else updated_at end as updated_at
 from segments_t s full join rescored r on s.customer_id = r.customer_id""",
    "predictions_u": f"""
 select * from predictions_t union all
 select customer_id, churn_probability, is_churn, predicted_clv, risk_tier, 'v1.0.0', {T2} from rescored""",
    "anomalies_u": f"""
 select * from anomalies_t union all
 select customer_id, anomaly_score, is_anomaly, anomaly_score >= p99, {T2} from rescored, limits95""",
    "last_prediction": "select * from (select *, row_number() over (partition by customer_id order by scored_at desc) as rn from predictions_u) where rn = 1",
    "last_anomaly": "select * from (select *, row_number() over (partition by customer_id order by flagged_at desc) as rn from anomalies_u) where rn = 1",
    "cohort_t": """
 select s.customer_id, segment_name, primary_country, recency_days, frequency, total_spend, churn_probability, predicted_clv, risk_tier,
        reconstruction_error, is_anomaly_95
 from segmented s join last_prediction p on s.customer_id = p.customer_id join last_anomaly a on s.customer_id = a.customer_id""",
    "risky": f"""
 select customer_id, segment_name, churn_probability, predicted_clv, {half_even('predicted_clv * churn_probability', 2)} as priority_revenue_at_risk,
        recency_days, frequency, total_spend, risk_tier from cohort_t where churn_probability >= 0.6 and total_spend >= 500""",
}


T3 = "timestamp '2001-08-16 00:00:00'"


def scored_uploads(records: str, at: str) -> str:
    """What the stream makes of upload records (customer_id, recency_days, frequency, total_spend)."""
    imputed = "select customer_id, " + ", ".join(f"({e})::double as {c}" for c, e in UPLOAD_IMPUTED.items()) + f" from ({records})"
    return f"""
 select customer_id, {exact('p', 4)} as churn_probability, p >= 0.5 as is_churn, {exact('clv', 2)} as predicted_clv, {tier('p')} as risk_tier,
        coalesce(segment_name, 'Cluster ' || cluster_id) as segment_name, e >= p95 as is_anomaly, {exact('e', 4)} as anomaly_score, {at} as scored_at
 from (select *, {RULE_P} as p, {RULE_CLV} as clv, {CLUSTER_ID} as cluster_id, {ERROR} as e from ({imputed}), anomaly_stats, limits95) r
 left join personas using (cluster_id)"""


EXTRA |= {
    "stream_first": scored_uploads("select customer_id, recency_days, frequency, total_spend from records where customer_id % 3 <> 0", T2),
    "stream_second": scored_uploads(
        "select customer_id, recency_days + 60.0::double as recency_days, frequency, total_spend * 2.0::double as total_spend from records where customer_id % 2 = 0 "
        "union all select customer_id + 1000000, recency_days + 60.0::double, frequency, total_spend * 2.0::double from records where customer_id % 50 = 0", T3),
    "streamed": "select * from stream_first union all select * from stream_second",
    "streamed_last": "select * from (select *, row_number() over (partition by customer_id order by scored_at desc) as rn from streamed) where rn = 1",
}


def q(sql: str) -> str:
    return with_ctes(sql, EXTRA)


ORACLE = {
    "impute_features": q("select customer_id, " + ", ".join(f"{half_even(c, 6)} as {c}" for c in IMPUTED) + " from imputed"),
    "reject_rows": q("""
 select customer_id, concat_ws('; ', case when frequency = 3 then 'recency_days is missing' end,
        case when frequency <> 3 and recency_days - 30 < 0 then 'recency_days < 0' end, case when va / 2 > 1 then 'return_line_rate > 1' end) as reasons
 from (select r.*, f.velocity_acceleration as va from records r left join features f on r.customer_id = f.customer_id)
 where frequency = 3 or recency_days - 30 < 0 or va / 2 > 1"""),
    "risk_tier": q(f"select customer_id, {tier('p')} as risk_tier, p >= 0.5 as is_churn from scored"),
    "batch_summary": q(f"""
 select count(*)::bigint as total_records, {half_even('sum(churn_probability::decimal(18,4))::double / count(*)', 4)} as churn_rate,
        {half_even('sum(predicted_clv::decimal(18,2))::double / count(*)', 2)} as mean_predicted_clv, count(*) filter (where is_anomaly)::bigint as anomalies_detected
 from rescored"""),
    "batch_export": q("select customer_id, churn_probability, is_churn, predicted_clv as predicted_clv_90d, risk_tier, segment_name, is_anomaly, anomaly_score from rescored"),
    "bundle_score": q("select customer_id, churn_probability, is_churn, predicted_clv as predicted_clv_90d, risk_tier, segment_name, is_anomaly, anomaly_score from rescored"),
    "export_roundtrip": q("select customer_id, churn_probability, is_churn, predicted_clv as predicted_clv_90d, risk_tier, segment_name, is_anomaly, anomaly_score from rescored"),
    "serving_roundtrip": q("""
 select c.customer_id, country, is_uk, segment_name, updated_at, churn_probability, predicted_clv, risk_tier, model_version, reconstruction_error,
        is_anomaly_95, is_anomaly_99
 from customers_t c join segments_t s using (customer_id) join predictions_t p using (customer_id) join anomalies_t a using (customer_id)"""),
    "serving_customers": q("select * from customers_t"),
    "serving_segments": q("select * from segments_t"),
    "serving_predictions": q("select * from predictions_t"),
    "serving_anomalies": q("select * from anomalies_t"),
    "upsert_customers": q("select * from customers_u"),
    "upsert_segments": q("select * from segments_u"),
    "append_predictions": q("select * from predictions_u"),
    "append_anomalies": q("select * from anomalies_u"),
    "customer_360": q(f"""
 select c.customer_id, c.country, c.first_order_date, c.last_order_date, c.is_uk, s.segment_name, p.churn_probability as latest_probability,
        p.scored_at as latest_scored_at, coalesce(h.n, 0)::bigint as predictions, a.reconstruction_error as latest_error, a.is_anomaly_95,
        f.recency_days, f.frequency::double as frequency, {half_even('f.total_spend', 2)} as total_spend, {half_even('f.return_line_rate', 4)} as return_rate
 from customers_u c left join segments_u s on c.customer_id = s.customer_id left join last_prediction p on c.customer_id = p.customer_id
 left join (select customer_id, count(*) as n from predictions_u group by 1) h on c.customer_id = h.customer_id
 left join last_anomaly a on c.customer_id = a.customer_id left join features f on c.customer_id = f.customer_id"""),
    "prediction_history": q("select customer_id, scored_at, churn_probability, risk_tier from predictions_u"),
    "customer_page": q(f"""
 select c.customer_id, c.country, s.segment_name, p.churn_probability, p.risk_tier, p.scored_at, (p.scored_at is not null)::int as historical_predictions_count,
        f.recency_days, {half_even('f.total_spend', 2)} as total_spend
 from (select * from customers_u order by customer_id limit 200 offset 100) c left join segments_u s on c.customer_id = s.customer_id
 left join last_prediction p on c.customer_id = p.customer_id left join features f on c.customer_id = f.customer_id"""),
    "cohort_view": q("select * from cohort_t"),
    "cohort_view_unscored": q(f"""
 select customer_id, segment_name, primary_country, recency_days, frequency, total_spend,
        case when recency_days > 90 then 0.85::double else 0.25::double end as churn_probability, {half_even('total_spend * 0.45::double', 2)} as predicted_clv,
        case when recency_days > 90 then 'High Risk' else 'Low Risk' end as risk_tier, 0.02::double as reconstruction_error, false as is_anomaly_95
 from segmented"""),
    "kpis": q(f"""
 select count(*)::bigint as customers, {half_even('count(*) filter (where churn_probability >= 0.5)::double / count(*) * 100.0::double', 6)} as churn_percent,
        {half_even('sum(predicted_clv::decimal(18,2))::double / count(*)', 4)} as mean_clv, count(*) filter (where risk_tier = 'High Risk')::bigint as high_risk,
        count(*) filter (where is_anomaly_95)::bigint as anomalies from cohort_t"""),
    "tier_counts": q("select risk_tier, count(*)::bigint as customers from cohort_t group by 1"),
    "segment_filter": q("""
 select customer_id, segment_name, total_spend from cohort_t where total_spend >= 0 and total_spend <= (select quantile_cont(total_spend, 0.98) from cohort_t)"""),
    "fixed_sample": q("select customer_id, recency_days, total_spend from cohort_t order by md5(customer_id::varchar || ':42'), customer_id limit 500"),
    "segment_summary": q(f"""
 select segment_name, count(*)::bigint as customers, {half_even('sum(total_spend::decimal(28,6))::double / count(*)', 4)} as avg_spend, {half_even('sum(frequency::decimal(28,6))::double / count(*)', 4)} as avg_freq,
        {half_even('sum(recency_days::decimal(28,6))::double / count(*)', 4)} as avg_recency, {half_even('sum(predicted_clv::decimal(28,6))::double / count(*)', 4)} as avg_clv, {half_even('sum(churn_probability::decimal(28,6))::double / count(*)', 4)} as churn_risk
 from cohort_t group by 1"""),
    "leaderboard": q("select * from risky order by priority_revenue_at_risk desc, customer_id limit 100"),
    "leaderboard_total": q("select count(*)::bigint as accounts, coalesce(sum(priority_revenue_at_risk::decimal(18,2))::double, 0.0::double) as revenue_at_risk from risky"),
    "stream_customers": q("""
 select * from customers_t union all
 select customer_id, 'United Kingdom', null, null, true from streamed_last where customer_id not in (select customer_id from customers_t)"""),
    "stream_segments": q("""
 select coalesce(s.customer_id, r.customer_id) as customer_id, coalesce(segment_id, 0)::int as segment_id, coalesce(r.segment_name, s.segment_name) as segment_name,
        coalesce(engagement_score, 50.0::double) as engagement_score, coalesce(r.scored_at, updated_at) as updated_at
 from segments_t s full join streamed_last r on s.customer_id = r.customer_id"""),
    "stream_predictions": q("""
 select * from predictions_t union all
 select customer_id, churn_probability, is_churn, predicted_clv, risk_tier, 'v1.0.0', scored_at from streamed"""),
    "stream_anomalies": q("""
 select * from anomalies_t union all
 select customer_id, anomaly_score, is_anomaly, anomaly_score >= p99, scored_at from streamed, limits95"""),
    "upload_rows": q("select * from upload_checked"),
    "stream_score": q("select customer_id, churn_probability, is_churn, predicted_clv as predicted_clv_90d, risk_tier, segment_name, is_anomaly, anomaly_score from upload_scored"),
}
