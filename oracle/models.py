"""Checks of splits, metrics, sequences, anomalies, segments and explanations."""

from __future__ import annotations

from oracle.base import INPUTS, days, exact, half_even, with_ctes

ANOMALY = ("recency_days frequency total_spend gross_spend avg_order_value avg_basket_size velocity_acceleration "
           "return_spend_ratio return_line_rate discount_sensitivity engagement_score").split()
CLUSTER = "recency_days frequency total_spend avg_basket_size velocity_acceleration return_line_rate engagement_score".split()
GRAM = [*INPUTS, "clv_millions", "one"]

MARGIN = "(recency_days / 100.0::double - frequency / 5.0::double)"
P = f"(1.0::double / (1.0::double + exp(-{MARGIN})))"
CLV = "(0.45::double * greatest(total_spend, 0.0::double))"


def tier(p: str) -> str:
    return f"case when {p} >= 0.7 then 'High Risk' when {p} >= 0.4 then 'Medium Risk' else 'Low Risk' end"


def z(c: str) -> str:
    return f"(({c}::double - m_{c}) / s_{c})"


def stats(columns: list[str], source: str) -> str:
    return "select " + ", ".join(
        f"avg({c}::double) as m_{c}, case when stddev_pop({c}::double) = 0 then 1.0::double else stddev_pop({c}::double) end as s_{c}"
        for c in columns
    ) + f" from {source}"


def split(stratum: str) -> str:
    """Largest-remainder quotas per stratum, then places by hash."""
    return f"""
 select f.*, case when place <= test_n then 'test' when place <= test_n + val_n then 'val' else 'train' end as split
 from (select *, {stratum} as stratum, row_number() over (partition by {stratum} order by md5(customer_id::varchar || ':42'), customer_id) as place from features) f
 join (
  select stratum, test_n, vbase + (row_number() over (order by vrest desc, stratum) <= vseats - sum(vbase) over ())::int as val_n from (
   select *, floor(ideal) as vbase, ideal - floor(ideal) as vrest from (
    select *, rest_n * vseats / sum(rest_n) over () as ideal from (
     select *, ceil((0.15::double / (1.0::double - 0.15::double)) * sum(rest_n) over ()) as vseats from (
      select stratum, n, test_n, n - test_n as rest_n from (
       select stratum, n, base + (row_number() over (order by rest desc, stratum) <= seats - sum(base) over ())::int as test_n from (
        select *, floor(ideal) as base, ideal - floor(ideal) as rest from (
         select *, n * seats / sum(n) over () as ideal from (
          select *, ceil(0.15::double * sum(n) over ()) as seats from (
           select {stratum} as stratum, count(*) as n from features group by 1)))))))))) q on f.stratum = q.stratum"""


EXTRA = {
    "churn_split": split("churn::varchar"),
    "clv_split": split("'all'"),
    "churn_train": "select * from churn_split where split = 'train'",
    "clv_train": "select * from clv_split where split = 'train'",
    "churn_stats": stats(INPUTS, "churn_train"),
    "clv_stats": stats(INPUTS, "clv_train"),
    "anomaly_stats": stats(ANOMALY, "features"),
    "cluster_stats": stats(CLUSTER, "features"),
    "scored": f"select *, {P} as p, {CLV} as clv, {MARGIN} as margin from features",
    "positions": """
 select churn, rank() over (order by margin) + (count(*) over (partition by margin) - 1) / 2.0::double as r from scored""",
    "knn_x": "select customer_id, split, churn, [" + ", ".join(z(c) for c in INPUTS) + "] as x from churn_split, churn_stats",
    # the same bound on the rows of the fit
    "knn_fit": "select customer_id, churn, x from knn_x where split = 'train' order by md5(concat(customer_id, ':knn')), customer_id limit 20000",
    "knn_near": """
 select qid, y, d, row_number() over (partition by qid order by d, tid) as place from (
  select q.customer_id as qid, t.customer_id as tid, t.churn as y, list_distance(q.x, t.x) as d
  from knn_x q cross join knn_fit t where q.split <> 'train')""",
    "gram_x": "select [" + ", ".join([z(c) for c in INPUTS] + ["clv_next_90d / 1000000.0::double", "1.0::double"]) + "]::double[] as x from clv_train, clv_stats",
    "order_events": """
 select customer_id, invoice, min(invoice_date) as seen, sum(total_amount::decimal(18,2))::double as amount, sum(quantity) as quantity,
        bool_or(is_return) as returned from observed group by 1, 2""",
    "order_steps": f"""
 select customer_id, row_number() over (partition by customer_id order by seen desc, invoice desc) as back,
        ln(1.0::double + greatest(amount, 0.0::double)) / 10.0::double as amount,
        coalesce(least(greatest({days('lag(seen) over (partition by customer_id order by seen, invoice)', 'seen')}, 0.0::double), 365.0::double), 0.0::double) / 100.0::double as gap,
        ln(1.0::double + greatest(quantity, 0.0::double)) / 10.0::double as quantity, returned::int::double as is_return
 from order_events""",
    "deviation": f"select customer_id, {half_even('(' + ' + '.join(f'{z(c)} * {z(c)}' for c in ANOMALY) + f') / {len(ANOMALY)}.0::double', 6)} as error from features, anomaly_stats",
    "clustered": """
 select *, (case when engagement_score <= 40 then 0 when engagement_score <= 70 then 1 else 2 end + case when recency_days > 90 then 3 else 0 end)::int as cluster_id
 from features""",
    "points": "select customer_id, cluster_id, [" + ", ".join(z(c) for c in CLUSTER) + "] as x from clustered, cluster_stats",
    "coordinates": "select customer_id, cluster_id, unnest(x) as v, generate_subscripts(x, 1) as j from points",
    "centers": "select cluster_id, list(m order by j) as center from (select cluster_id, j, avg(v) as m from coordinates group by 1, 2) group by 1",
    "spreads": "select cluster_id, any_value(center) as center, avg(list_distance(x, center)) as s from points join centers using (cluster_id) group by 1",
    "cluster_moments": """
 select c.cluster_id, n, sq, center from centers c join
 (select cluster_id, count(*) as n, sum(list_dot_product(x, x)) as sq from points group by 1) m on c.cluster_id = m.cluster_id""",
    "profile_to_cluster": """
 select p.customer_id, p.cluster_id as own, m.cluster_id as other, m.n,
        m.sq + m.n * list_dot_product(p.x, p.x) - 2 * m.n * list_dot_product(p.x, m.center) as total
 from points p cross join cluster_moments m""",
    "profile": f"""
 select cluster_id, count(*)::bigint as customer_count, {half_even('sum(recency_days::decimal(28,6))::double / count(*)', 2)} as recency_days, {half_even('sum(frequency::decimal(28,6))::double / count(*)', 2)} as frequency,
        {half_even('sum(total_spend::decimal(28,6))::double / count(*)', 2)} as total_spend, {half_even('sum(avg_basket_size::decimal(28,6))::double / count(*)', 2)} as avg_basket_size,
        {half_even('sum(engagement_score::decimal(28,6))::double / count(*)', 2)} as engagement_score, {half_even('sum(churn::decimal(28,6))::double / count(*)', 2)} as churn_rate,
        {half_even('sum(clv_next_90d::decimal(28,6))::double / count(*)', 2)} as forward_clv, {half_even('count(*)::double / sum(count(*)) over ()', 4)} as share_of_cohort
 from clustered group by cluster_id""",
    "named_clusters": """
 select *, case when total_spend >= 50000 or frequency >= 50 then 'VIP Champions'
   when frequency >= 1 and total_spend >= 8000 and recency_days >= 200 then 'High-Value Inactive'
   when recency_days <= 90 and frequency >= 5 then 'Loyal Regulars' else 'At-Risk / Lapsed' end as base_name from profile""",
    "personas": """
 select cluster_id, case when row_number() over (partition by base_name order by cluster_id) > 1
   then base_name || ' (Cohort ' || cluster_id || ')' else base_name end as segment_name from named_clusters""",
    "attributions": """
 select customer_id, 'recency_days' as feature, recency_days::double as value, 0.01::double * (recency_days - avg(recency_days) over ()) as attribution from features
 union all
 select customer_id, 'frequency', frequency::double, -0.2::double * (frequency - avg(frequency) over ()) from features""",
    "placed": "select *, row_number() over (partition by customer_id order by -abs(attribution), feature) as place from attributions",
    "rounded_factors": f"""
 select customer_id, place, feature, {exact('value', 2)} as value, {exact('attribution', 4)} as attribution from placed""",
}


CHURN_RULES = {"recency_rule": "recency_days / 100.0::double - 0.5::double", "order_rule": "1.0::double - frequency / 5.0::double", "both_rule": MARGIN}
CLV_RULES = {"half_spend": "0.5", "third_spend": "0.3", "rule_spend": "0.45"}
EXTRA |= {
    "rule_scores": " union all ".join(
        f"select customer_id, churn, split, '{name}' as model, 1.0::double / (1.0::double + exp(-({margin}))) as p from churn_split"
        for name, margin in CHURN_RULES.items()),
    "rule_places": """
 select *, rank() over (partition by model, split order by p) + (count(*) over (partition by model, split, p) - 1) / 2.0::double as r from rule_scores""",
    "rule_values": " union all ".join(
        f"select clv_next_90d as y, split, '{name}' as model, {share}::double * greatest(total_spend, 0.0::double) as x from clv_split"
        for name, share in CLV_RULES.items()),
    "registry": f"""
 select target, model, 2::bigint as version, timestamp '2001-08-09 00:00:00' as trained_at, 'models/v2/' || model as path, '{{"rule": "' || model || '"}}' as parameters,
        {len(INPUTS)}::bigint as feature_count, measure, test_value, second_value,
        (row_number() over (partition by target order by test_value desc, second_value desc nulls last, model))::int as place
 from (
  select 'churn' as target, model, 'roc_auc' as measure,
         {half_even("(sum(r) filter (where churn = 1) - count(*) filter (where churn = 1) * (count(*) filter (where churn = 1) + 1) / 2.0::double) / (count(*) filter (where churn = 1) * count(*) filter (where churn = 0))", 4)} as test_value,
         {half_even("count(*) filter (where p >= 0.5 and churn = 1)::double / count(*) filter (where churn = 1)", 4)} as second_value
  from rule_places where split = 'test' group by model
  union all
  select 'clv_next_90d', model, 'r2', {half_even('1.0::double - avg((y - x) * (y - x)) / var_pop(y)', 4)}, null::double
  from rule_values where split = 'test' group by model)""",
}


def q(sql: str) -> str:
    return with_ctes(sql, EXTRA)


# The strategy texts.
STRATEGY = {
    "VIP Champions": "High spend, frequent, and highly active. Recommend VIP loyalty perks, early product access, and dedicated account manager.",
    "Loyal Regulars": "Consistent, steady purchasing cadence with moderate spend. Recommend cross-selling campaigns and replenishment reminders.",
    "High-Value Inactive": "Historically high spenders who made bulk orders but became inactive. Urgent intervention required: win-back discounts and executive outreach.",
    "At-Risk / Lapsed": "Low frequency, low spend buyers with high churn risk. Recommend automated promotional email drips and price-incentive promos.",
}

CONFUSION = """
 count(*) filter (where p >= 0.5 and churn = 1) as tp, count(*) filter (where p >= 0.5 and churn = 0) as fp,
 count(*) filter (where p < 0.5 and churn = 0) as tn, count(*) filter (where p < 0.5 and churn = 1) as fn"""
AUC = "(sum(r) filter (where churn = 1) - count(*) filter (where churn = 1) * (count(*) filter (where churn = 1) + 1) / 2.0::double) / (count(*) filter (where churn = 1) * count(*) filter (where churn = 0))"


def regression(prediction: str) -> str:
    e = f"(clv_next_90d - {prediction})"
    return q(f"""
 select {half_even(f'avg(abs{e})', 2)} as mae, {half_even(f'sqrt(avg({e} * {e}))', 2)} as rmse,
        {half_even(f'1.0::double - avg({e} * {e}) / var_pop(clv_next_90d)', 4)} as r2 from scored""")


PCT = "printf('%.1f', 100.0::double * p) || '%'"
MONEY = "format('{:,.2f}', %s)"

ORACLE = {
    "split_assign": q("select customer_id, churn, split from churn_split"),
    "split_assign_clv": q("select customer_id, split from clv_split"),
    "scaled_features": q(f"select customer_id, split, {', '.join(half_even(z(c), 6) + f' as {c}' for c in INPUTS)} from churn_split, churn_stats"),
    "scaled_cohort": q(f"select customer_id, {', '.join(half_even(z(c), 6) + f' as {c}' for c in ANOMALY)} from features, anomaly_stats"),
    "class_weights": q(f"select churn, count(*)::bigint as n, {half_even('sum(count(*)) over () / (count(*) over () * count(*))', 6)} as weight from features group by churn"),
    "classifier_metrics": q(f"""
 select {half_even('(tp + tn)::double / (tp + fp + tn + fn)', 4)} as accuracy, {half_even('case when tp + fp > 0 then tp::double / (tp + fp) else 0 end', 4)} as precision,
        {half_even('case when tp + fn > 0 then tp::double / (tp + fn) else 0 end', 4)} as recall,
        {half_even('case when 2 * tp + fp + fn > 0 then 2.0::double * tp / (2 * tp + fp + fn) else 0 end', 4)} as f1,
        (select {half_even(AUC, 4)} from positions) as roc_auc,
        tp as true_positives, fp as false_positives, tn as true_negatives, fn as false_negatives
 from (select {CONFUSION} from scored)"""),
    "tree_additivity": q("select customer_id, true as adds_up from features"),
    "kmeans_membership": q("select customer_id, 1::bigint as clusters, 1::bigint as names, true as name_of_cluster from features"),
    "anomaly_consistency": q("select customer_id, true as not_negative, true as flag_95, true as flag_99, true as nested from features"),
    "prediction_totals": q("select model, split, churn::int as churn, count(*) as n from churn_split, (values ('churn_lr'), ('churn_tree'), ('churn_rf')) m(model) group by all"),
    "model_pick": q("select model, target, test_value as quality from registry where place = 1"),
    "model_registry": q("select *, place = 1 as active from registry"),
    "exact_auc": q(f"select {half_even(AUC, 9)} as roc_auc from positions"),
    "regressor_metrics": regression("clv"),
    "regressor_metrics_log": regression("greatest(exp(least(greatest(ln(1.0::double + clv), 0.0::double), 15.0::double)) - 1.0::double, 0.0::double)"),
    "knn_vote": q(f"""
 select qid as customer_id, {half_even('case when count(*) filter (where d = 0) > 0 then avg(y) filter (where d = 0) else sum(y / d) / sum(1.0::double / d) end', 6)} as probability
 from knn_near where place <= 15 group by qid"""),
    "ridge_gram": q(f"""
 select {GRAM!r}[i] as row_name, {GRAM!r}[j] as column_name, {half_even('sum(x[i] * x[j])', 6)} as value
 from gram_x, range(1, {len(GRAM) + 1}) a(i), range(1, {len(GRAM) + 1}) b(j) group by i, j"""),
    "purchase_sequences": q(f"""
 select customer_id, position::int as position, {half_even('coalesce(amount, 0.0::double)', 6)} as amount, {half_even('coalesce(gap, 0.0::double)', 6)} as gap,
        {half_even('coalesce(quantity, 0.0::double)', 6)} as quantity, {half_even('coalesce(is_return, 0.0::double)', 6)} as is_return
 from (select c.customer_id, position, s.* exclude (customer_id) from (select distinct customer_id from observed) c
       cross join range(1, 7) r(position) left join order_steps s on s.customer_id = c.customer_id and s.back = 7 - position)"""),
    "anomaly_thresholds": q(f"""
 select {half_even('median(error)', 4)} as median_error, {half_even('quantile_cont(error, 0.95)', 4)} as threshold_p95,
        {half_even('quantile_cont(error, 0.99)', 4)} as threshold_p99, {half_even('quantile_cont(error, 0.95)', 4)} as threshold,
        {half_even('max(error)', 4)} as max_error,
        count(*) filter (where error > (select quantile_cont(error, 0.95) from deviation))::bigint as anomalous_accounts_count from deviation"""),
    "silhouette_fixed": q(f"""
 select {half_even('avg(case when n_own = 1 then 0.0::double when a < b then 1.0::double - a / b else b / a - 1.0::double end)', 6)} as silhouette_sq from (
  select customer_id, max(n) filter (where own = other) as n_own,
         max(total / nullif(n - 1, 0)) filter (where own = other) as a, min(total / n) filter (where own <> other) as b
  from profile_to_cluster group by customer_id)"""),
    "davies_bouldin_fixed": q(f"""
 select {half_even('avg(worst)', 6)} as davies_bouldin from (
  select a.cluster_id, max((a.s + b.s) / list_distance(a.center, b.center)) as worst
  from spreads a join spreads b on a.cluster_id <> b.cluster_id group by 1)"""),
    "segment_profile": q("select * from profile"),
    "persona_rules": q("select cluster_id, segment_name, case segment_name " + " ".join(f"when '{k}' then '{v}'" for k, v in STRATEGY.items())
                       + " else 'Targeted engagement campaigns.' end as recommended_strategy from personas"),
    "linear_attribution": q(f"select customer_id, feature, value, {half_even('attribution', 6)} as attribution from attributions"),
    "global_importance": q(f"select feature, {half_even('avg(abs(attribution))', 6)} as importance from attributions group by 1"),
    "top_factors": q("""
 select customer_id, place::int as place, feature, value, attribution,
        case when attribution > 0 then 'Increases Risk' else 'Decreases Risk (Protective)' end as direction from rounded_factors"""),
    "representatives": q(f"""
 select 'low_risk' as profile, customer_id, p as churn_probability from (select customer_id, {half_even('p', 9)} as p from scored order by p, customer_id limit 1)
 union all select 'borderline', customer_id, p from (select customer_id, {half_even('p', 9)} as p from scored order by abs(p - 0.5::double), customer_id limit 1)
 union all select 'high_risk', customer_id, p from (select customer_id, {half_even('p', 9)} as p from scored order by p desc, customer_id limit 1)"""),
    "narrative": q(f"""
 select s.customer_id, 'Customer #' || s.customer_id || ' is evaluated as **' ||
   case when p >= 0.75 then 'High Churn Risk' when p >= 0.45 then 'Borderline / Moderate Risk' else 'Healthy / Low Risk' end ||
   '** with a predicted churn probability of **' || {PCT} || '**.' ||
   coalesce(' The primary factors driving this risk are **' || drivers || '**.', '') ||
   coalesce(' Conversely, the customer''s risk is mitigated by **' || shields || '**.', '') || ' ' ||
   case when p >= 0.75 then 'Immediate proactive retention outreach is recommended.'
        when p >= 0.45 then 'Proactive monitoring and targeted re-engagement campaigns are advised.'
        else 'Customer is in good standing; focus on loyalty rewards and cross-sell.' end as narrative
 from scored s join (
  select customer_id,
   string_agg(case when feature = 'recency_days' then printf('%.0f', value) || ' days of inactivity' else 'total lifetime order count (' || value::varchar || ')' end, ' and ' order by place) filter (where attribution > 0) as drivers,
   string_agg(case when feature = 'frequency' then 'a history of ' || printf('%.0f', value) || ' completed orders' else 'days since last purchase (' || value::varchar || ')' end, ' and ' order by place) filter (where attribution < 0) as shields
  from rounded_factors group by 1) f on s.customer_id = f.customer_id"""),
    "playbook": q(f"""
 select customer_id, case
  when p >= 0.7 then '🚨 **High Churn Risk (' || {PCT} || '):** Customer #' || customer_id || ' has been inactive for ' || printf('%.0f', recency_days)
   || ' days with order velocity decaying significantly compared to their historical pace (' || printf('%.0f', frequency::double)
   || ' total orders). **Prescribed Action:** Deploy an immediate win-back incentive (e.g., 15% promotional discount on previously purchased categories) before day 90 to prevent a permanent loss of £'
   || {MONEY % 'clv'} || ' in forward value.'
  when p >= 0.4 then '⚠️ **Moderate Churn Risk (' || {PCT} || '):** Customer #' || customer_id || ' represents a steady regular buyer (' || printf('%.0f', frequency::double)
   || ' lifetime orders, £' || {MONEY % 'total_spend'} || ' spend) showing slight elongation between purchase cycles (' || printf('%.0f', recency_days)
   || ' days recency). **Prescribed Action:** Schedule a personalized replenishment reminder or loyalty tier upgrade to re-engage active browsing.'
  else '🌟 **High Engagement & Low Risk (' || {PCT} || '):** Customer #' || customer_id || ' is an active, high-value account (' || printf('%.0f', frequency::double)
   || ' orders, £' || {MONEY % 'total_spend'} || ' spend) with strong recent activity (' || printf('%.0f', recency_days)
   || ' days recency). **Prescribed Action:** Include in VIP exclusive early-access product drops and cross-sell premium complementary catalogue items.' end as playbook
 from scored"""),
}
