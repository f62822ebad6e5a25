"""Checks of studies around the models."""

from __future__ import annotations

from oracle.base import BEHAVIOR, RFM, VELOCITY, half_even, with_ctes
from oracle.models import EXTRA as MODEL_CTES

BACKTEST_DAYS = (90, 120, 180, 270, 365)
BACKTEST = [c for c in RFM + VELOCITY + BEHAVIOR if c != "discount_sensitivity"] + ["churn", "clv_next_90d", "target_orders_count"]


def at_cutoff(days_before: int) -> str:
    """A separate run at one cutoff."""
    return with_ctes(f"select t as cutoff, customer_id, {', '.join(BACKTEST)} from features, cutoff", {
        "cutoff": f"select max(invoice_date) - interval {days_before} day as t from cleaned"})


EXTRA = {
    **MODEL_CTES,
    "folds": """
 select *, ((row_number() over (partition by churn order by md5(customer_id::varchar || ':fold:42'), customer_id) - 1) % 5)::int as fold from churn_train""",
    "tried": " union all ".join(
        f"select customer_id, churn, fold, 'divisor_{n:02d}' as candidate, recency_days / 100.0::double - frequency / {n}.0::double as margin from folds"
        for n in (2, 5, 10, 20)),
    "tried_places": """
 select *, rank() over (partition by candidate, fold order by margin) + (count(*) over (partition by candidate, fold, margin) - 1) / 2.0::double as r from tried""",
    "aucs": """
 select candidate, fold, (sum(r) filter (where churn = 1) - count(*) filter (where churn = 1) * (count(*) filter (where churn = 1) + 1) / 2.0::double)
   / (count(*) filter (where churn = 1) * count(*) filter (where churn = 0)) as auc from tried_places group by all""",
    "round_1": "select candidate, auc as m, row_number() over (order by auc desc, candidate) as place from aucs where fold = 0",
    "round_2": """
 select candidate, avg(auc) as m, row_number() over (order by avg(auc) desc, candidate) as place from aucs
 where fold <= 1 and candidate in (select candidate from round_1 where place <= 2) group by candidate""",
    "every_row": "select customer_id, split, primary_country, churn, fold from folds union all select customer_id, split, primary_country, churn, null from churn_split where split <> 'train'",
    "of_country": """
 select e.customer_id, e.split, count(f.customer_id) as n, coalesce(sum(f.churn), 0)::double as total from every_row e
 left join folds f on f.primary_country is not distinct from e.primary_country and f.fold is distinct from e.fold group by 1, 2""",
    "of_rows": """
 select e.customer_id, (select count(*) from folds f where f.fold is distinct from e.fold) as n, (select sum(churn) from folds f where f.fold is distinct from e.fold) as total
 from every_row e""",
    "levels": """
 select level, row_number() over (order by n desc, level) as nr from (select primary_country as level, count(*) as n from churn_train where primary_country is not null group by 1)
 order by nr limit 3""",
    "margin_counts": "select least(greatest(floor(margin / 0.5::double), -20), 20)::int as bucket, count(*) as n, sum(churn) as positives from scored group by 1",
    # the closest rising rates: the largest, over beginnings up to a bucket, of the smallest means up to ends from it on
    "margin_means": """
 select a.bucket as i, b.bucket as j, sum(c.positives)::double / sum(c.n) as avg_rate from margin_counts a join margin_counts b on a.bucket <= b.bucket
 join margin_counts c on c.bucket between a.bucket and b.bucket group by 1, 2""",
    "order_bins": "select customer_id, (date_diff('day', order_date::date, t::date) // 30)::bigint as back from order_table, cutoff",
    "bin_numbers": "select customer_id, max(back) + 1 as bins, count(*) as orders from order_bins group by 1",
    "every_bin": "select customer_id, bins, orders, unnest(range(bins)) as bin from bin_numbers",
    "filled_bins": """
 select e.customer_id, any_value(e.bins) as bins, any_value(e.orders) as orders, e.bin, count(b.back) as y from every_bin e
 left join order_bins b on b.customer_id = e.customer_id and e.bins - 1 - b.back = e.bin group by e.customer_id, e.bin""",
    "months": "select date_trunc('month', invoice_date)::date as month, sum(total_amount::decimal(18,2))::double as revenue from cleaned group by 1",
    "every_month": """
 select g.month, coalesce(revenue, 0.0::double) as revenue, row_number() over (order by g.month) - 1 as nr
 from (select unnest(range(min(month), max(month) + interval 1 month, interval 1 month))::date as month from months) g left join months using (month)""",
    "category_spend": """
 select customer_id, invoice, stock_code[1:2] as category, sum(total_amount::decimal(18,2)) as spend, min(invoice_date) as line_at, (invoice_date <= t) as seen
 from cleaned, cutoff where not is_return and stock_code is not null group by customer_id, invoice, category, seen""",
    "order_category": """
 select customer_id, invoice, seen, min(line_at) as order_date, first(category order by spend desc, category) as category from category_spend group by 1, 2, 3""",
    "moves": """
 select customer_id, category, lead(category) over (partition by customer_id order by order_date, invoice) as next,
        row_number() over (partition by customer_id order by order_date desc, invoice desc, category desc) as back from order_category where seen""",
    "own_moves": "select customer_id, category, next, count(*) as n from moves where next is not null group by all",
    "tier_moves": "select engagement_tier as segment, category, next, count(*) as n from moves join features using (customer_id) where next is not null group by all",
    "all_moves": "select category, next, count(*) as n from moves where next is not null group by all",
    "own_best": "select customer_id, category, sum(n) as n, first(next order by n desc, next) as best from own_moves group by 1, 2",
    "tier_best": "select segment, category, sum(n) as n, first(next order by n desc, next) as best from tier_moves group by 1, 2",
    "all_best": "select category, first(next order by n desc, next) as best from all_moves group by 1",
    "next_actual": "select customer_id, first(category order by order_date, invoice, category) as actual from order_category where not seen group by 1",
}


def q(sql: str) -> str:
    return with_ctes(sql, EXTRA)


GRID = {"recency_days": (30, 90, 150, 365), "frequency": (1, 2, 3, 5, 8), "total_spend": (100, 500, 1000)}


def margin(replaced: str, value: float) -> str:
    r, f, t = (f"{value}.0::double" if c == replaced else c for c in GRID)
    return (f"case when {r} <= 90 then case when {f} <= 5 then -0.2::double else -0.8::double end "
            f"else case when {f} <= 2 then 1.0::double else 0.4::double end end "
            f"+ case when {t} <= 500 then 0.3::double when {r} <= 200 then -0.4::double else 0.1::double end")


ORACLE = {
    "backtest": " union all ".join(f"select * from ({at_cutoff(n)})" for n in BACKTEST_DAYS),
    "cv_folds": q("select customer_id, churn, fold from folds"),
    "halving_search": q(f"""
 select place::int as place, candidate, folds::int as folds, {half_even('m', 9)} as mean_auc from (
  select 1 as place, candidate, 5 as folds, avg(auc) as m from aucs where candidate = (select candidate from round_2 where place = 1) group by candidate
  union all select 2, candidate, 2, m from round_2 where place = 2
  union all select place, candidate, 1, m from round_1 where place > 2)"""),
    "target_encoding": q(f"""
 select c.customer_id, c.split, {half_even('(c.total + 20.0::double * (r.total::double / r.n)) / (c.n + 20.0::double)', 9)} as country_rate
 from of_country c join of_rows r on c.customer_id = r.customer_id"""),
    "hot_codes": q("""
 select customer_id, string_agg(coalesce(primary_country = level, false)::int::varchar, '' order by nr)
   || (not bool_or(coalesce(primary_country = level, false)))::int::varchar as codes from features cross join levels group by customer_id"""),
    "partial_dependence": q(" union all ".join(
        f"select '{c}' as feature, {v}.0::double as value, {half_even(f'avg({margin(c, v)})', 9)} as margin from features" for c, values in GRID.items() for v in values)),
    "frequency_slope": q(f"""
 select customer_id, any_value(bins)::bigint as bins, any_value(orders)::bigint as orders,
        {half_even('case when any_value(bins) > 1 then regr_slope(y, bin) else 0.0::double end', 9)} as slope from filled_bins group by customer_id"""),
    "revenue_forecast": with_ctes(f"""
 select month, {half_even('revenue', 4)} as revenue, {half_even('level', 4)} as level, {half_even('case when nr >= 3 then forecast end', 4)} as forecast,
        {half_even('case when nr >= 3 then abs(revenue - forecast) end', 4)} as abs_error
 from (select * from smoothed union all
       select (max(month) + interval 1 month)::date, null, null, first(level order by nr desc), max(nr) + 1 from smoothed)""", EXTRA | {"smoothed": """
 select month, revenue, revenue as level, null::double as forecast, nr from every_month where nr = 0
 union all
 select e.month, e.revenue, 0.3::double * e.revenue + 0.7::double * s.level, s.level, e.nr from smoothed s join every_month e on e.nr = s.nr + 1"""}).replace("with ", "with recursive ", 1),
    "smote_rows": q("""
 select customer_id, synthetic, true as on_segment, true as own_class from (
  select customer_id, (wanted // size + (place <= wanted % size)::int)::bigint as synthetic from (
   select customer_id, row_number() over (order by md5(customer_id::varchar || ':quota:42'), customer_id) as place, count(*) over () as size,
          (select count(*) from churn_train) - 2 * count(*) over () as wanted
   from churn_train where churn = (select churn from churn_train group by 1 order by count(*), churn limit 1))) where synthetic > 0"""),
    "margin_calibration": q(f"""
 select k.bucket, {half_even('max(worst)', 9)} as rate from margin_counts k join (
   select i.bucket as i, m.bucket as m, min(avg_rate) as worst from margin_counts i join margin_counts m on i.bucket <= m.bucket
   join margin_means a on a.i = i.bucket and a.j >= m.bucket group by 1, 2) w on w.m = k.bucket group by k.bucket"""),
    "next_category": q("""
 select m.customer_id, m.category as last_category, case when o.n >= 5 then o.best when t.n >= 5 then t.best else a.best end as predicted,
        case when o.n >= 5 then 'customer' when t.n >= 5 then 'segment' when a.best is not null then 'all' end as source, x.actual
 from moves m left join features f on f.customer_id = m.customer_id left join own_best o on o.customer_id = m.customer_id and o.category = m.category
 left join tier_best t on t.segment = f.engagement_tier and t.category = m.category left join all_best a on a.category = m.category
 left join next_actual x on x.customer_id = m.customer_id where back = 1"""),
}
