"""Shared parts of the checking SQL: raw lines, cleaned lines, customer features.

Written for DuckDB over the plain test tables; every statement starts from
those tables, so it does not depend on anything Spark has computed.
"""

from __future__ import annotations

import re


def half_even(x: str, digits: int) -> str:
    s = f"{10 ** digits}.0::double"
    return f"(round_even(({x})::double * {s}, 0) / {s} + 0.0::double)"


def exact(x: str, digits: int) -> str:
    """Half-even on the exact binary value: C formatting does that."""
    return f"(printf('%.{digits}f', ({x})::double)::double + 0.0::double)"


def days(a: str, b: str) -> str:
    return f"(date_diff('microsecond', {a}, {b})::double / 86400000000.0::double)"


def money_sum(x: str = "total_amount", where: str = "") -> str:
    f = f" filter (where {where})" if where else ""
    return f"sum(({x})::decimal(18,2)){f}::double"


CTES: dict[str, str] = {}

# Fixed text: the raw lines view over the test tables.
CTES["base"] = """
 select l_orderkey, l_linenumber, l_suppkey, l_partkey, l_quantity, l_extendedprice, l_returnflag, l_linestatus,
        o_orderdate, o_custkey, n_nationkey, n_name, p_name, p_brand
 from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey
 join nation on c_nationkey = n_nationkey join part on l_partkey = p_partkey"""
CTES["rows1"] = """
 select case when l_returnflag='R' and l_linestatus='F' then concat('C', cast(l_orderkey as string)) else cast(l_orderkey as string) end as invoice,
  case when l_suppkey % 50 = 0 then 'POST' when l_suppkey % 50 = 1 then 'BANK CHARGES' when l_suppkey % 50 = 2 then 'm '
       else concat(lpad(regexp_extract(p_brand,'([0-9]+)',1),2,'0'), lpad(cast(l_partkey as string),6,'0')) end as stock_code,
  case when l_linenumber = 5 then '' when l_linenumber = 2 then concat(p_name,' v2') when l_linenumber = 3 then concat('  ',upper(p_name)) else p_name end as description,
  case when l_orderkey % 1000 = 7 then l_quantity * 1000 when l_linenumber = 7 and l_orderkey % 10 = 1 then 0.0
       when l_returnflag='R' and l_linestatus='O' and l_partkey % 4 <> 0 then -l_quantity else l_quantity end as quantity,
  o_orderdate as invoice_date,
  case when l_partkey % 97 = 0 then 0.0 else l_extendedprice end as price,
  case when l_orderkey % 20 = 0 then cast(null as bigint) else o_custkey end as customer_id,
  case when n_nationkey = 0 or l_linenumber = 7 then 'United Kingdom' else n_name end as country, l_orderkey
 from base"""
CTES["raw_transactions"] = """
 select invoice, stock_code, description, quantity, invoice_date, price, customer_id, country from rows1
 union all
 select invoice, stock_code, description, quantity, invoice_date, price, customer_id, country from rows1 where l_orderkey % 25 = 3"""

CTES["with_customer"] = "select * from raw_transactions where customer_id is not null"
CTES["with_price"] = "select * from with_customer where price >= 0.001"
CTES["with_quantity"] = "select * from with_price where quantity is distinct from 0"
CTES["with_returns"] = """
 select invoice, stock_code, description,
        case when (invoice like 'C%' or quantity < 0) and quantity > 0 then -quantity else quantity end as quantity,
        invoice_date, price, customer_id, country, (invoice like 'C%' or quantity < 0) as is_return
 from with_quantity"""
CTES["without_admin"] = """
 select * from with_returns
 where not (upper(trim(stock_code)) in ('POST','D','M','PADS','DOT','CRUK','BANK CHARGES','TEST','AMAZONFEE')
            or upper(trim(stock_code)) like 'POST%' or upper(trim(stock_code)) like 'BANK%' or upper(trim(stock_code)) like 'CRUK%')"""
CTES["numbered"] = """
 select *, row_number() over (partition by invoice, stock_code, description, quantity, invoice_date, price, customer_id order by country) as rn
 from without_admin"""
CTES["distinct_lines"] = "select * exclude (rn) from numbered where rn = 1"
CTES["spelling"] = """
 select stock_code, upper(trim(description)) as d, count(*) as n from distinct_lines
 where length(trim(description)) > 2 group by 1, 2"""
CTES["modes"] = """
 select stock_code, d from (
   select *, row_number() over (partition by stock_code order by n desc, d) as rn from spelling) where rn = 1"""
CTES["named"] = f"""
 select invoice, t.stock_code, coalesce(m.d, upper(trim(description))) as description, quantity, invoice_date, price,
        customer_id, country, {half_even('quantity * price', 2)} as total_amount, is_return
 from distinct_lines t left join modes m on t.stock_code = m.stock_code"""
CTES["bounds"] = """
 select greatest(q3q + 5.0::double * (q3q - q1q), 5000.0::double) as max_quantity,
        greatest(q3p + 5.0::double * (q3p - q1p), 2000.0::double) as max_price
 from (select quantile_cont(quantity, 0.25) as q1q, quantile_cont(quantity, 0.75) as q3q,
              quantile_cont(price, 0.25) as q1p, quantile_cont(price, 0.75) as q3p
       from distinct_lines where not is_return)"""
CTES["cleaned"] = """
 select n.* from named n, bounds b where not (abs(quantity) > b.max_quantity or price > b.max_price)"""
CTES["cutoff"] = "select max(invoice_date) - interval 90 day as t from cleaned"
CTES["observed"] = "select c.* from cleaned c, cutoff where invoice_date <= t"
CTES["sales"] = "select * from observed where not is_return"

CTES["product_price"] = """
 select stock_code, (max(price) filter (where rn = (n + 1) // 2) + max(price) filter (where rn = n // 2 + 1)) / 2.0::double as reference_price
 from (select stock_code, price, row_number() over (partition by stock_code order by price) as rn,
              count(*) over (partition by stock_code) as n from sales)
 group by stock_code"""
CTES["line_sums"] = f"""
 select customer_id, max(invoice_date) filter (where not is_return) as last_sale,
        count(distinct invoice) filter (where not is_return) as orders,
        {money_sum(where='not is_return')} as gross, {money_sum()} as net,
        {money_sum(where='is_return')} as returned,
        {money_sum(where='not is_return and month(invoice_date) >= 10')} as q4,
        count(distinct invoice) filter (where not is_return and month(invoice_date) >= 10) as q4_orders,
        sum(quantity) filter (where not is_return) as items,
        count(distinct stock_code) filter (where not is_return) as products,
        count(*) as lines, count(*) filter (where is_return) as return_lines,
        {", ".join(money_sum(where=f"not is_return and stock_code[1:2] = '{c}'") + f" as cat_{c}" for c in ('22', '21', '85', '84', '23', '20'))}
 from observed group by customer_id"""
CTES["discounts"] = """
 select customer_id, count(*) filter (where price < reference_price * 0.90::double)::double / count(*) as share
 from sales join product_price using (stock_code) group by customer_id"""
CTES["order_table"] = """
 select customer_id, invoice, min(invoice_date) as order_date from sales group by customer_id, invoice"""
CTES["gaps"] = f"""
 select customer_id, order_date, {days("lag(order_date) over (partition by customer_id order by order_date, invoice)", "order_date")} as gap
 from order_table"""
CTES["pace"] = f"""
 select customer_id, greatest({days('min(order_date)', 'max(t)')}, 1.0::double) as tenure,
        {days('min(order_date)', 'max(order_date)')} as span, count(*) as n, avg(gap) as gap_mean,
        count(gap) as n_gaps, stddev_pop(gap) as gap_sd,
        count(*) filter (where order_date >= t - interval 90 day) as recent
 from gaps, cutoff group by customer_id"""
CTES["velocity"] = f"""
 select customer_id, {exact('tenure', 1)} as tenure_days, {exact('span', 1)} as days_active_span,
        {exact('coalesce(gap_mean, tenure)', 2)} as inter_purchase_mean,
        {exact('case when n_gaps > 1 then gap_sd else 0.0::double end', 2)} as inter_purchase_std,
        (n = 1)::int as is_single_order, recent::bigint as recent_orders_last_90d,
        {exact('recent::double / n', 4)} as recent_orders_ratio,
        {exact('least(greatest(recent / greatest(n::double / tenure * 90.0::double, 0.1::double), 0.0::double), 10.0::double)', 4)} as velocity_acceleration
 from pace"""
CTES["countries"] = """
 select customer_id, country as primary_country, (country = 'United Kingdom')::int as is_uk from (
   select *, row_number() over (partition by customer_id order by n desc, country) as rn
   from (select customer_id, country, count(*) as n from observed group by 1, 2)) where rn = 1"""
CTES["rfm"] = f"""
 select customer_id, case when last_sale is not null then greatest(0.0::double, {days('last_sale', 't')}) end as recency_days,
        nullif(orders, 0)::bigint as frequency, gross as gross_spend, net as total_spend, items as total_items,
        case when orders > 0 then products end::bigint as unique_products_count,
        {half_even('net / nullif(orders, 0)', 2)} as avg_order_value,
        {half_even('items / nullif(orders, 0)', 2)} as avg_basket_size,
        {half_even('products::double / nullif(orders, 0)', 2)} as avg_unique_products_per_order,
        {half_even('ln(1.0::double + greatest(net, 0.0::double))', 4)} as log_total_spend,
        {half_even('ln(1.0::double + nullif(orders, 0))', 4)} as log_frequency
 from line_sums, cutoff"""
CTES["behavior"] = f"""
 select customer_id,
        case when orders > 0 then q4_orders::double / orders end as seasonal_q4_order_share,
        case when orders > 0 then least(greatest(coalesce(coalesce(q4, 0.0::double) / nullif(gross, 0.0::double), 0.0::double), 0.0::double), 1.0::double) end as seasonal_q4_spend_share,
        return_lines::double / lines as return_line_rate,
        case when orders > 0 then least(coalesce(abs(returned) / greatest(gross, 1.0::double), 0.0::double), 1.0::double) else 0.0::double end as return_spend_ratio,
        (return_lines > 0)::int as has_returned,
        {half_even('share', 4)} as discount_sensitivity,
        {", ".join("case when orders > 0 then " + half_even(f"coalesce(cat_{c}, 0.0::double) / greatest(gross, 1.0::double)", 4) + f" end as cat_affinity_{c}" for c in ('22', '21', '85', '84', '23', '20'))},
        primary_country, is_uk
 from line_sums left join discounts using (customer_id) left join countries using (customer_id)"""


def pct_rank(x: str) -> str:
    """Average rank over the non-null count; null for null."""
    return (
        f"case when {x} is not null then (rank() over (order by {x} nulls last) + "
        f"(count(*) over (partition by {x}) - 1) / 2.0::double) / count({x}) over () end"
    )


CTES["ranks"] = f"""
 select customer_id, {pct_rank('recency_days')} as r, {pct_rank('frequency')} as f,
        {pct_rank('greatest(total_spend, 0.0::double)')} as m
 from rfm"""
W = 0.35 + 0.35 + 0.30
CTES["score"] = f"""
 select customer_id, {half_even(f'100.0::double * ({0.35 / W!r}::double * (1.0::double - r) + {0.35 / W!r}::double * f + {0.30 / W!r}::double * m)', 2)} as engagement_score
 from ranks"""
CTES["engagement"] = """
 select customer_id, engagement_score, case when engagement_score is null then 'nan' when engagement_score <= 40 then 'Low'
        when engagement_score <= 70 then 'Medium' else 'High' end as engagement_tier from score"""
CTES["cohort"] = "select distinct customer_id from observed"
CTES["targets"] = f"""
 select customer_id, (coalesce(orders, 0) = 0)::int as churn, greatest(0.0::double, coalesce(net, 0.0::double)) as clv_next_90d,
        coalesce(orders, 0)::bigint as target_orders_count
 from cohort left join (
   select customer_id, count(distinct invoice) filter (where not is_return) as orders, {money_sum()} as net
   from cleaned, cutoff where invoice_date > t and invoice_date <= t + interval 90 day group by customer_id) using (customer_id)"""

RFM = ("recency_days frequency gross_spend total_spend total_items unique_products_count avg_order_value avg_basket_size "
       "avg_unique_products_per_order log_total_spend log_frequency").split()
VELOCITY = ("tenure_days days_active_span inter_purchase_mean inter_purchase_std is_single_order recent_orders_last_90d "
            "recent_orders_ratio velocity_acceleration").split()
BEHAVIOR = ("seasonal_q4_order_share seasonal_q4_spend_share return_line_rate return_spend_ratio has_returned discount_sensitivity "
            "cat_affinity_22 cat_affinity_21 cat_affinity_85 cat_affinity_84 cat_affinity_23 cat_affinity_20").split()
INPUTS = RFM + VELOCITY + BEHAVIOR + ["is_uk", "engagement_score"]
DOUBLE = {"recency_days", "gross_spend", "total_spend", "total_items", "engagement_score", *VELOCITY, *BEHAVIOR,
          *[c for c in RFM if c.startswith(("avg", "log"))]} - {"is_single_order", "recent_orders_last_90d", "has_returned"}


def _filled(c: str) -> str:
    return f"coalesce({c}, {'0.0::double' if c in DOUBLE else '0'}) as {c}"


CTES["features"] = f"""
 select customer_id, {", ".join(_filled(c) for c in RFM + VELOCITY + BEHAVIOR)}, primary_country, {_filled('is_uk')},
        {_filled('engagement_score')}, engagement_tier, churn, clv_next_90d, target_orders_count
 from rfm left join velocity using (customer_id) left join behavior using (customer_id)
 left join engagement using (customer_id) left join targets using (customer_id)"""


def with_ctes(final: str, extra: dict[str, str] | None = None) -> str:
    """``final`` preceded by the CTEs it needs."""
    known = {**CTES, **(extra or {})}
    order: list[str] = []

    def visit(text: str, inside: str | None = None) -> None:
        for name in known:
            if name != inside and name not in order and re.search(rf"\b(from|join|,)\s+{name}\b", text):
                visit(known[name], name)
                if name not in order:
                    order.append(name)

    visit(final)
    if not order:
        return final
    return "with " + ",\n".join(f"{n} as ({known[n]})" for n in order) + "\n" + final
