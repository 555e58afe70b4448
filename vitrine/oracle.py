"""Independent DuckDB SQL for every registered query.

The driver registers only its own tables, so every statement inlines the
FIXTURES.md §2 mapping blocks as CTEs, then the wide-table chain, then the
metric.  Written from the reference semantics, not from the Spark code:
windows where the Spark side uses aggregates + joins, NTILE-style
``row_number`` where the Spark side uses block prefix sums.
"""

from __future__ import annotations

from vitrine.params import Params

# FIXTURES.md §2 mapping blocks (stand-in marketplace views);
# money columns cast to decimal(18,2) as in ``vitrine.sources.fixtures``.
VIEWS = {
    "f_orders": """
select o_orderkey as order_id, o_custkey as customer_id,
       case o_orderstatus when 'F' then 'delivered' when 'O' then 'shipped' else 'canceled' end as order_status,
       o_orderdate as order_purchase_timestamp
from orders""",
    "f_order_items": """
select l_orderkey as order_id, l_linenumber as order_item_id, l_partkey as product_id, l_suppkey as seller_id,
       l_shipdate as shipping_limit_date, cast(l_extendedprice as decimal(18,2)) as price,
       cast(l_quantity as decimal(18,2)) as freight_value
from lineitem""",
    "f_payments": """
select (event_id * 104729) % (select cast(count(*) * 0.2 as bigint) from orders) as order_id,
       case event_type when 'click' then 'credit_card' when 'view' then 'boleto' when 'purchase' then 'voucher'
                       when 'signup' then 'debit_card' else 'not_defined' end as payment_type,
       cast(value as decimal(18,2)) as payment_value
from events""",
    "f_reviews": """
select event_id as review_id,
       cast(floor(cast(event_id as double) * 0.4) as bigint) as order_id,
       case when event_id % 23 = 0 then null else 1 + cast(floor(value) as int) % 5 end as review_score,
       cast(date_trunc('day', ts) as timestamp) + interval '1' day * cast(floor((event_id % 7) / 3.0) as int) as review_creation_date,
       cast(date_trunc('day', ts) as timestamp) + interval '1' day * cast(3 + floor((event_id % 4) / 2.0) as int) as review_answer_timestamp
from events""",
    "f_products": """
select p_partkey as product_id, nullif(p_type, 'STANDARD') as product_category_name,
       nullif(p_size % 8, 0) as product_photos_qty,
       case when p_partkey % 50 = 0 then null else 100 + (p_partkey * 37) % 3000 end as product_description_lenght
from part""",
    "f_customers": """
select c_custkey as customer_id, n_name as customer_state from customer join nation on c_nationkey = n_nationkey""",
    "f_sellers": """
select s_suppkey as seller_id, n_name as seller_state from supplier join nation on s_nationkey = n_nationkey""",
    "f_states": """
select n_name as Sigla, lower(n_name) as Estado, r_name as Region from nation join region on n_regionkey = r_regionkey""",
    "f_state_map": """
select n_name as nome, concat('POINT(', cast(n_nationkey as varchar(10)), ' 0)') as geometry from nation""",
    "f_order_times": """
select order_id, try_cast(t0 as timestamp) as order_purchase_timestamp, try_cast(t1 as timestamp) as order_approved_at,
       try_cast(t2 as timestamp) as order_delivered_carrier_date, try_cast(t3 as timestamp) as order_delivered_customer_date,
       try_cast(t4 as timestamp) as order_estimated_delivery_date
from (select o_orderkey as order_id, cast(cast(o_orderdate as date) as varchar) || ' 00:00:00' as t0,
             case when o_orderkey % 17 = 0 then 'bad'
                  else cast(cast(o_orderdate as date) + cast(o_orderkey % 3 as int) as varchar) || ' 10:30:00' end as t1,
             case when o_orderkey % 19 = 0 then '2020-13-45 00:00:00'
                  else cast(cast(o_orderdate as date) + cast(1 + o_orderkey % 4 as int) as varchar) || ' 08:00:00' end as t2,
             case when o_orderkey % 23 = 0 then '' when o_orderkey % 29 <> 0
                  then cast(cast(o_orderdate as date) + cast(4 + o_orderkey % 10 as int) as varchar) || ' 17:45:10' end as t3,
             cast(cast(o_orderdate as date) + cast(10 + o_orderkey % 5 as int) as varchar) as t4
      from orders) x""",
    "f_part_scenarios": """
select cast(p_partkey as bigint) as scenario_id, cast(nullif(p_size % 9, 0) as int) as fotos,
       cast(case when p_partkey % 40 <> 0 then (p_partkey * 53) % 4000 end as int) as caracteres,
       1.0::double + cast(p_partkey % 20 as double) * 0.5 as frete
from part""",
    "f_scenarios": """
select * from (values (1, 3, 1000, 2.5), (2, 1, 100, 10.0), (3, 6, 500, 10.0), (4, 7, 3099, 1.0), (5, cast(null as int), 700, 1.0))
  as t(scenario_id, fotos, caracteres, frete)""",
}

WIDE_CTES = {
    "rev": """
select review_id, order_id, review_score, review_creation_date, review_answer_timestamp from (
  select *, max(review_creation_date) over (partition by order_id) as mc,
            max(review_answer_timestamp) over (partition by order_id) as ma
  from f_reviews) t
where review_creation_date = mc and review_answer_timestamp = ma""",
    "pay": """
select order_id,
       sum(case when payment_type = 'credit_card' then payment_value end) as credit_card,
       sum(case when payment_type = 'boleto' then payment_value end) as boleto,
       sum(case when payment_type = 'voucher' then payment_value end) as voucher,
       sum(case when payment_type = 'debit_card' then payment_value end) as debit_card
from f_payments where payment_type <> 'not_defined' group by order_id""",
}


def _sql_list(values) -> str:
    out = []
    for v in values:
        out.append("'" + str(v).replace("'", "''") + "'" if isinstance(v, str) else str(v))
    return ", ".join(out)


def wide_cte(statuses=("delivered",)) -> str:
    status = f"where o.order_status in ({_sql_list(statuses)})" if statuses else ""
    return f"""
select o.order_id, o.customer_id, o.order_status, o.order_purchase_timestamp,
       i.order_item_id, i.product_id, i.seller_id, i.shipping_limit_date, i.price, i.freight_value,
       i.price + i.freight_value as total_price,
       r.review_id, r.review_score, r.review_creation_date, r.review_answer_timestamp,
       p.credit_card, p.boleto, p.voucher, p.debit_card,
       case when p.order_id is null then null else
         coalesce(p.credit_card, 0) + coalesce(p.boleto, 0) + coalesce(p.voucher, 0)
             + coalesce(p.debit_card, 0) end as total_payment_value,
       pr.product_category_name, pr.product_photos_qty, pr.product_description_lenght,
       c.customer_state, s.Estado, s.Region
from f_orders o
join f_order_items i on i.order_id = o.order_id
join rev r on r.order_id = o.order_id and r.review_score is not null
left join pay p on p.order_id = o.order_id
left join f_products pr on pr.product_id = i.product_id
left join f_customers c on c.customer_id = o.customer_id
left join f_states s on s.Sigla = c.customer_state
{status}"""


def selected_cte(p: Params) -> str:
    good = _sql_list(p.good_scores)
    conds = ["true"]
    if p.regions is not None:
        conds.append(f"Region in ({_sql_list(p.regions)})")
    if p.price_range is not None:
        lo, hi = p.price_range
        conds.append(f"total_price >= {lo!r} and total_price <= {hi!r}" if p.closed
                     else f"total_price > {lo!r} and total_price < {hi!r}")
    if p.merge_categories:
        cat = (f"case when product_category_name in ({_sql_list(p.merge_categories)}) "
               f"then '{p.new_category_name}' else product_category_name end")
    else:
        cat = "product_category_name"
    return f"""
select * replace ({cat} as product_category_name),
       case when review_score in ({good}) then 'alta' else 'baixa' end as review_simple
from items_wide where {' and '.join(conds)}"""


def with_ctes(body: str, p: Params | None = None, views=None, statuses=("delivered",),
              wide: bool = True, extra: dict[str, str] | None = None) -> str:
    """Prefix ``body`` with the mapping views (+ wide table, + selected/focus, + extra CTEs)."""
    names = list(views) if views is not None else [
        "f_orders", "f_order_items", "f_payments", "f_reviews", "f_products", "f_customers", "f_states"]
    parts = [f"{n} as ({VIEWS[n]})" for n in names]
    if wide:
        parts += [f"{n} as ({WIDE_CTES[n]})" for n in ("rev", "pay")]
        parts.append(f"items_wide as ({wide_cte(statuses)})")
        if p is not None:
            parts.append(f"selected as ({selected_cte(p)})")
            parts.append(f"focus as (select * from selected where product_category_name = "
                         f"'{p.new_category_name}')")
    parts += [f"{n} as ({q})" for n, q in (extra or {}).items()]
    return "with " + ",\n".join(parts) + "\n" + body
