"""Registry of checked queries: one Spark callable + one DuckDB statement per id.

Each entry reads the driver tables of ``sf_dir`` through the FIXTURES mapping
(``vitrine.sources.fixtures``) and runs one inventory operator over the whole
tables.  Money is decimal(18,2), so sums are exact; ratios and means are
double divisions of exact values, hence bit-identical across engines and
partitionings.  ``rounding`` is only for genuinely floating computations.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitrine.functions import classify, labels
from vitrine.operators import lineage, share
from vitrine.oracle import VIEWS, WIDE_CTES, with_ctes
from vitrine.operators import wide as W
from vitrine.operators.lineage import materialize
from vitrine.params import Params
from vitrine.session import ensure_checkpoint_dir
from vitrine.plans import basket, category, geo, listing, outer, payment, price, profile, text, whatif
from vitrine.sources import fixtures, io

# Stand-in parameters (FIXTURES.md §2): focus = PROMO + SMALL merged into
# "nova_casa", two of five regions, a closed price window, top 3.
DASH = Params(good_scores=(3, 4, 5), regions=("AMERICA", "EUROPE"), price_range=(2000.0, 90000.0),
              merge_categories=("PROMO", "SMALL"), new_category_name="nova_casa", top_n=3)
# Batch script: score 3 is bad, no region/price filter, same merged focus.
SCRIPT = Params(good_scores=(4, 5), merge_categories=("PROMO", "SMALL"),
                new_category_name="nova_casa", top_n=3)


# Money stays decimal(18,2) inside every plan (exact, partition-independent
# sums); registered results present it as double on both sides, so a result
# compares equal however a checker hashes values (Python Decimal vs float).
# The list is checked against the Spark schemas by tests/test_plans.py.
DECIMAL_OUTPUTS = {
    "c12_items_wide": ["price", "freight_value", "total_price", "credit_card", "boleto", "voucher", "debit_card",
                       "total_payment_value"],
    "m1_category_class": ["total_gross_sale"], "m1_category_class_script": ["total_gross_sale"],
    "m3_category_table": ["total_gross_sale"], "m5_m7_focus_kpis": ["gross_sales"],
    "g5_order_totals": ["total_gross_sale"], "m8_basket_buckets": ["total_gross_sale"],
    "m9_basket_histogram": ["total_gross_sale"], "m11_state_metrics": ["gross_sales"],
    "m12_state_metrics_bad": ["gross_sales"], "m12_state_metrics_good": ["gross_sales"],
    "m13_state_map": ["gross_sales"], "m18_payment_method_class": ["gross_sales"],
    "m18_payment_method_class_order_grain": ["gross_sales"],
    "m17_price_quartile_class": ["gross_sales", "min_order", "max_order"],
    "m17_price_quartile_class_script": ["gross_sales", "min_order", "max_order"],
    "m17_price_quartile_class_four_states": ["gross_sales", "min_order", "max_order"],
    "m20_photos_class": ["total_gross_sale"], "m21_sextile_class": ["total_gross_sale"],
    "m22_cell_table": ["gross_sales1"], "c9_full_outer_wide": ["price", "freight_value", "payment_value"],
    "n5_bad_reviews": ["price", "freight_value"], "n5_bad_review_sample": ["price", "freight_value"],
    "g2_payments_per_type": ["value_to_pay"],
    "g3_g4_payments_wide": ["credit_card", "boleto", "voucher", "debit_card", "total_payment_value"],
    "m13_state_map_bad": ["gross_sales"], "m13_state_map_good": ["gross_sales"],
    "m3_category_table_script": ["total_gross_sale"],
    "m17_price_quartile_class_order_grain": ["gross_sales", "min_order", "max_order"],
    "b18_price_bounds": ["min_value", "max_value"],
    "b19_payment_reconciliation": ["order_total_price", "total_payment_value", "diff"],
    "h7_h9_state_money_labels": ["gross_sales"], "h6_h9_column_digits": ["gross_sales"],
}

# Integer columns that hold NULLs (missing listing attributes, outer-join keys)
# are presented as double on both sides: pandas turns them into float64 on one
# engine and nullable Int64 on the other.
_LISTING_INTS = ["product_photos_qty", "product_description_lenght"]
NULLABLE_INT_OUTPUTS = {
    "c12_items_wide": _LISTING_INTS, "q2_description_sextiles": ["product_description_lenght"],
    "m21_sextile_class": ["min_caracters_desc", "max_caracters_desc"],
    "m22_cell_table": ["min_caracters_desc", "max_caracters_desc"],
    "x1_x6_whatif_parts": ["fotos", "caracteres", "best_min_caracters_desc", "best_max_caracters_desc",
                           "best_sales_min_caracters_desc", "best_sales_max_caracters_desc"],
    "x2_cell_bounds": ["fotos", "caracteres", "min_characters", "max_characters"],
    "u1_appended_scenarios": ["order_id", "order_item_id", "review_id", *_LISTING_INTS, "scenario_id"],
    "h15_h18_order_times": ["delivery_days"],
    "x1_x6_whatif": ["fotos", "best_min_caracters_desc", "best_max_caracters_desc",
                     "best_sales_min_caracters_desc", "best_sales_max_caracters_desc"],
    "b16_duplicated_review_orders": ["review_score"],
    "m13_state_map_bad": ["n_orders"], "m13_state_map_good": ["n_orders"],
    "g11_bad_review_score_counts": ["review_score"],
    "c9_full_outer_wide": ["order_id", "customer_id", "order_item_id", "product_id", "seller_id", "review_id",
                           "review_score", *_LISTING_INTS],
    "n5_bad_reviews": ["review_score", *_LISTING_INTS], "n5_bad_review_sample": ["review_score", *_LISTING_INTS],
    "w1_latest_reviews": ["review_score"], "w1_latest_reviews_one_row": ["review_score"],
}


@dataclass
class Query:
    name: str
    spark: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    rounding: dict[str, int] = field(default_factory=dict)

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        df = self.spark(spark, sf_dir)
        as_double = set(NULLABLE_INT_OUTPUTS.get(self.name, []))
        out = []
        for f in df.schema.fields:
            c = F.col(f.name)
            if isinstance(f.dataType, T.DecimalType) or f.name in as_double:
                c = c.cast("double")
            if f.name in self.rounding:
                c = F.round(c, self.rounding[f.name])
            out.append(c.alias(f.name))
        return df.select(*out)

    def oracle(self) -> str | None:
        if self.sql is None:
            return None
        rep = [f"cast({c} as double) as {c}"
               for c in DECIMAL_OUTPUTS.get(self.name, []) + NULLABLE_INT_OUTPUTS.get(self.name, [])]
        rep += [f"round({c}, {d}) as {c}" for c, d in self.rounding.items()]
        if not rep:
            return self.sql
        return f"select * replace ({', '.join(rep)}) from (\n{self.sql}\n) q"


REGISTRY: dict[str, Query] = {}


def register(name: str, sql: str | None, rounding: dict[str, int] | None = None):
    def deco(fn):
        REGISTRY[name] = Query(name, fn, sql, dict(rounding or {}))
        return fn
    return deco


# ---------------------------------------------------------------- shared inputs

def _tables(spark, sf_dir):
    return fixtures.load(spark, sf_dir)


# Base tables are built once per (application, folder) and shared by every
# metric, as the reference builds its item table once for all dashboard
# sessions.  They are written to the reliable checkpoint folder, which cuts the
# 7-table join lineage and survives executor loss.
_SHARED: dict[tuple, DataFrame] = {}


def _listing(spark: SparkSession, sf_dir: str) -> tuple:
    """Path, size and time of every file below a folder: a changed folder is a new one."""
    path = spark._jvm.org.apache.hadoop.fs.Path(sf_dir)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    found = fs.listFiles(path, True)
    out = []
    while found.hasNext():
        f = found.next()
        out.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return tuple(sorted(out))


def shared(spark: SparkSession, key: tuple, build: Callable[[], DataFrame]) -> DataFrame:
    """``key``: a name, the folder and parameters."""
    k = (spark.sparkContext.applicationId, *key, _listing(spark, key[1]))
    if k not in _SHARED:
        _SHARED[k] = materialize(build())
    return _SHARED[k]


def release(spark: SparkSession) -> None:
    """Deletes this application's shared tables and every other table that ``materialize`` wrote for it."""
    for k in [k for k in _SHARED if k[0] == spark.sparkContext.applicationId]:
        del _SHARED[k]
    lineage.release(spark)


def wide_table(spark, sf_dir, statuses=("delivered",), review_mode: str = "both_max") -> DataFrame:
    st = tuple(statuses) if statuses is not None else None
    return shared(spark, ("items_wide", sf_dir, st, review_mode),
                  lambda: W.items_wide(_tables(spark, sf_dir), statuses=statuses, review_mode=review_mode))


def selected(spark, sf_dir, p: Params) -> DataFrame:
    return classify.selected(wide_table(spark, sf_dir, p.statuses, p.review_mode), p)


def focus(spark, sf_dir, p: Params) -> DataFrame:
    wide = wide_table(spark, sf_dir, p.statuses, p.review_mode)
    return classify.selected(wide.filter(classify.in_focus(F.col("product_category_name"), p)), p)


def fixtures_sql(name: str) -> str:
    return VIEWS[name]



# ---------------------------------------------------------------- C12 wide table

register("c12_items_wide", with_ctes("select * from items_wide"))(
    lambda spark, d: wide_table(spark, d).select(*W.WIDE_COLUMNS))

# ---------------------------------------------------------------- M1-M7 categories

M1_SQL = """
select product_category_name, review_simple, total_gross_sale, mean_price, number_products,
       number_products / sum(number_products) over (partition by product_category_name) as percent_notas,
       cast(total_gross_sale as double) / sum(total_gross_sale) over (partition by product_category_name) as percent_sales
from (select product_category_name, review_simple, sum(total_price) as total_gross_sale,
             cast(sum(total_price) as double) / count(total_price) as mean_price, count(*) as number_products
      from selected group by 1, 2) t"""

register("m1_category_class", with_ctes(M1_SQL, DASH))(
    lambda spark, d: category.category_class_summary(selected(spark, d, DASH)))

register("m1_category_class_script", with_ctes(M1_SQL, SCRIPT))(
    lambda spark, d: category.category_class_summary(selected(spark, d, SCRIPT)))

def _top_sql(n: int) -> str:
    return f"""
select product_category_name, total_values from (
  select product_category_name, cast(sum(number_products) as bigint) as total_values,
         rank() over (order by sum(number_products) desc) as rk
  from m1 where product_category_name is not null group by 1) t
where rk <= {n}"""


register("m2_top_categories", with_ctes(_top_sql(DASH.top_n), DASH, extra={"m1": M1_SQL}))(
    lambda spark, d: category.top_categories(category.category_class_summary(selected(spark, d, DASH)),
                                             DASH.top_n))

M3_SQL = """
select product_category_name, sum(total_gross_sale) as total_gross_sale,
       cast(sum(number_products) as bigint) as number_products,
       avg(case when review_simple = 'alta' then percent_notas end) as alta,
       avg(case when review_simple = 'baixa' then percent_notas end) as baixa,
       cast(sum(total_gross_sale) as double) / sum(number_products) as mean_price
from m1 where product_category_name in (select product_category_name from top)
group by 1"""

register("m3_category_table",
         with_ctes(M3_SQL, DASH, extra={"m1": M1_SQL, "top": _top_sql(DASH.top_n)}))(
    lambda spark, d: category.category_table(category.category_class_summary(selected(spark, d, DASH)),
                                             DASH.top_n))

register("m4_share_pivot", with_ctes("""
select product_category_name,
       max(case when review_simple = 'alta' then percent_notas end) as alta,
       max(case when review_simple = 'baixa' then percent_notas end) as baixa
from m1 group by 1""", SCRIPT, extra={"m1": M1_SQL}))(
    lambda spark, d: category.share_pivot(category.category_class_summary(selected(spark, d, SCRIPT))))

register("m5_m7_focus_kpis", with_ctes("""
select avg(case when review_simple = 'alta' then 1.0 else 0.0 end) as approval,
       sum(total_price) as gross_sales, count(*) as number_products
from focus""", DASH))(
    lambda spark, d: category.focus_kpis(focus(spark, d, DASH)))


# ---------------------------------------------------------------- M8-M10, G5 baskets

def pct_sql(x: str, accuracy: int = 2) -> str:
    """DuckDB twin of ``labels.percent`` for integer accuracies."""
    return (f"cast(cast(round_even({x} * 100.0 / {float(accuracy)}, 0) * {float(accuracy)} as bigint)"
            f" as varchar) || '%'")


ORDER_TOTALS_SQL = """
select order_id, review_simple, sum(total_price) as total_gross_sale, cast(sum(total_price) as double) / count(total_price) as mean_price,
       count(*) as number_products
from focus group by 1, 2"""

register("g5_order_totals", with_ctes("select * from order_totals", SCRIPT,
                                      extra={"order_totals": ORDER_TOTALS_SQL}))(
    lambda spark, d: basket.order_totals(focus(spark, d, SCRIPT)))

M8_SQL = """
select review_simple, bucket_itens, number_products, total_gross_sale,
       number_products / sum(number_products) over (partition by bucket_itens) as percent_notas,
       cast(total_gross_sale as double) / sum(total_gross_sale) over (partition by bucket_itens) as percent_notas_gs
from (select review_simple,
             case when number_products >= 3 then '3 ou mais' else cast(number_products as varchar) end
               as bucket_itens,
             count(*) as number_products, sum(total_gross_sale) as total_gross_sale
      from order_totals group by 1, 2) t"""

register("m8_basket_buckets", with_ctes(M8_SQL, DASH, extra={"order_totals": ORDER_TOTALS_SQL}))(
    lambda spark, d: basket.basket_buckets(focus(spark, d, DASH)))

register("m9_basket_histogram", with_ctes(f"""
select *, {pct_sql("percent_prod")} as percent_prod_p, {pct_sql("percent_prod_gs")} as percent_prod_gs_p
from (select review_simple, number_products, number_instances, total_gross_sale,
       number_instances / sum(number_instances) over (partition by number_products) as percent_notas,
       cast(total_gross_sale as double) / sum(total_gross_sale) over (partition by number_products) as percent_gross_sales,
       number_instances / sum(number_instances) over (partition by review_simple) as percent_prod,
       cast(total_gross_sale as double) / sum(total_gross_sale) over (partition by review_simple) as percent_prod_gs
      from (select review_simple, number_products, count(*) as number_instances,
                   sum(total_gross_sale) as total_gross_sale
            from order_totals group by 1, 2) a) b""", DASH, extra={"order_totals": ORDER_TOTALS_SQL}))(
    lambda spark, d: basket.basket_histogram(focus(spark, d, DASH)))

register("m10_bucket_share", with_ctes("""
select bucket_itens, number_products, number_products / sum(number_products) over () as percent_prod
from (select bucket_itens, cast(sum(number_products) as bigint) as number_products from m8 group by 1) t""",
                                       SCRIPT, extra={"order_totals": ORDER_TOTALS_SQL, "m8": M8_SQL}))(
    lambda spark, d: basket.bucket_share(basket.basket_buckets(focus(spark, d, SCRIPT))))

# ---------------------------------------------------------------- M11-M16 geography


def _state_sql(cls_filter: str | None) -> str:
    where = f"where review_simple = '{cls_filter}'" if cls_filter else ""
    return f"""
select Estado, n_orders, gross_sales, n_orders / sum(n_orders) over () as prop,
       cast(gross_sales as double) / sum(gross_sales) over () as prop_gross, upper(Estado) as nome,
       {pct_sql("n_orders / sum(n_orders) over ()")} || ' ' || cast(n_orders as varchar) as label_prod
from (select Estado, count(*) as n_orders, sum(total_price) as gross_sales from focus {where} group by 1) t"""



register("m11_state_metrics", with_ctes(_state_sql(None), DASH))(
    lambda spark, d: geo.state_metrics(focus(spark, d, DASH)))
register("m12_state_metrics_bad", with_ctes(_state_sql("baixa"), DASH))(
    lambda spark, d: geo.state_metrics(focus(spark, d, DASH), "baixa"))
register("m12_state_metrics_good", with_ctes(_state_sql("alta"), DASH))(
    lambda spark, d: geo.state_metrics(focus(spark, d, DASH), "alta"))
register("m13_state_map", with_ctes(
    "select m.nome, m.geometry, s.Estado, s.n_orders, s.gross_sales, s.prop, s.prop_gross, s.label_prod "
    "from f_state_map m left join st s on s.nome = m.nome",
    SCRIPT, extra={"f_state_map": fixtures_sql("f_state_map"), "st": _state_sql(None)}))(
    lambda spark, d: geo.state_map_metrics(fixtures.state_map(spark, d), geo.state_metrics(focus(spark, d, SCRIPT)))
    .select("nome", "geometry", "Estado", "n_orders", "gross_sales", "prop", "prop_gross", "label_prod"))

register("m14_region_class", with_ctes("""
select Region, review_simple, number_products,
       number_products / sum(number_products) over (partition by Region) as percent_notas
from (select Region, review_simple, count(*) as number_products from focus group by 1, 2) t""", SCRIPT))(
    lambda spark, d: geo.region_class(focus(spark, d, SCRIPT)))

register("m15_state_class", with_ctes("""
select customer_state, review_simple, n_orders,
       n_orders / sum(n_orders) over (partition by customer_state) as prop
from (select customer_state, review_simple, count(*) as n_orders from focus group by 1, 2) t""", SCRIPT))(
    lambda spark, d: geo.state_class(focus(spark, d, SCRIPT)))

register("m16_region_counts_open_range", with_ctes("""
select Region, count(*) as n from items_wide where total_price > 2000.0 and total_price < 90000.0
group by 1"""))(lambda spark, d: geo.region_counts(wide_table(spark, d), 2000.0, 90000.0, closed=False))

# ---------------------------------------------------------------- M18-M19 payments

M18_SQL = """
select review_simple, payment_method, n_count, gross_sales,
       n_count / sum(n_count) over (partition by payment_method) as prop_qnt,
       cast(gross_sales as double) / sum(gross_sales) over (partition by payment_method) as prop_sales
from (select review_simple, payment_method, count(*) as n_count, sum(v) as gross_sales
      from (select review_simple, 'credit_card' as payment_method, credit_card as v from focus
            union all select review_simple, 'boleto', boleto from focus
            union all select review_simple, 'voucher', voucher from focus
            union all select review_simple, 'debit_card', debit_card from focus) u
      where v is not null group by 1, 2) t"""

register("m18_payment_method_class", with_ctes(M18_SQL, DASH))(
    lambda spark, d: payment.method_class(focus(spark, d, DASH)))

register("m18_payment_method_class_order_grain", with_ctes(
    M18_SQL.replace("from focus", "from focus_o"), DASH,
    extra={"focus_o": "select distinct on (order_id, review_simple) * from focus"}))(
    lambda spark, d: payment.method_class(focus(spark, d, DASH), grain="order"))

register("m19_payment_mix", with_ctes("""
select formas, names_to_extend, quantidade_compras,
       quantidade_compras / sum(quantidade_compras) over () as percent_compras
from (select cast(formas as varchar) as formas, names_to_extend, count(*) as quantidade_compras
      from (select (case when credit_card is null then 0 else 1 end) + (case when boleto is null then 0 else 1 end)
                 + (case when voucher is null then 0 else 1 end) + (case when debit_card is null then 0 else 1 end)
                   as formas,
                   unnest(list_filter([case when credit_card is not null then 'credit_card' end,
                                       case when boleto is not null then 'boleto' end,
                                       case when voucher is not null then 'voucher' end,
                                       case when debit_card is not null then 'debit_card' end],
                                      lambda x: x is not null)) as names_to_extend
            from items_wide) u
      group by 1, 2) t"""))(
    lambda spark, d: payment.payment_mix(wide_table(spark, d)))


# ---------------------------------------------------------------- W4/Q1/Q2 n-tiles, M17, M20-M22


def ntile_sql(value: str, labels, order=("order_id", "order_item_id", "review_id"), src: str = "focus",
              out: str = "label", extra_n: int = 0) -> str:
    """Reference n-tile rule with a global row_number (oracle only)."""
    n = len(labels)
    q = (f"(10000 * (row_number() over (order by {value}, {', '.join(order)}) - 1)) "
         f"// (count({value}) over () + {extra_n}) + 1")
    cases = " ".join(f"when {n} * _q < {10000 * (k + 1)} then '{lab}'" for k, lab in enumerate(labels[:-1]))
    return (f"select * exclude (_q), case when {value} is null then null {cases} else '{labels[-1]}' end as {out}"
            f" from (select *, case when {value} is null then null else {q} end as _q from {src}) t")


PHOTO_SQL = ("case when product_photos_qty = 1 then '1' when product_photos_qty between 2 and 3 then '2-3' "
             "when product_photos_qty between 4 and 5 then '4-5' when product_photos_qty >= 6 then '6+' end")
SOL_CTES = {"sol": f"select *, {PHOTO_SQL} as bucket_photos from ("
                   + ntile_sql("product_description_lenght", listing.SEXTILES, out="quantil_desc") + ") s"}


def solution(spark, d, p: Params) -> DataFrame:
    """``df_solution``: the focus rows with photo bucket and description sextile.
    Shared per parameter record, as the dashboard memoises it for M20-M22 and the what-if."""
    return shared(spark, ("solution", d, p), lambda: listing.with_listing_cells(focus(spark, d, p), checkpoint=False))


register("m17_price_quartile_class", with_ctes("""
select score, review_simple, n_orders, gross_sales, min_order, max_order,
       n_orders / sum(n_orders) over (partition by score) as prop,
       cast(gross_sales as double) / sum(gross_sales) over (partition by score) as prop_sales
from (select score, review_simple, count(*) as n_orders, sum(total_price) as gross_sales,
             min(total_price) as min_order, max(total_price) as max_order
      from scored group by 1, 2) t""", DASH,
    extra={"scored": ntile_sql("total_price", price.QUARTILES, out="score")}))(
    lambda spark, d: price.quartile_class(focus(spark, d, DASH)))

register("m17_price_quartile_class_script", with_ctes("""
select score, review_simple, n_orders, gross_sales, min_order, max_order,
       n_orders / sum(n_orders) over (partition by score) as prop,
       cast(gross_sales as double) / sum(gross_sales) over (partition by score) as prop_sales
from (select score, review_simple, count(*) as n_orders, sum(total_price) as gross_sales,
             min(total_price) as min_order, max(total_price) as max_order
      from scored group by 1, 2) t""", SCRIPT,
    extra={"scored": ntile_sql("total_price", price.QUARTILES, out="score")}))(
    lambda spark, d: price.quartile_class(focus(spark, d, SCRIPT)))

register("q2_description_sextiles", with_ctes(
    "select order_id, order_item_id, review_id, product_description_lenght, quantil_desc, bucket_photos from sol",
    DASH, extra=SOL_CTES))(
    lambda spark, d: solution(spark, d, DASH).select(
        "order_id", "order_item_id", "review_id", "product_description_lenght", "quantil_desc", "bucket_photos"))

register("m20_photos_class", with_ctes("""
select bucket_photos, review_simple, total_gross_sale, mean_price, number_products,
       number_products / sum(number_products) over (partition by bucket_photos) as percent_notas,
       cast(total_gross_sale as double) / sum(total_gross_sale) over (partition by bucket_photos) as percent_sales
from (select bucket_photos, review_simple, sum(total_price) as total_gross_sale,
             cast(sum(total_price) as double) / count(total_price) as mean_price, count(*) as number_products
      from sol group by 1, 2) t""", DASH, extra=SOL_CTES))(
    lambda spark, d: listing.photos_class(solution(spark, d, DASH)))

register("m21_sextile_class", with_ctes("""
select quantil_desc, review_simple, total_gross_sale, mean_price, number_products,
       min_caracters_desc, max_caracters_desc,
       number_products / sum(number_products) over (partition by quantil_desc) as percent_notas,
       cast(total_gross_sale as double) / sum(total_gross_sale) over (partition by quantil_desc) as percent_sales
from (select quantil_desc, review_simple, sum(total_price) as total_gross_sale,
             cast(sum(total_price) as double) / count(total_price) as mean_price, count(*) as number_products,
             min(product_description_lenght) as min_caracters_desc,
             max(product_description_lenght) as max_caracters_desc
      from sol group by 1, 2) t""", DASH, extra=SOL_CTES))(
    lambda spark, d: listing.sextile_class(solution(spark, d, DASH)))

M22_SQL = """
select bucket_photos, quantil_desc, sum(total_price) as gross_sales1, count(*) as total_number_products,
       cast(sum(case when review_simple = 'alta' then 1 else 0 end) as double) / count(*) as prop_quantity,
       cast(sum(case when review_simple = 'alta' then total_price else 0 end) as double)
         / cast(sum(total_price) as double) as prop_sales,
       cast(sum(product_description_lenght) as double) / count(*) as mean_caracters_desc,
       min(product_description_lenght) + 1 as min_caracters_desc,
       max(product_description_lenght) as max_caracters_desc
from sol group by 1, 2"""

register("m22_cell_table", with_ctes(M22_SQL, DASH, extra=SOL_CTES))(
    lambda spark, d: listing.cell_table(solution(spark, d, DASH)))

# ---------------------------------------------------------------- X1-X6 what-if


def _whatif_spark(spark, d, p: Params) -> DataFrame:
    sol = solution(spark, d, p)
    return whatif.recommend(sol, listing.cell_table(sol), fixtures.scenarios(spark))


def _sextile_case(q: str) -> str:
    labels = listing.SEXTILES
    cases = " ".join(f"when 6 * {q} < {10000 * (k + 1)} then '{lab}'" for k, lab in enumerate(labels[:-1]))
    return f"case when {q} is null then null {cases} else '{labels[-1]}' end"


def _pct_sql(x: str) -> str:
    return f"cast(cast(round_even({x} * 100.0, 0) as bigint) as varchar) || '%'"


def _reais_sql(x: str) -> str:
    body = (f"case when round_even({x}, 2) = round({x}, 0) then format('{{:,.0f}}', abs({x})) "
            f"else format('{{:,.2f}}', abs({x})) end")
    return f"(case when {x} < 0 then '-' else '' end) || 'R$' || translate({body}, ',.', '.,')"


def _na_sql(x: str) -> str:
    return f"coalesce(cast({x} as varchar), 'NA')"


WHATIF_SQL = f"""
select *,
  'Você está usando ' || {_na_sql('bucket_photos')} || ' fotos e seu anúncio se encaixa no ' || {_na_sql('quantil_desc')}
    || ' quantil em termos de caracteres, sua aprovação estimada é de ' || {_na_sql(_pct_sql('sim_prop_quantity'))}
    as current_situation_quantity,
  'Você deveria usar ' || {_na_sql('best_bucket_photos')} || ' fotos e manter a descrição do produto entre '
    || {_na_sql('best_min_caracters_desc')} || ' e ' || {_na_sql('best_max_caracters_desc')}
    || ' caracteres podendo aumentar sua aprovação para ' || {_na_sql(_pct_sql('best_prop_quantity'))}
    || ' um aumento de ' || {_na_sql(_pct_sql('increase_quantity'))}
    || ' reduzindo o seu custo por produto em até ' || {_na_sql(_reais_sql('freight_gain_quantity'))}
    as possible_situation_quantity,
  'Você está usando ' || {_na_sql('bucket_photos')} || ' fotos e seu anúncio se encaixa no ' || {_na_sql('quantil_desc')}
    || ' quantil em termos de caracteres, sua aprovação estimada é de ' || {_na_sql(_pct_sql('sim_prop_sales'))}
    as current_situation_sales,
  'Você deveria usar ' || {_na_sql('best_sales_bucket_photos')} || ' fotos e manter a descrição do produto entre '
    || {_na_sql('best_sales_min_caracters_desc')} || ' e ' || {_na_sql('best_sales_max_caracters_desc')}
    || ' caracteres podendo aumentar sua aprovação para ' || {_na_sql(_pct_sql('best_prop_sales'))}
    || ' um aumento de ' || {_na_sql(_pct_sql('increase_sales'))}
    || ' reduzindo o seu custo por produto em até ' || {_na_sql(_reais_sql('freight_gain_sales'))}
    as possible_situation_sales
from (
  select *, frete * 2 * increase_quantity as freight_gain_quantity, frete * 2 * increase_sales as freight_gain_sales
  from (
    select pl.scenario_id, pl.fotos, pl.caracteres, pl.frete, pl.quantil_desc, pl.bucket_photos,
           c.prop_quantity as sim_prop_quantity, c.prop_sales as sim_prop_sales,
           bq.bucket_photos as best_bucket_photos, bq.quantil_desc as best_quantil_desc,
           bq.min_caracters_desc as best_min_caracters_desc, bq.max_caracters_desc as best_max_caracters_desc,
           bq.prop_quantity as best_prop_quantity,
           bs.bucket_photos as best_sales_bucket_photos, bs.quantil_desc as best_sales_quantil_desc,
           bs.min_caracters_desc as best_sales_min_caracters_desc,
           bs.max_caracters_desc as best_sales_max_caracters_desc, bs.prop_sales as best_prop_sales,
           case when c.prop_quantity = 0 then null
                else (bq.prop_quantity - c.prop_quantity) / c.prop_quantity end as increase_quantity,
           case when c.prop_sales = 0 then null
                else (bs.prop_sales - c.prop_sales) / c.prop_sales end as increase_sales
    from (select s.*, {_sextile_case('s._q')} as quantil_desc,
                 {PHOTO_SQL.replace('product_photos_qty', 's.fotos')} as bucket_photos
          from (select *, case when caracteres is null then null else
                  (10000 * ((select count(*) from sol where product_description_lenght <= f.caracteres)))
                  // ((select count(product_description_lenght) from sol) + 1) + 1 end as _q
                from f_scenarios f) s) pl
    left join cells c on c.bucket_photos = pl.bucket_photos and c.quantil_desc = pl.quantil_desc
    cross join (select * from cells order by prop_quantity desc nulls last, bucket_photos nulls last,
                quantil_desc nulls last limit 1) bq
    cross join (select * from cells order by prop_sales desc nulls last, bucket_photos nulls last,
                quantil_desc nulls last limit 1) bs) a) b"""

register("x1_x6_whatif", with_ctes(WHATIF_SQL, DASH,
                                   extra={**SOL_CTES, "cells": M22_SQL, "f_scenarios": fixtures_sql("f_scenarios")}))(
    lambda spark, d: _whatif_spark(spark, d, DASH))


register("x1_x6_whatif_parts", with_ctes(WHATIF_SQL.replace("f_scenarios", "f_part_scenarios"), DASH,
                                         extra={**SOL_CTES, "cells": M22_SQL,
                                                "f_part_scenarios": fixtures_sql("f_part_scenarios")}))(
    lambda spark, d: whatif.recommend(solution(spark, d, DASH), listing.cell_table(solution(spark, d, DASH)),
                                      fixtures.scenarios_from_parts(spark, d)))

# every scenario ranked anew among all rows
register("x2_cell_bounds", with_ctes(f"""
select s.scenario_id, s.fotos, s.caracteres, s.frete, s.quantil_desc, s.bucket_photos,
       least(min(r.len), max(s.caracteres)) as min_characters,
       greatest(max(r.len), max(s.caracteres)) as max_characters
from (select *, {_sextile_case('_q')} as quantil_desc, {PHOTO_SQL.replace('product_photos_qty', 'fotos')} as bucket_photos
      from (select f.*, case when caracteres is null then null else
              (10000 * (select count(*) from base where len <= f.caracteres)) // ((select count(*) from base) + 1) + 1 end as _q
            from f_part_scenarios f) q) s
left join (select f.scenario_id, b.len, b.bucket_photos,
                  (10000 * (b.rank + (case when b.len > f.caracteres then 1 else 0 end) - 1))
                  // ((select count(*) from base) + 1) + 1 as _q
           from f_part_scenarios f cross join base b where f.caracteres is not null) r
  on r.scenario_id = s.scenario_id and r.bucket_photos is not distinct from s.bucket_photos
     and {_sextile_case('r._q')} = s.quantil_desc
group by 1, 2, 3, 4, 5, 6""", DASH, extra={
    **SOL_CTES, "f_part_scenarios": fixtures_sql("f_part_scenarios"),
    "base": "select product_description_lenght as len, bucket_photos, row_number() over (order by "
            "product_description_lenght, order_id, order_item_id, review_id) as rank "
            "from sol where product_description_lenght is not null"}))(
    lambda spark, d: whatif.cell_bounds(solution(spark, d, DASH), fixtures.scenarios_from_parts(spark, d)))

register("u1_appended_scenarios", with_ctes("""
select order_id, order_item_id, review_id, product_photos_qty, product_description_lenght, null as scenario_id from sol
union all select null, null, null, fotos, caracteres, scenario_id from f_part_scenarios""", DASH, extra={
    **SOL_CTES, "f_part_scenarios": fixtures_sql("f_part_scenarios")}))(
    lambda spark, d: io.append_rows(
        solution(spark, d, DASH).select("order_id", "order_item_id", "review_id", "product_photos_qty", "product_description_lenght"),
        fixtures.scenarios_from_parts(spark, d).select(
            F.col("fotos").cast("bigint").alias("product_photos_qty"),
            F.col("caracteres").cast("bigint").alias("product_description_lenght"), "scenario_id")))


# ---------------------------------------------------------------- G8, G16-G18 price statistics

register("g8_order_total_quantiles", with_ctes("""
select quantile_cont(cast(total_gross_sale as double), 0.25) as first_quantile,
       quantile_cont(cast(total_gross_sale as double), 0.5) as second_quantile,
       quantile_cont(cast(total_gross_sale as double), 0.75) as third_quantile
from order_totals""", SCRIPT, extra={"order_totals": ORDER_TOTALS_SQL}))(
    lambda spark, d: price.price_quantiles(basket.order_totals(focus(spark, d, SCRIPT)), "total_gross_sale"))

register("g16_box_stats", with_ctes("""
select q.review_simple, w.n, w.ymin, q.lower, q.middle, q.upper, w.ymax, w.n_outliers
from (select review_simple, quantile_cont(cast(total_price as double), 0.25) as lower,
             quantile_cont(cast(total_price as double), 0.5) as middle,
             quantile_cont(cast(total_price as double), 0.75) as upper
      from focus group by 1) q
join (select f.review_simple, count(*) as n,
             min(case when x >= fl and x <= fh then x end) as ymin,
             max(case when x >= fl and x <= fh then x end) as ymax,
             cast(sum(case when x >= fl and x <= fh then 0 else 1 end) as bigint) as n_outliers
      from (select review_simple, cast(total_price as double) as x from focus) f
      join (select review_simple,
                   quantile_cont(cast(total_price as double), 0.25)
                     - 1.5 * (quantile_cont(cast(total_price as double), 0.75)
                              - quantile_cont(cast(total_price as double), 0.25)) as fl,
                   quantile_cont(cast(total_price as double), 0.75)
                     + 1.5 * (quantile_cont(cast(total_price as double), 0.75)
                              - quantile_cont(cast(total_price as double), 0.25)) as fh
            from focus group by 1) b on b.review_simple = f.review_simple
      group by 1) w on w.review_simple = q.review_simple""", DASH))(
    lambda spark, d: price.box_stats(focus(spark, d, DASH)))

C9_VIEWS = ["f_orders", "f_order_items", "f_payments", "f_reviews", "f_products", "f_customers", "f_sellers"]
C9_SQL = """
select * from f_orders left join f_order_items using (order_id)
full outer join f_payments using (order_id)
full outer join f_reviews using (order_id)
full outer join f_products using (product_id)
full outer join f_customers using (customer_id)
full outer join f_sellers using (seller_id)"""
C9_COLUMNS = ["order_id", "customer_id", "order_status", "order_purchase_timestamp", "order_item_id",
              "product_id", "seller_id", "shipping_limit_date", "price", "freight_value", "payment_type",
              "payment_value", "review_id", "review_score", "review_creation_date", "review_answer_timestamp",
              "product_category_name", "product_photos_qty", "product_description_lenght", "customer_state",
              "seller_state"]


def c9_sql(body: str, extra: dict | None = None) -> str:
    return with_ctes(body, views=C9_VIEWS, wide=False, extra={"c9": C9_SQL, **(extra or {})})


def c9_keys(spark, d) -> DataFrame:
    """Per-order side counts of C9 (one row per order key), shared."""
    return shared(spark, ("c9_keys", d), lambda: outer.side_counts(_tables(spark, d)))


def c9_items(spark, d) -> DataFrame:
    """Order-side rows of C9 (orders, items, products), shared."""
    return shared(spark, ("c9_items", d), lambda: outer.item_side(_tables(spark, d)))


def c9(spark, d) -> DataFrame:
    """The table itself is one query's output: not written once more for others."""
    return profile.full_outer_wide(_tables(spark, d)).select(*C9_COLUMNS)


HIST_BINS = 50
_complete = " and ".join(f"{c} is not null" for c in C9_COLUMNS)
for _suffix, _of in (("", "cast(price as double)"), ("_log10", "log10(cast(price as double))")):
    register(f"g17_price_histogram{_suffix}", c9_sql(f"""
select bin, _lo + bin * (_hi - _lo) / {HIST_BINS} as bin_lo, _lo + (bin + 1) * (_hi - _lo) / {HIST_BINS} as bin_hi,
       count(*) as count
from (select _lo, _hi, cast(case when _hi - _lo > 0 then least(floor((x - _lo) / ((_hi - _lo) / {float(HIST_BINS)})),
                                                      {HIST_BINS - 1}) else 0 end as int) as bin
      from (select {_of} as x from c9 where {_complete} and price > 0) v
      cross join (select min({_of}) as _lo, max({_of}) as _hi
                  from c9 where {_complete} and price > 0) b) t
group by bin, _lo, _hi""" if _suffix else f"""
select bin, _lo + bin * (_hi - _lo) / {HIST_BINS} as bin_lo, _lo + (bin + 1) * (_hi - _lo) / {HIST_BINS} as bin_hi,
       count(*) as count
from (select _lo, _hi, cast(case when _hi - _lo > 0 then least(floor((x - _lo) / ((_hi - _lo) / {float(HIST_BINS)})),
                                                      {HIST_BINS - 1}) else 0 end as int) as bin
      from (select {_of} as x from c9 where {_complete}) v
      cross join (select min({_of}) as _lo, max({_of}) as _hi
                  from c9 where {_complete}) b) t
group by bin, _lo, _hi"""), {"bin_lo": 9, "bin_hi": 9} if _suffix else None)(
        lambda spark, d, log=bool(_suffix): outer.complete_price_histogram(_tables(spark, d), HIST_BINS, C9_COLUMNS, log))

# ---------------------------------------------------------------- profiles, checks

register("g1_order_status_counts", with_ctes(
    "select order_status, count(*) as n from f_orders group by 1", views=["f_orders"], wide=False))(
    lambda spark, d: profile.group_counts(fixtures.orders(spark, d), "order_status"))

OI_ALL = ("select o.*, i.order_item_id, i.product_id, i.seller_id, i.shipping_limit_date, i.price, "
          "i.freight_value, i.price + i.freight_value as total_price "
          "from f_orders o join f_order_items i on i.order_id = o.order_id")


def orders_items_all(spark, d) -> DataFrame:
    """C1 + B1 over all statuses: the shared order-side rows that have an item."""
    rows = c9_items(spark, d).select("order_id", "customer_id", "order_status", "order_purchase_timestamp",
                                     "order_item_id", "product_id", "seller_id", "shipping_limit_date",
                                     "price", "freight_value")
    return (rows.filter(F.col("product_id").isNotNull())
            .withColumn("total_price", F.col("price") + F.col("freight_value")))


register("g1_item_position_counts", with_ctes(
    "select order_item_id, count(*) as n from oi group by 1", views=["f_orders", "f_order_items"], wide=False,
    extra={"oi": OI_ALL}))(
    lambda spark, d: profile.group_counts(orders_items_all(spark, d), "order_item_id"))

register("g6_status_class_counts", with_ctes("""
select review_simple, order_status, count(*) as n from (
  select *, case when review_score in (1, 2, 3) then 'baixa' when review_score in (4, 5) then 'alta' end
              as review_simple from items_wide) t
where review_simple is not null and order_status <> 'delivered' group by 1, 2""", statuses=None))(
    lambda spark, d: profile.status_class_counts(wide_table(spark, d, statuses=None)))

register("g7_distinct_ship_dates", with_ctes(
    "select order_id, seller_id, count(distinct shipping_limit_date) as n_dates from f_order_items group by 1, 2",
    views=["f_order_items"], wide=False))(
    lambda spark, d: profile.distinct_per_group(fixtures.order_items(spark, d), ["order_id", "seller_id"],
                                                "shipping_limit_date", "n_dates"))

register("w6_sellers_per_order_attached", with_ctes("""
select i.order_id, i.order_item_id, i.seller_id, s.n_sellers
from f_order_items i join (select order_id, count(distinct seller_id) as n_sellers from f_order_items group by 1) s
  on s.order_id = i.order_id""", views=["f_order_items"], wide=False))(
    lambda spark, d: profile.attach_distinct(fixtures.order_items(spark, d), ["order_id"], "seller_id",
                                             "n_sellers").select("order_id", "order_item_id", "seller_id",
                                                                 "n_sellers"))

register("b16_duplicated_review_orders", with_ctes("""
select r.review_id, r.order_id, r.review_score, c.n
from f_reviews r join (select order_id, count(*) as n from f_reviews group by 1 having count(*) > 1) c
  on c.order_id = r.order_id""", views=["f_reviews"], wide=False))(
    lambda spark, d: profile.duplicated_keys(fixtures.reviews(spark, d), "order_id")
    .select("review_id", "order_id", "review_score", "n"))

register("c8_items_without_review", with_ctes("""
select order_id, order_item_id from oi where order_id not in (select order_id from f_reviews where order_id is not null)""",
    views=["f_orders", "f_order_items", "f_reviews"], wide=False, extra={"oi": OI_ALL}))(
    lambda spark, d: profile.without_match(orders_items_all(spark, d), fixtures.reviews(spark, d), "order_id")
    .select("order_id", "order_item_id"))

register("c9_full_outer_wide", c9_sql("select * from c9"))(c9)

register("g9_numeric_profile_items", with_ctes("""
select column_name, cast(sum(case when v is null then 1 else 0 end) as bigint) as n_missing,
       cast(count(v) as double) / cast(count(*) as double) as complete_rate,
       cast(sum(v) as double) / cast(count(v) as double) as mean,
       stddev_samp(cast(v as double)) as sd,
       quantile_cont(cast(v as double), 0.0) as p0, quantile_cont(cast(v as double), 0.25) as p25,
       quantile_cont(cast(v as double), 0.5) as p50, quantile_cont(cast(v as double), 0.75) as p75,
       quantile_cont(cast(v as double), 1.0) as p100
from (select 'order_item_id' as column_name, cast(order_item_id as decimal(38,6)) as v from oi
      union all select 'price', cast(price as decimal(38,6)) from oi
      union all select 'freight_value', cast(freight_value as decimal(38,6)) from oi
      union all select 'total_price', cast(total_price as decimal(38,6)) from oi) l
group by 1""", views=["f_orders", "f_order_items"], wide=False, extra={"oi": OI_ALL}), {"sd": 6})(
    lambda spark, d: profile.numeric_profile(orders_items_all(spark, d),
                                             ["order_item_id", "price", "freight_value", "total_price"]))

register("g10_order_frequencies", with_ctes("""
select column_name, count(distinct v) as unique_values, cast(sum(case when v is null then 1 else 0 end) as bigint) as missing
from (select 'order_id' as column_name, cast(order_id as varchar) as v from f_orders
      union all select 'customer_id', cast(customer_id as varchar) from f_orders
      union all select 'order_status', order_status from f_orders
      union all select 'order_purchase_timestamp', cast(order_purchase_timestamp as varchar) from f_orders) l
group by 1""", views=["f_orders"], wide=False))(
    lambda spark, d: profile.frequencies(fixtures.orders(spark, d)))

register("g11_payment_type_counts", c9_sql("""
select payment_type, count, 100.0 * (cast(count as double) / sum(count) over ()) as percent
from (select payment_type, count(*) as count from c9 where payment_type is not null group by 1) t"""))(
    lambda spark, d: outer.with_percent(outer.payment_type_counts(_tables(spark, d), c9_keys(spark, d)),
                                        "payment_type"))

register("g11_review_score_counts", c9_sql("""
select review_score, count, 100.0 * (cast(count as double) / sum(count) over ()) as percent
from (select review_score, count(*) as count from c9 where review_score is not null group by 1) t"""))(
    lambda spark, d: outer.with_percent(outer.review_score_counts(_tables(spark, d), c9_keys(spark, d)),
                                        "review_score"))

register("g12_payment_type_shares", c9_sql("""
select payment_type, count, cast(count as double) / sum(count) over () as share
from (select payment_type, count, row_number() over (order by count asc, payment_type desc) as rn
      from (select payment_type, count(*) as count from c9 where payment_type is not null group by 1) a) t
where rn > 1"""))(
    lambda spark, d: profile.shares_without_rare(None, "payment_type", 1,
                                                 counts=outer.payment_type_counts(_tables(spark, d),
                                                                                  c9_keys(spark, d))))

register("g13_price_by_year_weekday", c9_sql("""
select year(order_purchase_timestamp) as order_purchase_year,
       isodow(order_purchase_timestamp) - 1 as order_purchase_dayofweek,
       cast(sum(price) as double) / cast(count(price) as double) as price,
       (['Seg', 'Ter', 'Qua', 'Qui', 'Sex', 'Sab', 'Dom'])[isodow(order_purchase_timestamp)] as weekday_name
from c9 where order_purchase_timestamp is not null group by 1, 2, 4"""))(
    lambda spark, d: outer.mean_price_by_year_weekday(_tables(spark, d), keys=c9_keys(spark, d),
                                                      items=c9_items(spark, d)))

CORR_COLS = ["order_item_id", "price", "freight_value", "payment_value", "review_score", "product_photos_qty",
             "product_description_lenght"]


def _corr_sql() -> str:
    parts = []
    for i, a in enumerate(CORR_COLS):
        for b in CORR_COLS[i:]:
            r = f"corr(cast({a} as double), cast({b} as double))"
            parts.append(f"select '{a}' as col_a, '{b}' as col_b, {r} as corr from c9")
            if a != b:
                parts.append(f"select '{b}' as col_a, '{a}' as col_b, {r} as corr from c9")
    return ("select *, case when round_even(corr, 2) = 0 then 0.0 else round_even(corr, 2) end as corr_rounded"
            " from (\n" + "\nunion all ".join(parts) + ") t")


register("g15_correlation_matrix", c9_sql(_corr_sql()), {"corr": 9})(
    lambda spark, d: outer.correlation_matrix(
        _tables(spark, d), ["order_item_id", "price", "freight_value", "product_photos_qty",
                            "product_description_lenght"], ["payment_value"], ["review_score"]))

# ---------------------------------------------------------------- N1-N5 text

STOP_SQL = "select unnest([" + ", ".join(f"'{w}'" for w in sorted(set(text.EXTRA_STOP_WORDS))) + "]) as word"
WS_SQL = text.WHITESPACE
WORDS_SQL = f"""
select word, count(*) as count from (
  select unnest(regexp_extract_all(token, '({text.WORD})', 1)) as word from (
    select token from (
      select unnest(regexp_split_to_array(m, '{WS_SQL}')) as token from (
        select translate(replace(lower(d.text), chr(10), ' '), ',.?:!', '') as m
        from c9 join documents d on d.doc_id = c9.review_id where c9.review_score < 4 and d.text is not null) a) b
    where token <> '' and not starts_with(token, 'http') and token not in (select word from stops)) c) d
group by 1"""


def _word_counts(spark, d) -> DataFrame:
    t = _tables(spark, d)
    return text.word_counts(outer.bad_review_messages(t, fixtures.messages(spark, d), c9_keys(spark, d)),
                            text.stop_words(spark), weight="weight")


register("n3_word_counts", c9_sql(WORDS_SQL, extra={"stops": STOP_SQL}))(_word_counts)

register("n4_top_words", c9_sql("select * from wc order by count desc, word asc limit 100",
                                extra={"stops": STOP_SQL, "wc": WORDS_SQL}))(
    lambda spark, d: text.top_words(_word_counts(spark, d), 100))


N5_COLUMNS = text.BAD_REVIEW_COLUMNS
N5_KEYS = ["order_id", "order_item_id", "review_id", "payment_type", "payment_value"]
N5_VIEWS = {"f_messages": "select doc_id as review_id, text as review_comment_message from documents",
            "f_order_times": VIEWS["f_order_times"]}
N5_FROM = "from c9 left join f_messages using (review_id) left join f_order_times using (order_id) where review_score < 4"


def _bad_reviews(spark, d, columns) -> DataFrame:
    t = _tables(spark, d)
    t = replace(t, orders=profile.coerce_dates(fixtures.orders_with_times(spark, d), fixtures.ORDER_TIMES))
    rows = profile.bad_review_rows(t).join(fixtures.messages(spark, d), "review_id", "left")
    return text.bad_reviews(rows, columns=columns)


register("n5_bad_reviews", c9_sql("select " + ", ".join(N5_COLUMNS) + f" {N5_FROM}", extra=N5_VIEWS))(
    lambda spark, d: _bad_reviews(spark, d, N5_COLUMNS))

register("n5_bad_review_sample", c9_sql(
    "select " + ", ".join(N5_COLUMNS) + f" {N5_FROM} and " + " and ".join(f"{c} is not null" for c in N5_COLUMNS)
    + f" order by md5(concat_ws('|', '42', {', '.join(N5_KEYS)})), {', '.join(N5_COLUMNS)} limit 250",
    extra=N5_VIEWS))(
    lambda spark, d: text.complete_sample(
        _bad_reviews(spark, d, list(dict.fromkeys(N5_COLUMNS + N5_KEYS)))
        .select(*N5_COLUMNS, *[F.col(k).alias(f"_key_{k}") for k in N5_KEYS]), [f"_key_{k}" for k in N5_KEYS]))

register("h15_h18_order_times", with_ctes("""
select order_id, order_purchase_timestamp, order_approved_at, order_delivered_carrier_date, order_delivered_customer_date,
       order_estimated_delivery_date,
       cast(order_delivered_customer_date as date) - cast(order_purchase_timestamp as date) as delivery_days
from f_order_times""", views=["f_order_times"], wide=False))(
    lambda spark, d: io.delivery_days(profile.coerce_dates(fixtures.orders_with_times(spark, d), fixtures.ORDER_TIMES))
    .select("order_id", *fixtures.ORDER_TIMES, "delivery_days"))


# ---------------------------------------------------------------- G2-G4, W1 building blocks

register("g2_payments_per_type", with_ctes(
    "select order_id, payment_type, sum(payment_value) as value_to_pay from f_payments "
    "where payment_type <> 'not_defined' group by 1, 2", views=["f_orders", "f_payments"], wide=False))(
    lambda spark, d: W.payments_per_type(fixtures.payments(spark, d)))

register("g3_g4_payments_wide", with_ctes("""
select *, coalesce(credit_card, 0) + coalesce(boleto, 0) + coalesce(voucher, 0) + coalesce(debit_card, 0)
          as total_payment_value from pay""", views=["f_orders", "f_payments"], wide=False,
    extra={"pay": WIDE_CTES["pay"]}))(
    lambda spark, d: W.payments_wide(fixtures.payments(spark, d)))

register("w1_latest_reviews", with_ctes("select * from rev", views=["f_reviews"], wide=False,
                                        extra={"rev": WIDE_CTES["rev"]}))(
    lambda spark, d: W.latest_reviews(fixtures.reviews(spark, d)))

register("w1_latest_reviews_one_row", with_ctes("""
select review_id, order_id, review_score, review_creation_date, review_answer_timestamp from (
  select *, row_number() over (partition by order_id order by review_creation_date desc,
                               review_answer_timestamp desc, review_id desc) as rn from f_reviews) t
where rn = 1""", views=["f_reviews"], wide=False))(
    lambda spark, d: W.latest_reviews(fixtures.reviews(spark, d), mode="one_row"))

# ---------------------------------------------------------------- W10 display order, B6/B12/B17/B18/B19

register("w10_category_display_order", with_ctes("""
select product_category_name, row_number() over (order by v asc nulls last, product_category_name asc nulls last)
         as display_order
from (select product_category_name, max(case when review_simple = 'baixa' then percent_notas end) as v
      from m1 group by 1) t""", SCRIPT, extra={"m1": M1_SQL}))(
    lambda spark, d: share.display_order_by_last_class(
        category.category_class_summary(selected(spark, d, SCRIPT)), "product_category_name", "review_simple",
        "percent_notas"))

FOUR_STATES = ("NATION_0", "NATION_1", "NATION_2", "NATION_3")

register("m17_price_quartile_class_four_states", with_ctes("""
select score, review_simple, n_orders, gross_sales, min_order, max_order,
       n_orders / sum(n_orders) over (partition by score) as prop,
       cast(gross_sales as double) / sum(gross_sales) over (partition by score) as prop_sales
from (select score, review_simple, count(*) as n_orders, sum(total_price) as gross_sales,
             min(total_price) as min_order, max(total_price) as max_order
      from scored group by 1, 2) t""", SCRIPT,
    extra={"focus4": "select * from focus where customer_state in ("
                     + ", ".join(f"'{x}'" for x in FOUR_STATES) + ")",
           "scored": ntile_sql("total_price", price.QUARTILES, src="focus4", out="score")}))(
    lambda spark, d: price.quartile_class(focus(spark, d, SCRIPT).filter(F.col("customer_state").isin(*FOUR_STATES))))

register("b12_state_map_with_codes", with_ctes(
    "select m.nome, m.geometry, s.Sigla as customer_state, s.Region from f_state_map m "
    "left join f_states s on upper(s.Estado) = m.nome", views=["f_states", "f_state_map"], wide=False))(
    lambda spark, d: geo.state_map_with_codes(fixtures.state_map(spark, d), fixtures.states(spark, d)))

register("b17_region_choices", with_ctes("select distinct Region from items_wide"))(
    lambda spark, d: profile.distinct_values(wide_table(spark, d), "Region"))

register("b17_category_choices", with_ctes("select distinct product_category_name from items_wide"))(
    lambda spark, d: profile.distinct_values(wide_table(spark, d), "product_category_name"))

register("b18_price_bounds", with_ctes(
    "select min(total_price) + 1 as min_value, max(total_price) - 1 as max_value from items_wide"))(
    lambda spark, d: profile.column_bounds(wide_table(spark, d), "total_price", inward=1))

register("b19_payment_reconciliation", with_ctes("""
select order_id, order_total_price, total_payment_value, diff from (
  select order_id, sum(total_price) as order_total_price, max(total_payment_value) as total_payment_value,
         round_even(max(total_payment_value) - sum(total_price), 0) as diff
  from items_wide group by 1) t
where abs(diff) > 1"""))(
    lambda spark, d: profile.payment_reconciliation(wide_table(spark, d)))

# ---------------------------------------------------------------- H7-H9, H15-H17 labels and dates

register("h7_h9_state_money_labels", with_ctes("""
select Estado, n_orders, gross_sales,
       'R$' || translate(format('{:,.2f}', cast(gross_sales as double)), ',.', '.,') as gross_reais,
       'R$' || translate(format('{:,.0f}', cast(round_even(gross_sales / 1000, 0) as double)), ',.', '.,') || 'k'
         as gross_k_reais,
       translate(format('{:,.0f}', cast(n_orders as double)), ',', '.') as n_orders_label
from (select Estado, count(*) as n_orders, sum(total_price) as gross_sales from focus group by 1) t""", SCRIPT))(
    lambda spark, d: geo.state_metrics(focus(spark, d, SCRIPT)).select(
        "Estado", "n_orders", "gross_sales", labels.reais(F.col("gross_sales")).alias("gross_reais"),
        labels.k_reais(F.col("gross_sales")).alias("gross_k_reais"),
        labels.thousands(F.col("n_orders")).alias("n_orders_label")))

register("h15_h17_order_date_parts", with_ctes("""
select order_id, year(order_purchase_timestamp) as order_purchase_year,
       lpad(cast(month(order_purchase_timestamp) as varchar), 2, '0') as order_purchase_month,
       isodow(order_purchase_timestamp) - 1 as order_purchase_dayofweek
from f_orders""", views=["f_orders"], wide=False))(
    lambda spark, d: profile.with_date_parts(fixtures.orders(spark, d)).select(
        "order_id", "order_purchase_year", "order_purchase_month", "order_purchase_dayofweek"))


# ---------------------------------------------------------------- G18 density (floating: rounded on both sides)

SQRT_2PI = repr(math.sqrt(2 * math.pi))
DENSITY_SQL = f"""
select g.review_simple, g.point, g.x, g.bw,
       sum(b._w * exp(-0.5 * ((g.x - b._c) / g.bw) * ((g.x - b._c) / g.bw)) / {SQRT_2PI}) / (g._n * g.bw) as density
from (select p.review_simple, r.point, p.bw, p._n,
             p._lo + r.point * (p._hi - p._lo) / 511.0 as x
      from (select s.review_simple, s._n, pl._lo, pl._hi,
                   0.9 * (case when least(s._sd, (s._q3 - s._q1) / 1.34) > 0
                               then least(s._sd, (s._q3 - s._q1) / 1.34)
                               when s._sd > 0 then s._sd else 1.0 end) * pow(cast(s._n as double), -0.2) as bw
            from (select review_simple, count(*) as _n, stddev_samp(_x) as _sd,
                         quantile_cont(_x, 0.25) as _q1, quantile_cont(_x, 0.75) as _q3
                  from v group by 1) s cross join pooled pl) p
      cross join (select range as point from range(512)) r) g
join (select review_simple, _b, count(*) as _w, _lo + (_b + 0.5) * ((_hi - _lo) / 4096.0) as _c
      from (select review_simple, _lo, _hi,
                   case when _hi - _lo > 0 then least(floor((_x - _lo) / ((_hi - _lo) / 4096.0)), 4095) else 0 end
                     as _b
            from v cross join pooled) t
      group by review_simple, _b, _lo, _hi) b on b.review_simple = g.review_simple
group by g.review_simple, g.point, g.x, g.bw, g._n"""

register("g18_price_density", with_ctes(DENSITY_SQL, DASH, extra={
    "v": "select review_simple, log10(cast(total_price as double)) as _x from focus where total_price > 0",
    "pooled": "select min(_x) as _lo, max(_x) as _hi from v"}), {"x": 9, "bw": 9, "density": 6})(
    lambda spark, d: price.density(focus(spark, d, DASH)))


# ---------------------------------------------------------------- G9 (character, date-time), G10 (more tables)

STRING_COLS = ["order_status", "product_category_name", "customer_state", "Estado", "Region"]
register("g9_character_profile_items", with_ctes("""
select column_name, count(*) - count(v) as n_missing, cast(count(v) as double) / cast(count(*) as double) as complete_rate,
       min(length(v)) as min_length, max(length(v)) as max_length,
       cast(sum(case when v = '' then 1 else 0 end) as bigint) as empty,
       cast(sum(case when regexp_matches(v, '^\\s+$') then 1 else 0 end) as bigint) as whitespace,
       count(distinct v) as n_unique
from (""" + "\n union all ".join(f"select '{c}' as column_name, cast({c} as varchar) as v from items_wide"
                                 for c in STRING_COLS) + ") l group by 1"))(
    lambda spark, d: profile.character_profile(wide_table(spark, d), STRING_COLS))

TS_COLS = ["order_purchase_timestamp", "shipping_limit_date", "review_creation_date", "review_answer_timestamp"]
register("g9_timestamp_profile_items", with_ctes("""
select column_name, cast(sum(case when us is null then 1 else 0 end) as bigint) as n_missing,
       make_timestamp(min(us)) as min, make_timestamp(max(us)) as max,
       make_timestamp(cast(floor(quantile_cont(us, 0.5)) as bigint)) as median,
       count(distinct us) as n_unique
from (""" + "\n union all ".join(f"select '{c}' as column_name, epoch_us({c}) as us from items_wide"
                                 for c in TS_COLS) + ") l group by 1"))(
    lambda spark, d: profile.timestamp_profile(wide_table(spark, d), TS_COLS))


def _freq_sql(view: str, cols) -> str:
    body = "\n union all ".join(f"select '{c}' as column_name, cast({c} as varchar) as v from {view}" for c in cols)
    return (f"select column_name, count(distinct v) as unique_values, "
            f"cast(sum(case when v is null then 1 else 0 end) as bigint) as missing from ({body}) l group by 1")


register("g10_customer_frequencies", with_ctes(_freq_sql("f_customers", ["customer_id", "customer_state"]),
                                               views=["f_customers"], wide=False))(
    lambda spark, d: profile.frequencies(fixtures.customers(spark, d)))
register("g10_seller_frequencies", with_ctes(_freq_sql("f_sellers", ["seller_id", "seller_state"]),
                                             views=["f_sellers"], wide=False))(
    lambda spark, d: profile.frequencies(fixtures.sellers(spark, d)))


# ---------------------------------------------------------------- further forms of the reference

for _name, _class in (("bad", "baixa"), ("good", "alta")):
    register(f"m13_state_map_{_name}", with_ctes(
        "select m.nome, m.geometry, s.Estado, s.n_orders, s.gross_sales, s.prop, s.prop_gross, s.label_prod "
        "from f_state_map m left join st s on s.nome = m.nome",
        SCRIPT, extra={"f_state_map": fixtures_sql("f_state_map"), "st": _state_sql(_class)}))(
        lambda spark, d, c=_class: geo.state_map_metrics(fixtures.state_map(spark, d),
                                                         geo.state_metrics(focus(spark, d, SCRIPT), c))
        .select("nome", "geometry", "Estado", "n_orders", "gross_sales", "prop", "prop_gross", "label_prod"))

# the script ranks first and drops a NULL category afterwards
register("m3_category_table_script", with_ctes(M3_SQL, SCRIPT, extra={"m1": M1_SQL, "top": f"""
select product_category_name from (
  select product_category_name, rank() over (order by sum(number_products) desc) as rk from m1 group by 1) t
where rk <= {SCRIPT.top_n} and product_category_name is not null"""}))(
    lambda spark, d: category.category_table(category.category_class_summary(selected(spark, d, SCRIPT)),
                                             SCRIPT.top_n, drop_null_first=False))

register("m17_price_quartile_class_order_grain", with_ctes("""
select score, review_simple, n_orders, gross_sales, min_order, max_order,
       n_orders / sum(n_orders) over (partition by score) as prop,
       cast(gross_sales as double) / sum(gross_sales) over (partition by score) as prop_sales
from (select score, review_simple, count(*) as n_orders, sum(total_gross_sale) as gross_sales,
             min(total_gross_sale) as min_order, max(total_gross_sale) as max_order
      from scored group by 1, 2) t""", SCRIPT, extra={
    "order_totals": ORDER_TOTALS_SQL,
    "scored": ntile_sql("total_gross_sale", price.QUARTILES_EN, order=("order_id", "review_simple"),
                        src="order_totals", out="score")}))(
    lambda spark, d: price.quartile_class(basket.order_totals(focus(spark, d, SCRIPT)), price.QUARTILES_EN,
                                          ["order_id", "review_simple"], "total_gross_sale"))

register("g11_bad_review_score_counts", c9_sql("""
select review_score, count, 100.0 * (cast(count as double) / sum(count) over ()) as percent
from (select review_score, count(*) as count from c9 where review_score < 4 group by 1) t"""))(
    lambda spark, d: outer.with_percent(
        outer.review_score_counts(_tables(spark, d), c9_keys(spark, d)).filter(F.col("review_score") < 4),
        "review_score"))

register("b16_duplicated_item_orders", with_ctes("""
select i.order_id, i.order_item_id, c.n
from f_order_items i join (select order_id, count(*) as n from f_order_items group by 1 having count(*) > 1) c
  on c.order_id = i.order_id""", views=["f_order_items"], wide=False))(
    lambda spark, d: profile.duplicated_keys(fixtures.order_items(spark, d), "order_id")
    .select("order_id", "order_item_id", "n"))

register("w6_ship_dates_per_order_attached", with_ctes("""
select i.order_id, i.order_item_id, i.shipping_limit_date, s.n_dates
from f_order_items i join (select order_id, count(distinct shipping_limit_date) as n_dates
                           from f_order_items group by 1) s on s.order_id = i.order_id""",
    views=["f_order_items"], wide=False))(
    lambda spark, d: profile.attach_distinct(fixtures.order_items(spark, d), ["order_id"], "shipping_limit_date",
                                             "n_dates").select("order_id", "order_item_id", "shipping_limit_date",
                                                               "n_dates"))

register("w10_state_order_by_median", with_ctes("""
select customer_state, median, row_number() over (order by median asc nulls last, customer_state asc nulls last)
         as display_order
from (select customer_state, quantile_cont(cast(total_price as double), 0.5) as median from focus group by 1) t""",
    SCRIPT))(
    lambda spark, d: price.order_index_by_median(focus(spark, d, SCRIPT), "customer_state", "total_price"))

register("g9_numeric_profile_order_totals", with_ctes("""
select column_name, cast(sum(case when v is null then 1 else 0 end) as bigint) as n_missing,
       cast(count(v) as double) / cast(count(*) as double) as complete_rate,
       cast(sum(v) as double) / cast(count(v) as double) as mean, stddev_samp(cast(v as double)) as sd,
       quantile_cont(cast(v as double), 0.0) as p0, quantile_cont(cast(v as double), 0.25) as p25,
       quantile_cont(cast(v as double), 0.5) as p50, quantile_cont(cast(v as double), 0.75) as p75,
       quantile_cont(cast(v as double), 1.0) as p100
from (select 'total_gross_sale' as column_name, cast(total_gross_sale as decimal(38,6)) as v from order_totals
      union all select 'number_products', cast(number_products as decimal(38,6)) from order_totals) l
group by 1""", SCRIPT, extra={"order_totals": ORDER_TOTALS_SQL}), {"sd": 6})(
    lambda spark, d: profile.numeric_profile(
        basket.order_totals(focus(spark, d, SCRIPT)).select(
            F.col("total_gross_sale").cast("decimal(18,2)").alias("total_gross_sale"), "number_products"),
        ["total_gross_sale", "number_products"]))


# ---------------------------------------------------------------- formatted tables and labels

register("m3_category_table_formatted", with_ctes(f"""
select product_category_name, number_products,
       'R$' || translate(format('{{:,.0f}}', cast(round_even(total_gross_sale / 1000.0, 0) as double)), ',.', '.,') || 'k'
         as total_gross_sale,
       format('{{:.2f}}', round_even(alta * 100.0 / 0.01, 0) * 0.01) || '%' as alta,
       format('{{:.2f}}', round_even(baixa * 100.0 / 0.01, 0) * 0.01) || '%' as baixa,
       'R$' || translate(format('{{:,.2f}}', mean_price), ',.', '.,') as mean_price
from m3""", DASH, extra={"m1": M1_SQL, "top": _top_sql(DASH.top_n), "m3": M3_SQL}))(
    lambda spark, d: category.formatted_table(
        category.category_table(category.category_class_summary(selected(spark, d, DASH)), DASH.top_n)))


def _digits_sql(src: str, col: str, scale: float) -> str:
    """Digits that a formatter takes from a whole column."""
    return f"""
select case when g is null or g < 1.5e-8 then 0
            else greatest(case when bool_and(((cast(round_even(x * pow(10.0, 1 - floor(log10(g))), 0) as hugeint) % 10) + 10) % 10 = 0)
                               then -floor(log10(g)) else 1 - floor(log10(g)) end, 0) end as digits
from (select x, min(gap) over () as g from (
  select x, x - lag(x) over (order by x) as gap from (
    select distinct round(cast({col} as double) * {float(scale)}, 10) as x from {src} where {col} is not null) a) b) c
group by g"""


def _number_sql(x: str, digits: str, scale: float, suffix: str, marks: bool) -> str:
    cases = []
    for k in range(10):
        text = f"format('{{:{',' if marks else ''}.{k}f}}', round_even(cast({x} as double) * {float(scale)}, {k}))"
        cases.append(f"when {digits} = {k} then " + (f"translate({text}, ',.', '.,')" if marks else text))
    return f"(case {' '.join(cases)} end) || '{suffix}'"


# formatters without an accuracy take their digits from the whole column
register("h6_h9_column_digits", with_ctes(f"""
select Estado, prop, gross_sales, {_number_sql('prop', 'p.digits', 100.0, '%', False)} as prop_label,
       {_number_sql('gross_sales', 'g.digits', 1.0, '', True)} as gross_label
from st, ({_digits_sql('st', 'prop', 100.0)}) p, ({_digits_sql('st', 'gross_sales', 1.0)}) g""",
    SCRIPT, extra={"st": _state_sql(None)}))(
    lambda spark, d: _column_digits(spark, d))


def _column_digits(spark, d) -> DataFrame:
    st = materialize(geo.state_metrics(focus(spark, d, SCRIPT)))
    st = labels.with_column_accuracy(st, "prop", 100.0, "_p")
    st = labels.with_column_accuracy(st, "gross_sales", 1.0, "_g")
    return st.select("Estado", "prop", "gross_sales",
                     labels.number(F.col("prop"), F.col("_p"), 100.0, "%").alias("prop_label"),
                     labels.number(F.col("gross_sales"), F.col("_g"), marks=True).alias("gross_label"))


register("g14_payment_type_labels", c9_sql("""
select payment_type, count, format('{:.1f}', 100.0 * count / sum(count) over ()) || '%' as percent_label,
       format('{:.2f}', count / 1000.0) || 'k' as thousands_label
from (select payment_type, count(*) as count from c9 where payment_type is not null group by 1) t"""))(
    lambda spark, d: _bar_labels(materialize(outer.payment_type_counts(_tables(spark, d), c9_keys(spark, d)))))


def _bar_labels(counts: DataFrame) -> DataFrame:
    total = counts.agg(F.sum("count")).scalar()
    return counts.select("payment_type", "count", labels.bar_percent(F.col("count"), total).alias("percent_label"),
                         labels.bar_thousands(F.col("count")).alias("thousands_label"))


# ---------------------------------------------------------------- A1, A4, A5 files; G10 by sketch

CSV_ORDERS = ("order_id bigint, customer_id bigint, order_status string, "
              + ", ".join(f"{c} string" for c in fixtures.ORDER_TIMES))


def _csv_path(spark, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/vitrine-tables/{name}-{uuid.uuid4().hex}"


def _orders_through_csv(spark, d) -> DataFrame:
    """Orders written as CSV with their dates as text, read back with the dates coerced."""
    path = _csv_path(spark, "orders-csv")
    io.write_csv(fixtures.orders_with_times(spark, d), path)
    good, _ = io.read_csv_checked(spark, "orders", path, sep=";", schema=CSV_ORDERS)
    return good


def _messages_through_csv(spark, d) -> DataFrame:
    """Messages with line breaks, quotes and separators written as CSV and read back whole."""
    path = _csv_path(spark, "messages-csv")
    io.write_csv(fixtures.messages(spark, d), path)
    schema = "review_id bigint, review_comment_message string"
    good, _ = io.read_csv_checked(spark, "reviews", path, sep=";", schema=schema)
    return good


register("a1_a5_orders_csv", with_ctes("""
select o.order_id, o.customer_id, o.order_status, t.* exclude (order_id)
from f_orders o join f_order_times t on t.order_id = o.order_id""", views=["f_orders", "f_order_times"], wide=False))(
    _orders_through_csv)

register("a1_a5_messages_csv", "select doc_id as review_id, text as review_comment_message from documents")(
    _messages_through_csv)

register("a4_translated_products", with_ctes("""
select product_id, product_category_name,
       case when product_category_name <> 'PROMO' then lower(product_category_name) end as product_category_name_english
from f_products""", views=["f_products"], wide=False))(
    lambda spark, d: io.translate_categories(fixtures.products(spark, d), fixtures.category_translation(spark, d))
    .select("product_id", "product_category_name", "product_category_name_english"))

# an estimate: tests hold it against the exact numbers
register("g10_order_frequencies_sketch", None)(
    lambda spark, d: profile.sketched_frequencies(fixtures.orders(spark, d)))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: q.run for name, q in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    return {name: q.oracle() for name, q in REGISTRY.items() if q.sql is not None}
