"""Region and state metrics M11-M16.

States and regions are fixed domains (tens of rows), so their aggregates are
tiny.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.functions.aggregates import strict_sum
from vitrine.functions.classify import price_filter
from vitrine.functions.labels import paste, percent
from vitrine.operators.share import share_of_total, share_within

CLS = "review_simple"


def state_metrics(foc: DataFrame, review_class: str | None = None, accuracy: float = 2.0,
                  strict_na: bool = False) -> DataFrame:
    """M11 (M12 with ``review_class``): per state item rows, gross, shares of the total.

    ``n_orders`` counts item rows, as the reference does.  ``strict_na``: a state's
    gross is NULL if any of its prices is NULL (R's ``sum`` without ``na.rm``).
    """
    if review_class is not None:
        foc = foc.filter(F.col(CLS) == review_class)
    gross = strict_sum("total_price") if strict_na else F.sum("total_price")
    agg = foc.groupBy("Estado").agg(F.count(F.lit(1)).alias("n_orders"), gross.alias("gross_sales"))
    agg = share_of_total(agg, {"prop": "n_orders", "prop_gross": "gross_sales"})
    return (agg.withColumn("nome", F.upper("Estado"))
            .withColumn("label_prod", paste(percent(F.col("prop"), accuracy), F.col("n_orders"))))


def state_map_metrics(state_map: DataFrame, metrics: DataFrame) -> DataFrame:
    """Every map state kept, metrics NULL where a state has no rows."""
    return state_map.join(metrics, "nome", "left")


def state_map_with_codes(state_map: DataFrame, states: DataFrame) -> DataFrame:
    """B12 (+C7 variant): map states joined to the state list on the upper-cased
    name, code renamed to ``customer_state``.  The state list is a fixed domain."""
    codes = states.select(F.upper("Estado").alias("nome"), F.col("Sigla").alias("customer_state"), "Region")
    return state_map.join(codes, "nome", "left")


def unmatched_states(metrics: DataFrame, state_map: DataFrame) -> DataFrame:
    """S23 check: metric states whose upper-cased name finds no map state."""
    return metrics.join(state_map.select("nome"), "nome", "left_anti")


def region_class(items: DataFrame) -> DataFrame:
    """Items per (region, class), share within region."""
    agg = items.groupBy("Region", CLS).agg(F.count(F.lit(1)).alias("number_products"))
    return share_within(agg, ["Region"], {"percent_notas": "number_products"})


def state_class(items: DataFrame) -> DataFrame:
    """Item rows per (state, class), share within state."""
    agg = items.groupBy("customer_state", CLS).agg(F.count(F.lit(1)).alias("n_orders"))
    return share_within(agg, ["customer_state"], {"prop": "n_orders"})


def region_counts(items: DataFrame, lo: float, hi: float, closed: bool = False) -> DataFrame:
    """Rows per region inside a price window (open by default, as the small dashboard)."""
    return (items.filter(price_filter(F.col("total_price"), lo, hi, closed))
            .groupBy("Region").agg(F.count(F.lit(1)).alias("n")))
