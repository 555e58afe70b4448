"""Category metrics M1-M7 (dashboard "categories" tab)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.functions import labels
from vitrine.functions.aggregates import strict_sum
from vitrine.functions.classify import BAD, GOOD
from vitrine.operators.share import mean, ratio, share_within, top_n_with_ties

CAT, CLS = "product_category_name", "review_simple"


def category_class_summary(sel: DataFrame) -> DataFrame:
    """M1: per (category, class) gross sales, mean price, item count, shares within category."""
    agg = sel.groupBy(CAT, CLS).agg(
        F.sum("total_price").alias("total_gross_sale"),
        mean("total_price").alias("mean_price"),
        F.count(F.lit(1)).alias("number_products"))
    return share_within(agg, [CAT], {"percent_notas": "number_products",
                                     "percent_sales": "total_gross_sale"})


def top_categories(m1: DataFrame, n: int, drop_null_first: bool = True) -> DataFrame:
    """M2: the top-n categories by item count (ties kept), NULL category removed."""
    per_cat = m1.groupBy(CAT).agg(F.sum("number_products").alias("total_values"))
    return top_n_with_ties(per_cat, CAT, "total_values", n, drop_null_first)


def category_table(m1: DataFrame, n: int, drop_null_first: bool = True) -> DataFrame:
    """M3: per top category: gross sales, items, alta/baixa shares, mean price.

    """
    top = top_categories(m1, n, drop_null_first).select(CAT)
    m2 = m1.join(top, CAT, "left_semi")
    return (m2.groupBy(CAT).agg(
        F.sum("total_gross_sale").alias("total_gross_sale"),
        F.sum("number_products").alias("number_products"),
        F.avg(F.when(F.col(CLS) == GOOD, F.col("percent_notas"))).alias(GOOD),
        F.avg(F.when(F.col(CLS) == BAD, F.col("percent_notas"))).alias(BAD))
        .withColumn("mean_price", ratio("total_gross_sale", "number_products"))
        .orderBy(F.desc("number_products")))


def formatted_table(table: DataFrame) -> DataFrame:
    """M3 as the dashboard prints it: shares to two decimals, gross sales in thousands, mean price in reais."""
    return table.select(CAT, labels.k_reais(F.col("total_gross_sale")).alias("total_gross_sale"), "number_products",
                        labels.percent(F.col(GOOD), 0.01).alias(GOOD), labels.percent(F.col(BAD), 0.01).alias(BAD),
                        labels.reais(F.col("mean_price")).alias("mean_price"))


def share_pivot(m1: DataFrame) -> DataFrame:
    """M4: percent_notas pivoted to one column per class (fixed value list)."""
    return m1.groupBy(CAT).pivot(CLS, [GOOD, BAD]).agg(F.first("percent_notas"))


def focus_kpis(foc: DataFrame, strict_na: bool = False) -> DataFrame:
    """M5-M7: approval share (explicit alta share, 0 if none), gross sales, item count.
    ``strict_na``: gross sales NULL if any price is NULL (R's ``sum`` without ``na.rm``)."""
    return foc.agg(
        F.avg(F.when(F.col(CLS) == GOOD, F.lit(1.0)).otherwise(F.lit(0.0))).alias("approval"),
        (strict_sum("total_price") if strict_na else F.sum("total_price")).alias("gross_sales"),
        F.count(F.lit(1)).alias("number_products"))
