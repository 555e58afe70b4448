"""Basket-size metrics M8-M10 and order totals G5.

Two-level aggregation: first per (order, class) -- a partial/final hash
aggregate that tolerates hot orders -- then per (class, bucket) on the much
smaller order-level table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.functions.labels import percent
from vitrine.operators.share import mean, share_of_total, share_within

CLS = "review_simple"
# Fixed value: label of the open-ended basket bucket.
THREE_PLUS = "3 ou mais"


def order_totals(foc: DataFrame) -> DataFrame:
    """G5 (and the first level of M8/M9): per (order, class) gross, mean and item count."""
    return foc.groupBy("order_id", CLS).agg(
        F.sum("total_price").alias("total_gross_sale"),
        mean("total_price").alias("mean_price"),
        F.count(F.lit(1)).alias("number_products"))


def basket_buckets(foc: DataFrame) -> DataFrame:
    """M8: orders and gross per (class, '1'/'2'/'3 ou mais'), shares within bucket."""
    per_order = order_totals(foc).withColumn(
        "bucket_itens", F.when(F.col("number_products") >= 3, F.lit(THREE_PLUS))
        .otherwise(F.col("number_products").cast("string")))
    agg = per_order.groupBy(CLS, "bucket_itens").agg(
        F.count(F.lit(1)).alias("number_products"),
        F.sum("total_gross_sale").alias("total_gross_sale"))
    return share_within(agg, ["bucket_itens"], {"percent_notas": "number_products",
                                                "percent_notas_gs": "total_gross_sale"})


def basket_histogram(foc: DataFrame, accuracy: float = 2.0) -> DataFrame:
    """M9: per (class, exact basket size) orders and gross; shares within size and within class."""
    agg = order_totals(foc).groupBy(CLS, "number_products").agg(
        F.count(F.lit(1)).alias("number_instances"),
        F.sum("total_gross_sale").alias("total_gross_sale"))
    agg = share_within(agg, ["number_products"], {"percent_notas": "number_instances",
                                                  "percent_gross_sales": "total_gross_sale"})
    agg = share_within(agg, [CLS], {"percent_prod": "number_instances",
                                    "percent_prod_gs": "total_gross_sale"})
    return (agg.withColumn("percent_prod_p", percent(F.col("percent_prod"), accuracy))
            .withColumn("percent_prod_gs_p", percent(F.col("percent_prod_gs"), accuracy)))


def bucket_share(m8: DataFrame) -> DataFrame:
    """Orders per bucket over all orders."""
    per_bucket = m8.groupBy("bucket_itens").agg(F.sum("number_products").alias("number_products"))
    return share_of_total(per_bucket, {"percent_prod": "number_products"})
