"""Payment metrics M18 (method x class) and M19 (payment mix)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.functions.labels import count_present, names_present
from vitrine.operators.share import share_of_total, share_within
from vitrine.operators.wide import PAYMENT_TYPES

CLS = "review_simple"


def method_class(foc: DataFrame, grain: str = "item") -> DataFrame:
    """Unpivot the four method columns (NULLs dropped), count and gross per
    (class, method), shares within method.

    ``grain="item"`` (reference) counts an order's payment once per item row;
    ``grain="order"`` first reduces to one row per (order, class).
    """
    base = foc.select("order_id", CLS, *PAYMENT_TYPES)
    if grain == "order":
        base = base.dropDuplicates(["order_id", CLS])
    long = (base.unpivot(["order_id", CLS], PAYMENT_TYPES, "payment_method", "gross_sales")
            .filter(F.col("gross_sales").isNotNull()))
    agg = long.groupBy(CLS, "payment_method").agg(F.count(F.lit(1)).alias("n_count"),
                                                  F.sum("gross_sales").alias("gross_sales"))
    return share_within(agg, ["payment_method"], {"prop_qnt": "n_count", "prop_sales": "gross_sales"})


def payment_mix(items: DataFrame) -> DataFrame:
    """Per (number of methods on the order, method) item-row count and share of all."""
    cols = {t: F.col(t) for t in PAYMENT_TYPES}
    exploded = items.select(count_present(*cols.values()).alias("formas"),
                            F.explode(names_present(cols)).alias("names_to_extend"))
    agg = (exploded.groupBy("formas", "names_to_extend")
           .agg(F.count(F.lit(1)).alias("quantidade_compras"))
           .withColumn("formas", F.col("formas").cast("string")))
    return share_of_total(agg, {"percent_compras": "quantidade_compras"})
