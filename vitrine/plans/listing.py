"""Listing-attribute metrics M20-M22 (photos bucket, description-length sextile)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrine.functions.classify import GOOD
from vitrine.operators.rank import ntile_labels
from vitrine.operators.share import mean, ratio, share_within

CLS = "review_simple"
# Photo buckets and sextile labels, in display order.
PHOTO_BUCKETS = ["1", "2-3", "4-5", "6+"]
SEXTILES = ["1º", "2º", "3º", "4º", "5º", "6º"]
# identifying columns of an item-review row: the rank tie-break (trap S21)
ROW_KEY = ["order_id", "order_item_id", "review_id"]


def photo_bucket(photos: Column) -> Column:
    """'1', '2-3', '4-5', '6+'; NULL (or < 1) photos give NULL."""
    return (F.when(photos == 1, F.lit("1"))
            .when((photos >= 2) & (photos <= 3), F.lit("2-3"))
            .when((photos >= 4) & (photos <= 5), F.lit("4-5"))
            .when(photos >= 6, F.lit("6+")))


def with_listing_cells(foc: DataFrame, tie_break=ROW_KEY, checkpoint: bool = True) -> DataFrame:
    """``df_solution``: photo bucket + description-length sextile (Q2) on each row, of the columns that
    M20-M22 and the what-if read (the rank writes its input).

    Checkpointed by default: they all read it."""
    used = [*ROW_KEY, *tie_break, CLS, "total_price", "product_photos_qty", "product_description_lenght"]
    df = foc.select(*[c for c in dict.fromkeys(used) if c in foc.columns]).withColumn("bucket_photos", photo_bucket(F.col("product_photos_qty")))
    return ntile_labels(df, "product_description_lenght", tie_break, SEXTILES, "quantil_desc",
                        checkpoint_output=checkpoint)


def photos_class(sol: DataFrame) -> DataFrame:
    """Per (photo bucket, class) gross, mean price, items; shares within bucket."""
    agg = sol.groupBy("bucket_photos", CLS).agg(
        F.sum("total_price").alias("total_gross_sale"), mean("total_price").alias("mean_price"),
        F.count(F.lit(1)).alias("number_products"))
    return share_within(agg, ["bucket_photos"], {"percent_notas": "number_products",
                                                 "percent_sales": "total_gross_sale"})


def sextile_class(sol: DataFrame) -> DataFrame:
    """Per (sextile, class) as M20 plus min/max characters."""
    agg = sol.groupBy("quantil_desc", CLS).agg(
        F.sum("total_price").alias("total_gross_sale"), mean("total_price").alias("mean_price"),
        F.count(F.lit(1)).alias("number_products"),
        F.min("product_description_lenght").alias("min_caracters_desc"),
        F.max("product_description_lenght").alias("max_caracters_desc"))
    return share_within(agg, ["quantil_desc"], {"percent_notas": "number_products",
                                                "percent_sales": "total_gross_sale"})


def cell_table(sol: DataFrame) -> DataFrame:
    """Per (photo bucket, sextile) cell: gross, items, alta share of items and of
    sales, mean/min(+1, trap S14)/max characters -- one pass with conditional sums,
    equal to the reference's per-class-then-per-cell form."""
    good = F.col(CLS) == GOOD
    return sol.groupBy("bucket_photos", "quantil_desc").agg(
        F.sum("total_price").alias("gross_sales1"),
        F.count(F.lit(1)).alias("total_number_products"),
        ratio(F.sum(F.when(good, 1).otherwise(0)), F.count(F.lit(1))).alias("prop_quantity"),
        ratio(F.sum(F.when(good, F.col("total_price")).otherwise(F.lit(0).cast("decimal(18,2)"))),
              F.sum("total_price")).alias("prop_sales"),
        ratio(F.sum("product_description_lenght"), F.count(F.lit(1))).alias("mean_caracters_desc"),
        (F.min("product_description_lenght") + 1).alias("min_caracters_desc"),
        F.max("product_description_lenght").alias("max_caracters_desc"))
