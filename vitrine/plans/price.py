"""Price metrics: quartiles x class (M17), exact quantiles (G8), box plot (G16),
histogram (G17) and binned density (G18)."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vitrine.operators.rank import exact_quantiles, join_null_safe, ntile_labels
from vitrine.operators.share import share_within

CLS = "review_simple"
# Quartile labels of the dashboard/script and of the exploration script.
QUARTILES = ["primeiro", "segundo", "terceiro", "quarto"]
QUARTILES_EN = ["first", "second", "third", "fourth"]
ROW_KEY = ["order_id", "order_item_id", "review_id"]


def quartile_class(foc: DataFrame, labels=QUARTILES, tie_break=ROW_KEY, value: str = "total_price") -> DataFrame:
    """Price quartile (Q1) x class: rows, gross, min/max price; shares within quartile."""
    scored = ntile_labels(foc.select(*dict.fromkeys([CLS, value, *tie_break])), value, tie_break, labels, "score")
    agg = scored.groupBy("score", CLS).agg(
        F.count(F.lit(1)).alias("n_orders"), F.sum(value).alias("gross_sales"),
        F.min(value).alias("min_order"), F.max(value).alias("max_order"))
    return share_within(agg, ["score"], {"prop": "n_orders", "prop_sales": "gross_sales"})


def price_quantiles(df: DataFrame, value: str = "total_price", part=()) -> DataFrame:
    """Exact 25/50/75 % quantiles (type 7)."""
    return exact_quantiles(df, value, [0.25, 0.5, 0.75], part,
                           names=["first_quantile", "second_quantile", "third_quantile"])


def box_stats(df: DataFrame, value: str = "total_price", by: str = CLS) -> DataFrame:
    """Per group quartiles, IQR fences at 1.5 IQR, whiskers (extreme values
    inside the fences) and outlier count, as a box plot draws them."""
    q = exact_quantiles(df, value, [0.0, 0.25, 0.5, 0.75, 1.0], [by],
                        names=["ymin_all", "lower", "middle", "upper", "ymax_all"])
    q = (q.withColumn("iqr", F.col("upper") - F.col("lower"))
         .withColumn("fence_lo", F.col("lower") - 1.5 * F.col("iqr"))
         .withColumn("fence_hi", F.col("upper") + 1.5 * F.col("iqr")))
    x = F.col(value).cast("double")
    inside = (x >= F.col("fence_lo")) & (x <= F.col("fence_hi"))
    w = join_null_safe(df.select(by, value), q, [by]).groupBy(by).agg(
        F.min(F.when(inside, x)).alias("ymin"), F.max(F.when(inside, x)).alias("ymax"),
        F.sum(F.when(~inside, 1).otherwise(0)).alias("n_outliers"),
        F.count(F.lit(1)).alias("n"))
    return join_null_safe(q, w, [by]).select(by, "n", "ymin", "lower", "middle", "upper", "ymax", "n_outliers")


def histogram(df: DataFrame, value: str, bins: int, log10: bool = False) -> DataFrame:
    """Equal-width histogram between the column's min and max (max falls in the
    last bin); ``log10`` bins log10(value) of positive values."""
    x = F.col(value).cast("double")
    if log10:
        df = df.filter(x > 0)
        x = F.log10(x)
    v = df.select(x.alias("_x")).filter(F.col("_x").isNotNull())
    bounds = v.agg(F.struct(F.min("_x").alias("lo"), F.max("_x").alias("hi"))).scalar()
    width = (F.col("_hi") - F.col("_lo")) / F.lit(float(bins))
    b = F.when(width > 0, F.least(F.floor((F.col("_x") - F.col("_lo")) / width), F.lit(bins - 1))).otherwise(0)
    return (v.withColumn("_lo", bounds.getField("lo")).withColumn("_hi", bounds.getField("hi"))
            .withColumn("bin", b.cast("int"))
            .groupBy("bin").agg(F.count(F.lit(1)).alias("count"),
                                F.first("_lo").alias("_lo"), F.first("_hi").alias("_hi"))
            .withColumn("bin_lo", F.col("_lo") + F.col("bin") * (F.col("_hi") - F.col("_lo")) / bins)
            .withColumn("bin_hi", F.col("_lo") + (F.col("bin") + 1) * (F.col("_hi") - F.col("_lo")) / bins)
            .select("bin", "bin_lo", "bin_hi", "count"))


def density(df: DataFrame, value: str = "total_price", by: str = CLS, grid: int = 512,
            fine_bins: int = 4096, log10: bool = True) -> DataFrame:
    """Gaussian kernel density per class on log10(value), evaluated on ``grid``
    points spanning the pooled range, with R's ``bw.nrd0`` bandwidth per class.

    Rows are first binned to ``fine_bins`` bins (weights at bin midpoints; R's
    ``density`` bins too), so the grid evaluation is a (bins x grid) product
    whose size is bounded by the parameters, never by the row count.
    """
    x = F.col(value).cast("double")
    base = df.filter(x > 0) if log10 else df
    v = base.select(by, (F.log10(x) if log10 else x).alias("_x")).filter(F.col("_x").isNotNull())
    quart = exact_quantiles(v, "_x", [0.25, 0.75], [by], names=["_q1", "_q3"])
    stats = v.groupBy(by).agg(F.count(F.lit(1)).alias("_n"), F.stddev_samp("_x").alias("_sd"))
    pooled = v.agg(F.struct(F.min("_x").alias("lo"), F.max("_x").alias("hi"))).scalar()

    def with_pooled(t: DataFrame) -> DataFrame:
        return t.withColumn("_lo", pooled.getField("lo")).withColumn("_hi", pooled.getField("hi"))

    # bw.nrd0: 0.9 * min(sd, IQR / 1.34) * n^-0.2, falling back to sd and then 1 when
    # that minimum is 0 (R's next fallback, |first value|, depends on row order)
    spread = F.least(F.col("_sd"), (F.col("_q3") - F.col("_q1")) / F.lit(1.34))
    spread = F.when(spread > 0, spread).when(F.col("_sd") > 0, F.col("_sd")).otherwise(F.lit(1.0))
    bw = F.lit(0.9) * spread * F.pow(F.col("_n").cast("double"), F.lit(-0.2))
    params = with_pooled(join_null_safe(stats, quart, [by]).withColumn("bw", bw))
    width = (F.col("_hi") - F.col("_lo")) / F.lit(float(fine_bins))
    binned = (with_pooled(v)
              .withColumn("_b", F.when(F.col("_hi") - F.col("_lo") > 0,
                                       F.least(F.floor((F.col("_x") - F.col("_lo")) / width),
                                               F.lit(fine_bins - 1))).otherwise(F.lit(0)))
              .groupBy(by, "_b", "_lo", "_hi").agg(F.count(F.lit(1)).alias("_w"))
              .withColumn("_c", F.col("_lo") + (F.col("_b") + F.lit(0.5)) * width)
              .select(by, "_b", "_w", "_c"))
    # ``grid`` evaluation points per class (params: one row per class)
    g = (params.select(by, "bw", "_n", "_lo", "_hi",
                       F.explode(F.sequence(F.lit(0), F.lit(grid - 1))).alias("point"))
         .withColumn("x", F.col("_lo") + F.col("point") * (F.col("_hi") - F.col("_lo")) / F.lit(float(grid - 1))))
    z = (F.col("x") - F.col("_c")) / F.col("bw")
    k = F.col("_w") * F.exp(F.lit(-0.5) * z * z) / F.lit(math.sqrt(2 * math.pi))
    dens = (join_null_safe(binned, g, [by])
            .groupBy(by, "point", "x", "bw", "_n").agg(F.sum(k).alias("_s"))
            .withColumn("density", F.col("_s") / (F.col("_n") * F.col("bw"))))
    return dens.select(by, "point", "x", "bw", "density")


def order_index_by_median(df: DataFrame, key: str, value: str) -> DataFrame:
    """W10 first form (``fct_reorder(f, x)``): display order of keys by median value."""
    med = exact_quantiles(df, value, [0.5], [key], names=["median"])
    return med.select(key, "median", F.row_number().over(
        Window.orderBy(F.asc_nulls_last("median"), F.asc_nulls_last(key))).alias("display_order"))
