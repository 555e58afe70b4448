"""Row labels and predicates (B4-B10, H1, H2): pure Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrine.params import Params

GOOD, BAD = "alta", "baixa"


def not_in(col: Column, values) -> Column:
    """R's ``%!in%`` -- TRUE for NULL (``NA %in% x`` is FALSE)."""
    return ~F.coalesce(col.isin(*values), F.lit(False))


def review_class_fixed(score: Column) -> Column:
    """Scores 1-3 bad, 4-5 good, anything else NULL (caller drops it)."""
    return (F.when(score.isin(1, 2, 3), F.lit(BAD))
            .when(score.isin(4, 5), F.lit(GOOD)))


def review_class(score: Column, good_scores) -> Column:
    """Score in the chosen set -> alta, otherwise (NULL included) baixa."""
    good = [int(s) for s in good_scores]
    return F.when(score.isin(*good), F.lit(GOOD)).when(not_in(score, good), F.lit(BAD))


def merge_categories(cat: Column, categories, new_name: str) -> Column:
    """Listed categories become ``new_name``; others (NULL included) unchanged."""
    if not categories:
        return cat
    return F.when(cat.isin(*categories), F.lit(new_name)).otherwise(cat)


def price_filter(price: Column, lo: float, hi: float, closed: bool = True) -> Column:
    """Closed range (dashboard) or open range (small dashboard)."""
    # decimal bounds: a double would cast the column, and the filter could not reach the scan
    lo, hi = (F.lit(x).cast("decimal(18,2)") for x in (lo, hi))
    if closed:
        return (price >= lo) & (price <= hi)
    return (price > lo) & (price < hi)


def selected(wide: DataFrame, p: Params) -> DataFrame:
    """Dashboard ``selected()``: class label, region + price filter, category merge."""
    df = wide.withColumn("review_simple", review_class(F.col("review_score"), p.good_scores))
    if p.regions is not None:
        df = df.filter(F.col("Region").isin(*p.regions))
    if p.price_range is not None:
        df = df.filter(price_filter(F.col("total_price"), *p.price_range, closed=p.closed))
    return df.withColumn("product_category_name",
                         merge_categories(F.col("product_category_name"), p.merge_categories,
                                          p.new_category_name))


def in_focus(cat: Column, p: Params) -> Column:
    """B9 before B8: the category as it stands in the table is merged into the focus, or is named like it.

    A filter on the merged name cannot reach the scan; this one can."""
    return cat.isin(*dict.fromkeys([*(p.merge_categories or ()), p.new_category_name]))


def focus(sel: DataFrame, p: Params) -> DataFrame:
    """The (possibly merged) focus category."""
    return sel.filter(F.col("product_category_name") == F.lit(p.new_category_name))
