"""Shares, top-n and ordering helpers.

All of these run on *aggregated* tables (one row per category, state, cell,
...), never on raw rows.  Grand totals (W3) are scalar subqueries -- one value,
computed once -- instead of an unpartitioned window that would pull every row
into one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def ratio(num, den):
    """Double ratio of two (exact decimal or integer) values; NULL on a zero denominator."""
    num = F.col(num) if isinstance(num, str) else num
    den = F.col(den) if isinstance(den, str) else den
    return F.try_divide(num.cast("double"), den.cast("double"))


def mean(c: str):
    """avg computed as exact sum / count, so it is identical on every engine and partitioning."""
    return ratio(F.sum(c), F.count(c))


def share_within(df: DataFrame, keys, pairs: dict[str, str]) -> DataFrame:
    """``out = x / sum(x) over (partition by keys)`` for each ``out -> x``."""
    w = Window.partitionBy(*keys)
    for out, x in pairs.items():
        df = df.withColumn(out, ratio(F.col(x), F.sum(x).over(w)))
    return df


def share_of_total(df: DataFrame, pairs: dict[str, str]) -> DataFrame:
    """``out = x / sum(x)`` over the whole table; the total is an uncorrelated
    scalar subquery (evaluated once, inlined as a value), not a window or a join."""
    for out, x in pairs.items():
        df = df.withColumn(out, ratio(x, df.agg(F.sum(x)).scalar()))
    return df


def top_n_with_ties(df: DataFrame, key: str, metric: str, n: int, drop_null_first: bool = True) -> DataFrame:
    """F2 (+W8): rows whose metric ranks <= n (ties kept), one row per key.

    ``drop_null_first`` removes a NULL key before ranking (dashboard); False
    ranks first and removes it after (scripts: may leave n-1 keys).
    The window spans one row per key (a category list), not raw rows.
    """
    if drop_null_first:
        df = df.filter(F.col(key).isNotNull())
    ranked = df.withColumn("_rk", F.rank().over(Window.orderBy(F.desc(metric))))
    ranked = ranked.filter(F.col("_rk") <= n)
    if not drop_null_first:
        ranked = ranked.filter(F.col(key).isNotNull())
    return ranked.drop("_rk")


def best_row(df: DataFrame, metric: str, tie_break=()) -> DataFrame:
    """the single row with the highest metric (TakeOrdered of one row)."""
    order = [F.desc_nulls_last(metric)] + [F.asc_nulls_last(c) for c in tie_break]
    return df.orderBy(*order).limit(1)


def display_order_by_last_class(df: DataFrame, key: str, cls: str, value: str,
                                last_class: str = "baixa") -> DataFrame:
    """W10 (``fct_reorder2(key, cls, -value)``): order keys by the value at the
    last class level, descending on ``-value`` = ascending on value.
    Returns (key, display_order)."""
    per_key = df.groupBy(key).agg(
        F.max(F.when(F.col(cls) == last_class, F.col(value))).alias("_v"))
    return per_key.select(key, F.row_number().over(
        Window.orderBy(F.asc_nulls_last("_v"), F.asc_nulls_last(key))).alias("display_order"))
