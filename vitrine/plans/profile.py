"""Data checks and profiles: G1, G6, G7, G9-G15, B16/W5, W6, C8, C9, G13.

Per-column profiles unpivot the columns into one long (column, value) table
and aggregate by column once, instead of one job (or one Python loop
iteration) per column.  Moments are computed from exact decimal/integer sums,
so every engine and partitioning gives the same doubles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitrine.functions.classify import review_class_fixed
from vitrine.functions.timeutil import micros_to_ntz, ntz_to_micros
from vitrine.operators.lineage import materialize
from vitrine.operators.outer_join import key_counts, outer_join
from vitrine.operators.rank import exact_quantiles
from vitrine.operators.share import ratio, share_of_total
from vitrine.plans import moments

# ------------------------------------------------------------------ counts


def value_counts(df: DataFrame, col: str) -> DataFrame:
    """G11 (+G14): counts per value, NULL removed, with percent of the total; sorted desc."""
    agg = df.filter(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("count"))
    agg = share_of_total(agg, {"share": "count"}).withColumn("percent", F.col("share") * 100.0)
    return agg.drop("share").orderBy(F.desc("count"), F.asc(col))


def shares_without_rare(df: DataFrame, col: str, drop_last: int, counts: DataFrame | None = None) -> DataFrame:
    """Value counts minus the ``drop_last`` least frequent values, percent of the rest.

    The rare values are a distributed top-k (each task keeps its ``drop_last``
    smallest, ties by value) removed with a broadcast anti join of at most
    ``drop_last`` rows -- no window over all distinct values.  ``counts`` may be
    given precomputed as (col, count)."""
    agg = counts if counts is not None else (
        df.filter(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("count")))
    agg = materialize(agg, "counts")  # read for the rare values, the rest and the total
    if drop_last > 0:
        rare = agg.orderBy(F.asc("count"), F.desc(col)).limit(drop_last).select(col)
        agg = agg.join(F.broadcast(rare), col, "left_anti")
    return share_of_total(agg, {"share": "count"})


def group_counts(df: DataFrame, *cols: str) -> DataFrame:
    """G1: ``count(col)`` -- rows per value (NULL kept as a group, as dplyr does)."""
    return df.groupBy(*cols).agg(F.count(F.lit(1)).alias("n"))


def status_class_counts(wide_all_status: DataFrame) -> DataFrame:
    """Non-delivered item rows per (fixed review class, status)."""
    return (wide_all_status.withColumn("review_simple", review_class_fixed(F.col("review_score")))
            .filter(F.col("review_simple").isNotNull() & (F.col("order_status") != "delivered"))
            .groupBy("review_simple", "order_status").agg(F.count(F.lit(1)).alias("n")))


def distinct_per_group(df: DataFrame, keys, col: str, out: str) -> DataFrame:
    """``n_distinct(col)`` per group (two-level distinct aggregate)."""
    return df.groupBy(*keys).agg(F.countDistinct(col).alias(out))


def attach_distinct(df: DataFrame, keys, col: str, out: str) -> DataFrame:
    """G7 joined back to every row (no DISTINCT window aggregate in Spark)."""
    return df.join(distinct_per_group(df, keys, col, out), list(keys))


def duplicated_keys(df: DataFrame, key: str) -> DataFrame:
    """Rows whose key occurs more than once, with the count ``n``.

    Aggregate + join instead of a window, so one hot key is not sorted in one task."""
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)
    return df.join(counts, key)


def without_match(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Left rows with no right row on ``key``."""
    return left.join(right.select(key), key, "left_anti")


def distinct_values(df: DataFrame, col: str) -> DataFrame:
    """The choice list of a column (NULL kept, as ``unique()`` does)."""
    return df.select(col).distinct()


def column_bounds(df: DataFrame, col: str, inward: float = 0.0) -> DataFrame:
    """Slider bounds, optionally moved ``inward`` (the small dashboard uses 1)."""
    return df.agg((F.min(col) + F.lit(inward)).alias("min_value"), (F.max(col) - F.lit(inward)).alias("max_value"))


def payment_reconciliation(wide: DataFrame, tolerance: int = 1) -> DataFrame:
    """B19 (commented out in the reference): orders whose payments differ from the
    price of their items by more than ``tolerance`` after rounding half-to-even.

    Compared at order grain: payment totals repeat on every item row (trap S6),
    so the item prices are summed per order first."""
    per_order = wide.groupBy("order_id").agg(F.sum("total_price").alias("order_total_price"),
                                             F.max("total_payment_value").alias("total_payment_value"))
    return (per_order.withColumn("diff", F.bround(F.col("total_payment_value") - F.col("order_total_price"), 0))
            .filter(F.abs(F.col("diff")) > tolerance))


# ------------------------------------------------------------------ C9


LOOKUPS = (("products", "product_id"), ("customers", "customer_id"), ("sellers", "seller_id"))


def order_rows(t, orders: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Orders left items (written once), and the same with each row's product, customer and seller: the order
    side of C9.  Lookups are joined here, before payments and reviews multiply the rows."""
    base = materialize(outer_join([t.orders if orders is None else orders, t.order_items], "order_id", [True, False]), "items")
    rows = base
    for name, key in LOOKUPS:
        rows = outer_join([rows, getattr(t, name)], key, [True, False], key_rows=[base, getattr(t, name)])
    return base, rows


def full_outer_wide(t) -> DataFrame:
    """The notebook's wide table: orders left items, then full outer with raw
    payments, reviews, products, customers and sellers (m:m fan-out kept).

    ``outer_join`` keeps NULL keys out of the shuffles and splits hot keys; products,
    customers and sellers that no order names are appended as rows of their own."""
    orders = outer_join([t.orders, t.customers], "customer_id", [True, False])
    items = t.order_items  # each table meets its lookups before the order's other rows widen and multiply it
    for name, key in LOOKUPS:
        if key in items.columns:
            items = outer_join([items, getattr(t, name)], key, [True, False])
    counts = materialize(key_counts([t.orders, t.order_items, t.payments, t.reviews], "order_id"), "keys")
    out = outer_join([orders, items, t.payments, t.reviews], "order_id", [True, False, True, True], under={1: 0}, counts=counts)
    alone = materialize(counts.filter("_n0 = 0 and _n1 > 0").select("order_id"), "alone")  # items of no order
    used = t.order_items.filter("order_id is not null").join(alone, "order_id", "left_anti")
    for name, key in LOOKUPS:
        named = (used if key in used.columns else t.orders).select(key).filter(f"{key} is not null").distinct()
        out = out.unionByName(getattr(t, name).join(named, key, "left_anti"), allowMissingColumns=True)
    return out


def bad_review_rows(t, threshold: int = 4) -> DataFrame:
    """C9's rows with review_score < threshold, joined from the filtered reviews: orders without
    such a review are dropped before any other join."""
    bad = t.reviews.filter(F.col("review_score") < threshold)
    orders = t.orders.join(bad.select("order_id").distinct(), "order_id", "left_semi")
    base, rows = order_rows(t, orders)
    return outer_join([bad, rows, t.payments], "order_id", [True, False, False], key_rows=[bad, base, t.payments])


# ------------------------------------------------------------------ G13


#: Weekday names, Monday first.
WEEKDAYS = ["Seg", "Ter", "Qua", "Qui", "Sex", "Sab", "Dom"]


def mean_by_year_weekday(df: DataFrame, ts: str = "order_purchase_timestamp", value: str = "price") -> DataFrame:
    """Mean price per (purchase year, weekday Monday=0), NULL keys dropped.

    ``weekday_name`` is the correct name (trap S16: the notebook labels from Sunday)."""
    d = (df.select(F.year(ts).alias("order_purchase_year"), F.weekday(ts).alias("order_purchase_dayofweek"),
                   value)
         .filter(F.col("order_purchase_year").isNotNull()))
    agg = d.groupBy("order_purchase_year", "order_purchase_dayofweek").agg(
        ratio(F.sum(value), F.count(value)).alias(value))
    return agg.withColumn("weekday_name", F.element_at(F.array(*[F.lit(n) for n in WEEKDAYS]),
                                                       F.col("order_purchase_dayofweek") + 1))


def with_date_parts(df: DataFrame, ts: str = "order_purchase_timestamp") -> DataFrame:
    """Year, zero-padded month string and weekday (Monday=0)."""
    return (df.withColumn("order_purchase_year", F.year(ts))
            .withColumn("order_purchase_month", F.lpad(F.month(ts).cast("string"), 2, "0"))
            .withColumn("order_purchase_dayofweek", F.weekday(ts)))


def parse_timestamp(c: Column) -> Column:
    """``to_datetime(errors='coerce')`` -- unparsable text becomes NULL; no time zone is involved."""
    return c.try_cast("timestamp_ntz")


def coerce_dates(df: DataFrame, cols) -> DataFrame:
    """H15 on text columns, in place."""
    return df.withColumns({c: parse_timestamp(F.col(c)) for c in cols})


# ------------------------------------------------------------------ G9, G10, G15

def exact(df: DataFrame, c: str) -> Column:
    """A column whose products and sums cannot overflow: integers become decimals."""
    kind = df.schema[c].dataType
    return F.col(c) if isinstance(kind, T.DecimalType) else F.col(c).cast("decimal(20,0)")


_EXACT = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.DecimalType)


def numeric_profile(df: DataFrame, cols) -> DataFrame:
    """G9 (numeric part of ``skim``): per column missing, complete rate, mean, sd,
    p0/p25/p50/p75/p100.  Columns must be integer or decimal (exact sums).

    Moments: one aggregate over the table with the exact sum of x and Spark's
    central-moment standard deviation per column.  Quantiles: the columns unpivoted into one long
    (column, value) table ranked per column -- values as doubles, which keeps
    their order and identity for decimals of up to 15 significant digits.
    """
    cols = list(cols)
    for c in cols:
        if not isinstance(df.schema[c].dataType, _EXACT):
            raise TypeError(f"{c}: numeric_profile needs integer/decimal columns")
    aggs = [F.count(F.lit(1)).alias("_rows")]
    for i, c in enumerate(cols):
        aggs += [F.count(c).alias(f"_n{i}"), F.sum(exact(df, c)).alias(f"_s{i}"),
                 F.stddev_samp(F.col(c).cast("double")).alias(f"_d{i}")]
    wide = df.agg(*aggs)
    rows = []
    for i, c in enumerate(cols):
        n = F.col(f"_n{i}").cast("double")
        rows.append(F.struct(
            F.lit(c).alias("column_name"), (F.col("_rows") - F.col(f"_n{i}")).alias("n_missing"),
            ratio(f"_n{i}", "_rows").alias("complete_rate"), F.try_divide(F.col(f"_s{i}").cast("double"), n).alias("mean"),
            F.col(f"_d{i}").alias("sd")))
    m = wide.select(F.explode(F.array(*rows)).alias("_m")).select("_m.*")
    long = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(c).cast("double").alias("v")) for c in cols])).alias("_s")
    ).select("_s.column_name", "_s.v")
    q = exact_quantiles(long, "v", [0.0, 0.25, 0.5, 0.75, 1.0], ["column_name"],
                        names=["p0", "p25", "p50", "p75", "p100"])
    return m.join(q, "column_name", "left").select("column_name", "n_missing", "complete_rate", "mean", "sd",
                                                   "p0", "p25", "p50", "p75", "p100")


def character_profile(df: DataFrame, cols) -> DataFrame:
    """G9 (character part of ``skim``): per column missing, complete rate, min/max
    length, empty strings, whitespace-only strings and distinct non-NULL values.

    One unpivot to (column, value) and one aggregate keyed by column; the
    distinct count is Spark's two-level distinct aggregate."""
    cols = list(cols)
    long = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("v")) for c in cols])).alias("_s")
    ).select("_s.column_name", "_s.v")
    n = F.count(F.lit(1))
    return long.groupBy("column_name").agg(
        (n - F.count("v")).alias("n_missing"), ratio(F.count("v"), n).alias("complete_rate"),
        F.min(F.length("v")).alias("min_length"), F.max(F.length("v")).alias("max_length"),
        F.sum((F.col("v") == "").cast("int")).alias("empty"),
        F.sum(F.col("v").rlike(r"^\s+$").cast("int")).alias("whitespace"),
        F.countDistinct("v").alias("n_unique"))


def timestamp_profile(df: DataFrame, cols) -> DataFrame:
    """G9 (date-time part of ``skim``): per column missing, min, max, median
    (exact, lower-middle interpolation on microseconds) and distinct values."""
    cols = list(cols)
    long = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column_name"), ntz_to_micros(F.col(c).cast("timestamp_ntz")).alias("us"))
        for c in cols])).alias("_s")).select("_s.column_name", "_s.us")
    m = long.groupBy("column_name").agg(
        F.sum(F.col("us").isNull().cast("int")).alias("n_missing"), F.min("us").alias("_min"),
        F.max("us").alias("_max"), F.countDistinct("us").alias("n_unique"))
    med = exact_quantiles(long.filter(F.col("us").isNotNull()), "us", [0.5], ["column_name"], names=["_med"])
    return (m.join(med, "column_name", "left")
            .select("column_name", "n_missing",
                    micros_to_ntz(F.col("_min")).alias("min"), micros_to_ntz(F.col("_max")).alias("max"),
                    micros_to_ntz(F.floor("_med")).alias("median"),
                    "n_unique"))


def frequencies(df: DataFrame, cols=None) -> DataFrame:
    """G10 ``exploreFrequencies``: distinct non-NULL values and NULL count per column."""
    cols = list(cols or df.columns)
    long = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("v")) for c in cols])).alias("_s")
    ).select("_s.column_name", "_s.v")
    return long.groupBy("column_name").agg(F.countDistinct("v").alias("unique_values"),
                                      F.sum(F.col("v").isNull().cast("int")).alias("missing"))


def sketched_frequencies(df: DataFrame, cols=None, rsd: float = 0.02) -> DataFrame:
    """G10 by one mergeable sketch per column: one pass, and no value is shuffled.

    ``unique_values`` is an estimate with relative standard deviation ``rsd`` (it lies within 3 ``rsd``
    of the exact number nearly always); ``missing`` is exact."""
    cols = list(cols or df.columns)
    aggs = [F.count(F.lit(1)).alias("_rows")]
    for i, c in enumerate(cols):
        aggs += [F.approx_count_distinct(F.col(c), rsd).alias(f"_u{i}"), F.count(c).alias(f"_n{i}")]
    rows = [F.struct(F.lit(c).alias("column_name"), F.col(f"_u{i}").alias("unique_values"),
                     (F.col("_rows") - F.col(f"_n{i}")).alias("missing")) for i, c in enumerate(cols)]
    return df.agg(*aggs).select(F.explode(F.array(*rows)).alias("_r")).select("_r.*")


def correlation_matrix(df: DataFrame, cols, digits: int = 2) -> DataFrame:
    """Pairwise Pearson correlation, each pair over rows where both are non-NULL
    (as pandas does); ``corr_rounded`` as the notebook prints it.

    Co-moments about each column's median (``moments``), reduced per NULL pattern: a bit mask of
    present columns, at most 2^k groups."""
    cols = list(cols)
    rows = moments.centred(df, cols).withColumn("_w", F.lit(1.0))
    sums = moments.pattern_moments(rows, range(len(cols)))
    return moments.correlations(sums, cols, digits)


def weighted_histogram(rows: DataFrame, x: str, w: str, bins: int, log10: bool = False) -> DataFrame:
    """G17 on weighted rows (a row standing for ``w`` identical rows): equal-width
    bins between min and max of the rows with positive weight; ``log10`` bins log10(x) of positive x.

    The weights are added up by value and written once; bounds and bins both come from that table."""
    v = rows.filter(F.col(x).isNotNull() & (F.col(w) > 0))
    if log10:
        v = v.filter(F.col(x) > 0)
    v = materialize(v.groupBy(x).agg(F.sum(w).alias("_w")), "weights")
    value = F.col(x).cast("double")
    v = v.select((F.log10(value) if log10 else value).alias("_x"), "_w")
    bounds = v.agg(F.struct(F.min("_x").alias("lo"), F.max("_x").alias("hi"))).scalar()
    lo, hi = bounds.getField("lo"), bounds.getField("hi")
    width = (F.col("_hi") - F.col("_lo")) / F.lit(float(bins))
    b = F.when(width > 0, F.least(F.floor((F.col("_x") - F.col("_lo")) / width), F.lit(bins - 1))).otherwise(0)
    return (v.withColumn("_lo", lo).withColumn("_hi", hi).withColumn("bin", b.cast("int"))
            .groupBy("bin", "_lo", "_hi").agg(F.sum("_w").cast("bigint").alias("count"))
            .withColumn("bin_lo", F.col("_lo") + F.col("bin") * (F.col("_hi") - F.col("_lo")) / bins)
            .withColumn("bin_hi", F.col("_lo") + (F.col("bin") + 1) * (F.col("_hi") - F.col("_lo")) / bins)
            .select("bin", "bin_lo", "bin_hi", "count"))
