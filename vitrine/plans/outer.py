"""Metrics of the notebook's full-outer table (C9) without building it.

C9 joins orders+items, payments and reviews many-to-many on ``order_id``: an
order with a items, b payments and c reviews yields a*b*c rows (a missing side
counts as one NULL row).  Materialising it emits every (item, payment, review)
combination of an order -- quadratic for a hot order.  The notebook's metrics
over C9 are sums over those rows, so they factorise per order:

* a payment row stands for (a * c) C9 rows, a review row for (a * b), an item
  row for (b * c): value counts and weighted means need only per-order side
  counts (``side_counts``, one row per order);
* a cross-side product sum such as sum(price * payment_value) over C9 is, per
  order, (sum of prices) * (sum of payments) * c.

Counts and means are exact integer/decimal sums, so they equal those of the
materialised table exactly (the oracle aggregates the real C9).  Products,
customers and sellers are m:1 lookups; the ones no order references add their
own rows to C9 and are added here too.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.operators.lineage import materialize
from vitrine.operators.share import ratio, share_of_total
from vitrine.plans import moments, profile

KEY = "order_id"


def item_side(t) -> DataFrame:
    """Orders with their items and the items' products (the order-side rows of C9)."""
    return t.orders.join(t.order_items.join(t.products, "product_id", "left"), KEY, "left")


def side_counts(t) -> DataFrame:
    """One row per order key, none for NULL, with the row count of each side (1 for a missing side)."""
    # a product that the lookup holds several times multiplies its items; written, as mostly there is none
    repeated = materialize(t.products.groupBy("product_id").agg(F.count(F.lit(1)).alias("_many")).filter("_many > 1"), "repeated")
    items = t.order_items.join(repeated, "product_id", "left").selectExpr(KEY, "coalesce(_many, 1L) as _rows")
    sides = [t.orders.selectExpr(KEY, "1L as _rows"), items, *[s.selectExpr(KEY, "1L as _rows") for s in (t.payments, t.reviews)]]
    # all sides in one aggregate: no sorts and no joins of sides hold a task's memory at once
    k = reduce(DataFrame.unionByName, [side.filter(f"{KEY} is not null").selectExpr(
        KEY, *[f"{'_rows' if i == j else '0L'} as _n{i}" for i in range(4)]) for j, side in enumerate(sides)])
    k = k.groupBy(KEY).agg(*[F.sum(f"_n{i}").alias(f"_n{i}") for i in range(4)]).filter("_n0 > 0 or _n2 > 0 or _n3 > 0")
    return k.selectExpr(KEY, "if(_n0 > 0, _n0 * greatest(_n1, 1L), 1L) as _na", "greatest(_n2, 1L) as _nb",
                        "greatest(_n3, 1L) as _nc")


def _weighted_counts(rows: DataFrame, col: str, weight) -> DataFrame:
    return (rows.filter(F.col(col).isNotNull()).groupBy(col).agg(F.sum(weight).cast("bigint").alias("count")))


def payment_type_counts(t, keys: DataFrame | None = None) -> DataFrame:
    """G11 over C9: rows per payment type = sum over payments of items x reviews of the order."""
    rows = t.payments.join(keys if keys is not None else side_counts(t), KEY)
    return _weighted_counts(rows, "payment_type", F.col("_na") * F.col("_nc"))


def review_score_counts(t, keys: DataFrame | None = None) -> DataFrame:
    """G11 over C9: rows per review score = sum over reviews of items x payments of the order."""
    rows = t.reviews.join(keys if keys is not None else side_counts(t), KEY)
    return _weighted_counts(rows, "review_score", F.col("_na") * F.col("_nb"))


def bad_review_messages(t, messages: DataFrame, keys: DataFrame | None = None, threshold: int = 4) -> DataFrame:
    """N1 input over C9: messages of reviews with score < threshold; ``weight`` is the number of C9 rows
    (items x payments of the order) that repeat one."""
    bad = t.reviews.filter(F.col("review_score") < threshold).select("review_id", KEY)
    return (bad.join(keys if keys is not None else side_counts(t), KEY).join(messages, "review_id")
            .select("review_comment_message", (F.col("_na") * F.col("_nb")).alias("weight")))


def with_percent(counts: DataFrame, col: str) -> DataFrame:
    """G14 label column: percent of all counted rows, sorted desc."""
    agg = share_of_total(counts, {"share": "count"}).withColumn("percent", F.col("share") * 100.0)
    return agg.drop("share").orderBy(F.desc("count"), F.asc(col))


def mean_price_by_year_weekday(t, ts: str = "order_purchase_timestamp", value: str = "price",
                               keys: DataFrame | None = None, items: DataFrame | None = None) -> DataFrame:
    """G13 over C9: each item row weighs (payments x reviews) of its order."""
    items = items if items is not None else item_side(t)
    rows = items.join(keys if keys is not None else side_counts(t), KEY).withColumn("_w", F.col("_nb") * F.col("_nc"))
    d = rows.select(F.year(ts).alias("order_purchase_year"), F.weekday(ts).alias("order_purchase_dayofweek"),
                    value, "_w").filter(F.col("order_purchase_year").isNotNull())
    agg = d.groupBy("order_purchase_year", "order_purchase_dayofweek").agg(
        ratio(F.sum(F.col(value) * F.col("_w")), F.sum(F.when(F.col(value).isNotNull(), F.col("_w"))))
        .alias(value))
    return agg.withColumn("weekday_name", F.element_at(F.array(*[F.lit(n) for n in profile.WEEKDAYS]),
                                                       F.col("order_purchase_dayofweek") + 1))


# ------------------------------------------------------------------ G15 correlation over C9

def order_moments(sides: dict[int, DataFrame], cols: list[list[int]]) -> DataFrame:
    """One row per order: the rows of each side ``n{j}``, and of each centred column ``_x{i}`` the
    count, sum and sum of squares -- all sides in one aggregate, so a hot order is added up before the shuffle."""
    every = [i for j in sides for i in cols[j]]
    parts = []
    for j, side in sides.items():
        parts.append(side.filter(F.col(KEY).isNotNull()).selectExpr(
            KEY, *[f"{int(k == j)}L as n{k}" for k in sides],
            *[f"_x{i}" if i in cols[j] else f"cast(null as double) as _x{i}" for i in every]))
    rows = reduce(DataFrame.unionByName, parts)
    return rows.groupBy(KEY).agg(
        *[F.sum(f"n{j}").alias(f"n{j}") for j in sides],
        *[F.expr(f"{call} as {name}{i}") for i in every
          for name, call in (("c", f"count(_x{i})"), ("s", f"sum(_x{i})"), ("q", f"sum(_x{i} * _x{i})"))])


def correlation_matrix(t, cols_a, cols_b, cols_c, digits: int = 2, items: DataFrame | None = None) -> DataFrame:
    """G15 over C9: pairwise Pearson correlations of item-side (``cols_a``),
    payment (``cols_b``) and review (``cols_c``) columns, each pair over the C9
    rows where both are present -- from per-order moments, never the rows.

    Columns are centred first (``moments``).  Pairs of one side weigh each row by the rows that the
    order's other sides put beside it; a pair across sides is, per order, a product of the sides'
    sums.  Everything is a double about a median, so weights of 10^13 rows and more do no harm.

    Payments and reviews are added up per order first; item rows take their order's sums along where they
    meet their order, so they need no shuffle after that one.
    """
    groups = [list(cols_a), list(cols_b), list(cols_c)]
    cols = [c for own in groups for c in own]
    index = {c: i for i, c in enumerate(cols)}
    own = [[index[c] for c in names] for names in groups]
    raw = {1: t.payments, 2: t.reviews}
    centres = {j: moments.centres(rows, groups[j], own[j][0]) if own[j] else {} for j, rows in raw.items()}
    sides = {j: rows.withColumns(centres[j]) if own[j] else rows for j, rows in raw.items()}
    # many: the rows that an order has on a side of the joined table, one where it has none
    beside = materialize(order_moments(sides, own).selectExpr(
        KEY, *[f"cast(greatest(n{j}, 1L) as double) as _many{j}" for j in raw],
        *[f"coalesce(cast({p}{i} as double), 0.0D) as _{p}{i}" for j in raw for i in own[j] for p in "csq"]), "beside")
    prod_cols = [c for c in cols_a if c in t.products.columns and c != "product_id"]
    item_rows = items if items is not None else item_side(t)
    needed = dict.fromkeys([KEY, *(["product_id"] if prod_cols else []), *cols_a])
    item_rows = materialize(item_rows.select(*needed).join(beside, KEY, "left"), "items")
    orders = beside.join(item_rows.filter(F.col(KEY).isNotNull()).groupBy(KEY).agg(F.count(F.lit(1)).alias("_n0")), KEY, "left")
    orders = materialize(orders.withColumn("_many0", F.expr("cast(coalesce(_n0, 1L) as double)")).drop("_n0"), "moments")
    if prod_cols:  # products no item references are C9 rows of their own, beside no order
        referenced = item_rows.filter(F.col("product_id").isNotNull()).select("product_id").distinct()
        alone = t.products.join(referenced, "product_id", "left_anti")
        item_rows = item_rows.unionByName(alone.select("product_id", *prod_cols), allowMissingColumns=True)
    sums = []
    if own[0]:
        nothing = [c for c in beside.columns if c != KEY]  # an order without payments and reviews
        rows = item_rows.withColumns(moments.centres(item_rows, groups[0], own[0][0])).withColumns(
            {c: F.coalesce(c, F.lit(float(c.startswith("_many")))) for c in nothing})
        sums.append(moments.pattern_moments(rows.withColumn("_w", F.expr("_many1 * _many2")), own[0]))
        across = []
        for i in own[0]:
            of_row = {"c": f"if(_x{i} is null, 0.0D, 1.0D)", "s": f"coalesce(_x{i}, 0.0D)", "q": f"coalesce(_x{i} * _x{i}, 0.0D)"}
            for j, other in ((1, 2), (2, 1)):
                across += [F.expr(f"sum(_many{other} * {of_row[x]} * _{y}{k}) as {part}_{i}_{k}") for k in own[j]
                           for part, x, y in zip(moments.PARTS, "cscqcs", "ccscqs")]
        sums += [rows.agg(*across)] if across else []
    across = [F.expr(f"sum(_many0 * _{x}{i} * _{y}{k}) as {part}_{i}_{k}") for i in own[1] for k in own[2]
              for part, x, y in zip(moments.PARTS, "cscqcs", "ccscqs")]
    sums += [orders.agg(*across)] if across else []
    for j in raw:
        weight = " * ".join(f"_many{k}" for k in range(3) if k != j)
        if len(own[j]) == 1:  # a column with itself
            i = own[j][0]
            alone = sides[j].filter(F.col(KEY).isNull()).selectExpr(f"count(_x{i}) as c", f"sum(_x{i}) as s", f"sum(_x{i} * _x{i}) as q")
            both = orders.selectExpr(*[f"{weight} * _{p}{i} as {p}" for p in "csq"]).unionByName(alone)
            sums.append(both.agg(*[F.expr(f"sum({x}) as {part}_{i}_{i}") for part, x in zip(moments.PARTS, "cssqqq")]))
        elif own[j]:
            rows = raw[j].select(KEY, *groups[j])  # shuffled as they are, centred after: doubles do not compress
            # a row without an order stands alone
            weighed = (rows.filter(F.col(KEY).isNotNull()).join(orders.selectExpr(KEY, f"{weight} as _w"), KEY)
                       .unionByName(rows.filter(F.col(KEY).isNull()).withColumn("_w", F.lit(1.0))).withColumns(centres[j]))
            sums.append(moments.pattern_moments(weighed, own[j]))
    one = sums[0]
    for more in sums[1:]:  # one row each
        one = one.withColumn("_more", more.select(F.struct(*more.columns)).scalar()).select(*one.columns, "_more.*")
    return moments.correlations(one, cols, digits)


# ------------------------------------------------------------------ G17 histogram over complete C9 rows

def complete_price_histogram(t, bins: int, c9_columns, log10: bool = False) -> DataFrame:
    """G17 over ``C9.dropna()``: price histogram of the rows with no NULL in any
    column: item rows complete on their own columns, weighted by the order's
    complete payments x complete reviews."""
    item_rows = (item_side(t).join(t.customers, "customer_id", "left").join(t.sellers, "seller_id", "left"))
    a_cols = [c for c in c9_columns if c in item_rows.columns]
    b_cols = [c for c in c9_columns if c in t.payments.columns and c != KEY]
    c_cols = [c for c in c9_columns if c in t.reviews.columns and c != KEY]

    def complete(cols):
        cond = F.lit(True)
        for c in cols:
            cond = cond & F.col(c).isNotNull()
        return cond

    nb = t.payments.filter(complete(b_cols)).groupBy(KEY).agg(F.count(F.lit(1)).alias("_nb"))
    nc = t.reviews.filter(complete(c_cols)).groupBy(KEY).agg(F.count(F.lit(1)).alias("_nc"))
    rows = (item_rows.filter(complete(a_cols)).join(nb, KEY).join(nc, KEY)
            .select("price", (F.col("_nb") * F.col("_nc")).alias("_weight")))
    return profile.weighted_histogram(rows, "price", "_weight", bins, log10)
