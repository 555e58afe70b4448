"""The item-level wide table (C1-C12) and its building blocks.

Grain: one row per order item x surviving latest-review row.  Orders, items,
reviews and payments all join on ``order_id``; written as equi-joins so the
planner can reuse one hash partitioning of order_id across them.  Products and
customers join on their own keys; their join strategy (broadcast or shuffle)
is left to AQE, which broadcasts only when the runtime size is below the
configured threshold.  Only the states table (one row per state, a fixed
domain) carries an explicit broadcast hint.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.functions.aggregates import strict_max
from vitrine.sources.fixtures import Tables

# The payment methods that become columns, in display order.
PAYMENT_TYPES = ["credit_card", "boleto", "voucher", "debit_card"]
NOT_DEFINED = "not_defined"


def latest_reviews(reviews: DataFrame, mode: str = "both_max", strict_na: bool = False) -> DataFrame:
    """Keep the reviews of each order at the latest creation date AND latest answer time.

    ``both_max`` (reference): both maxima are taken over the whole order, so
    ties all survive and an order whose latest creation and latest answer sit
    on different rows keeps no review at all.  ``one_row`` keeps exactly one
    row per order (latest creation, then latest answer, then highest id).

    Written as a partial aggregate joined back on ``order_id`` alone (then a
    filter) rather than a window: one hot order is never sorted inside one task
    (AQE splits a skewed join partition), and the result stays hash-partitioned
    on order_id, so the joins to items and payments need no further shuffle.
    """
    if mode == "both_max":
        agg = strict_max if strict_na else F.max
        maxima = reviews.groupBy("order_id").agg(
            agg("review_creation_date").alias("_max_created"),
            agg("review_answer_timestamp").alias("_max_answered"))
        # x >= max(x) is x == max(x); written as >= so the optimizer does not turn
        # it into extra equi-join keys (which would re-hash on the dates)
        return (reviews.join(maxima, "order_id")
                .filter((F.col("review_creation_date") >= F.col("_max_created"))
                        & (F.col("review_answer_timestamp") >= F.col("_max_answered")))
                .drop("_max_created", "_max_answered"))
    if mode == "one_row":
        best = reviews.groupBy("order_id").agg(
            F.max(F.struct("review_creation_date", "review_answer_timestamp", "review_id"))
            .alias("_best"))
        return reviews.join(
            best.select("order_id", F.col("_best.review_id").alias("review_id")),
            ["order_id", "review_id"], "left_semi")
    raise ValueError(f"unknown review mode {mode!r}")


def payments_per_type(payments: DataFrame) -> DataFrame:
    """Sum of payment_value per (order, type), ``not_defined`` dropped (filter first)."""
    return (payments.filter(F.col("payment_type") != NOT_DEFINED)
            .groupBy("order_id", "payment_type")
            .agg(F.sum("payment_value").alias("value_to_pay")))


def payments_wide(payments: DataFrame) -> DataFrame:
    """G3 + G4: one row per order, one column per method, plus the row total.

    Written as conditional sums over a fixed value list: one aggregate keyed on
    order_id only (``pivot`` would first shuffle on (order_id, type) and then
    again on order_id).  Sums are exact decimals, so summing per (order, type)
    first, as the reference does, gives the same values.
    """
    wide = (payments.filter(F.col("payment_type") != NOT_DEFINED)
            .groupBy("order_id")
            .agg(*[F.sum(F.when(F.col("payment_type") == t, F.col("payment_value"))).alias(t)
                   for t in PAYMENT_TYPES]))
    zero = F.lit(0).cast("decimal(18,2)")
    total = F.coalesce(F.col(PAYMENT_TYPES[0]), zero)
    for t in PAYMENT_TYPES[1:]:
        total = total + F.coalesce(F.col(t), zero)
    return wide.withColumn("total_payment_value", total)


def orders_items(orders: DataFrame, items: DataFrame, statuses=("delivered",)) -> DataFrame:
    """C1 + B1 + B3: orders with their items (orders without items vanish)."""
    df = (orders.join(items, "order_id", "left")
          .filter(F.col("product_id").isNotNull())
          .withColumn("total_price", F.col("price") + F.col("freight_value")))
    if statuses is not None:
        df = df.filter(F.col("order_status").isin(*statuses))
    return df


def items_wide(t: Tables, statuses=("delivered",), review_mode: str = "both_max",
               with_customers: bool = True) -> DataFrame:
    """Orders -> items -> latest reviews -> payments -> products -> customers -> states."""
    df = orders_items(t.orders, t.order_items, statuses)
    df = (df.join(latest_reviews(t.reviews, review_mode), "order_id", "left")
          .filter(F.col("review_score").isNotNull()))
    df = df.join(payments_wide(t.payments), "order_id", "left")
    df = df.join(t.products, "product_id", "left")
    if with_customers:
        df = df.join(t.customers, "customer_id", "left")
        df = df.join(F.broadcast(t.states), df.customer_state == t.states.Sigla, "left").drop("Sigla")
    return df


WIDE_COLUMNS = [
    "order_id", "customer_id", "order_status", "order_purchase_timestamp", "order_item_id",
    "product_id", "seller_id", "shipping_limit_date", "price", "freight_value", "total_price",
    "review_id", "review_score", "review_creation_date", "review_answer_timestamp",
    *PAYMENT_TYPES, "total_payment_value", "product_category_name", "product_photos_qty",
    "product_description_lenght", "customer_state", "Estado", "Region",
]
