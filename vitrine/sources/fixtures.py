"""Canonical marketplace tables derived from the driver's parquet tables.

The driver ships TPC-H-like tables; FIXTURES.md §2 maps them onto the
marketplace schema (orders, order_items, payments, reviews, products,
customers, sellers, states, state_map, bad-review messages).  Each function
here is that mapping written with the DataFrame API: it reads only the columns
it needs (the parquet scan gets the pruned ReadSchema) and stays lazy.
Derived columns are synthetic stand-ins.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


# Money is exact: decimal(18,2) sums are deterministic under any partitioning
# (double sums change with shuffle order) and identical in every engine.
MONEY = "decimal(18,2)"


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _read(spark, sf_dir, "orders")
    status = (F.when(F.col("o_orderstatus") == "F", "delivered")
              .when(F.col("o_orderstatus") == "O", "shipped")
              .otherwise("canceled"))
    return o.select(
        F.col("o_orderkey").alias("order_id"),
        F.col("o_custkey").alias("customer_id"),
        status.alias("order_status"),
        F.col("o_orderdate").alias("order_purchase_timestamp"),
    )


#: The five times of an order (the first is the purchase), which the source files hold as text.
ORDER_TIMES = ["order_purchase_timestamp", "order_approved_at", "order_delivered_carrier_date",
               "order_delivered_customer_date", "order_estimated_delivery_date"]


def orders_with_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with all five times as text, some of them bad, as a CSV scan without types reads them."""
    o = _read(spark, sf_dir, "orders")
    key, day = F.col("o_orderkey"), F.to_date("o_orderdate")

    def text(days: Column, clock: str = "") -> Column:
        return F.concat(F.date_add(day, days.cast("int")).cast("string"), F.lit(clock))

    return orders(spark, sf_dir).drop("order_purchase_timestamp").join(o.select(
        key.alias("order_id"),
        text(F.lit(0), " 00:00:00").alias("order_purchase_timestamp"),
        F.when(key % 17 == 0, F.lit("bad")).otherwise(text(key % 3, " 10:30:00")).alias("order_approved_at"),
        F.when(key % 19 == 0, F.lit("2020-13-45 00:00:00")).otherwise(text(1 + key % 4, " 08:00:00"))
        .alias("order_delivered_carrier_date"),
        F.when(key % 23 == 0, F.lit("")).when(key % 29 != 0, text(4 + key % 10, " 17:45:10"))
        .alias("order_delivered_customer_date"),
        text(10 + key % 5).alias("order_estimated_delivery_date")), "order_id")


def order_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = _read(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_orderkey").alias("order_id"),
        F.col("l_linenumber").alias("order_item_id"),
        F.col("l_partkey").alias("product_id"),
        F.col("l_suppkey").alias("seller_id"),
        F.col("l_shipdate").alias("shipping_limit_date"),
        F.col("l_extendedprice").cast(MONEY).alias("price"),
        F.col("l_quantity").cast(MONEY).alias("freight_value"),
    )


def payments(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = _read(spark, sf_dir, "events")
    # modulus = 20% of the order count: an uncorrelated scalar subquery
    modulus = (_read(spark, sf_dir, "orders").agg(F.count(F.lit(1)).alias("_n"))
               .select((F.col("_n") * F.lit(0.2)).cast("bigint")).scalar())
    ptype = (F.when(F.col("event_type") == "click", "credit_card")
             .when(F.col("event_type") == "view", "boleto")
             .when(F.col("event_type") == "purchase", "voucher")
             .when(F.col("event_type") == "signup", "debit_card")
             .otherwise("not_defined"))
    return (ev.select("event_id", "event_type", "value")
            .select(((F.col("event_id") * F.lit(104729)) % modulus).alias("order_id"),
                    ptype.alias("payment_type"),
                    F.col("value").cast(MONEY).alias("payment_value")))


def _day_plus(ts: Column, days: Column) -> Column:
    # date_trunc('day', ts) + n days, kept as a zone-less timestamp
    return F.date_add(F.to_date(ts), days).cast("timestamp_ntz")


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = _read(spark, sf_dir, "events")
    eid = F.col("event_id")
    score = F.when(eid % 23 == 0, F.lit(None).cast("int")).otherwise(
        F.lit(1) + F.floor(F.col("value")).cast("int") % 5)
    return ev.select(
        eid.alias("review_id"),
        F.floor(eid.cast("double") * F.lit(0.4)).cast("bigint").alias("order_id"),
        score.alias("review_score"),
        _day_plus(F.col("ts"), F.floor((eid % 7) / F.lit(3.0)).cast("int")).alias("review_creation_date"),
        _day_plus(F.col("ts"), (F.lit(3) + F.floor((eid % 4) / F.lit(2.0))).cast("int"))
        .alias("review_answer_timestamp"),
    )


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _read(spark, sf_dir, "part")
    pk = F.col("p_partkey")
    return p.select(
        pk.alias("product_id"),
        F.when(F.col("p_type") != "STANDARD", F.col("p_type")).alias("product_category_name"),
        F.when(F.col("p_size") % 8 != 0, F.col("p_size") % 8).alias("product_photos_qty"),
        F.when(pk % 50 == 0, F.lit(None).cast("bigint"))
        .otherwise(F.lit(100) + (pk * 37) % 3000).alias("product_description_lenght"),
    )


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    n = _read(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    return (c.join(n, c.c_nationkey == n.n_nationkey)
            .select(F.col("c_custkey").alias("customer_id"), F.col("n_name").alias("customer_state")))


def sellers(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _read(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    n = _read(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    return (s.join(n, s.s_nationkey == n.n_nationkey)
            .select(F.col("s_suppkey").alias("seller_id"), F.col("n_name").alias("seller_state")))


def states(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _read(spark, sf_dir, "nation")
    r = _read(spark, sf_dir, "region")
    return (n.join(r, n.n_regionkey == r.r_regionkey)
            .select(F.col("n_name").alias("Sigla"), F.lower("n_name").alias("Estado"),
                    F.col("r_name").alias("Region")))


def state_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _read(spark, sf_dir, "nation")
    return n.select(F.col("n_name").alias("nome"),
                    F.concat(F.lit("POINT("), F.col("n_nationkey").cast("string"), F.lit(" 0)"))
                    .alias("geometry"))


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as the message of the review of its id."""
    return _read(spark, sf_dir, "documents").select(F.col("doc_id").alias("review_id"),
                                                    F.col("text").alias("review_comment_message"))


# The what-if scenario table of FIXTURES.md §2
# (scenario_id, fotos, caracteres, frete).
SCENARIOS = [(1, 3, 1000, 2.5), (2, 1, 100, 10.0), (3, 6, 500, 10.0), (4, 7, 3099, 1.0), (5, None, 700, 1.0)]


def scenarios(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        SCENARIOS, "scenario_id int, fotos int, caracteres int, frete double")


def scenarios_from_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scenario for every part: photos and characters with NULLs, many equal characters."""
    part, key = _read(spark, sf_dir, "part"), F.col("p_partkey")
    return part.select(
        key.cast("bigint").alias("scenario_id"),
        F.when(F.col("p_size") % 9 != 0, F.col("p_size") % 9).cast("int").alias("fotos"),
        F.when(key % 40 != 0, (key * 53) % 4000).cast("int").alias("caracteres"),
        (F.lit(1.0) + (key % 20).cast("double") * F.lit(0.5)).alias("frete"))


def category_translation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A translated name for every category but one."""
    names = products(spark, sf_dir).select("product_category_name").filter(
        F.col("product_category_name").isNotNull() & (F.col("product_category_name") != "PROMO")).distinct()
    return names.withColumn("product_category_name_english", F.lower("product_category_name"))


@dataclass(frozen=True)
class Tables:
    """The canonical tables, lazily bound to one driver folder."""

    orders: DataFrame
    order_items: DataFrame
    payments: DataFrame
    reviews: DataFrame
    products: DataFrame
    customers: DataFrame
    sellers: DataFrame
    states: DataFrame
    state_map: DataFrame


def load(spark: SparkSession, sf_dir: str) -> Tables:
    return Tables(
        orders=orders(spark, sf_dir), order_items=order_items(spark, sf_dir),
        payments=payments(spark, sf_dir), reviews=reviews(spark, sf_dir),
        products=products(spark, sf_dir), customers=customers(spark, sf_dir),
        sellers=sellers(spark, sf_dir), states=states(spark, sf_dir),
        state_map=state_map(spark, sf_dir),
    )
