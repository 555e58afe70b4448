"""Tiny hand-made canonical tables for trap tests."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

from vitrine.sources.fixtures import Tables

D = dt.datetime


def money(x):
    return None if x is None else Decimal(str(x)).quantize(Decimal("0.01"))


def tables(spark, orders=(), items=(), reviews=(), payments=(), products=(), customers=(), states=(),
           state_map=(), sellers=()):
    return Tables(
        orders=spark.createDataFrame(
            list(orders), "order_id bigint, customer_id bigint, order_status string, "
                          "order_purchase_timestamp timestamp_ntz"),
        order_items=spark.createDataFrame(
            [(o, i, p, s, t, money(pr), money(fr)) for (o, i, p, s, t, pr, fr) in items],
            "order_id bigint, order_item_id int, product_id bigint, seller_id bigint, "
            "shipping_limit_date timestamp_ntz, price decimal(18,2), freight_value decimal(18,2)"),
        reviews=spark.createDataFrame(
            list(reviews), "review_id bigint, order_id bigint, review_score int, "
                           "review_creation_date timestamp_ntz, review_answer_timestamp timestamp_ntz"),
        payments=spark.createDataFrame(
            [(o, t, money(v)) for (o, t, v) in payments], "order_id bigint, payment_type string, "
                                                           "payment_value decimal(18,2)"),
        products=spark.createDataFrame(
            list(products), "product_id bigint, product_category_name string, product_photos_qty int, "
                            "product_description_lenght bigint"),
        customers=spark.createDataFrame(list(customers), "customer_id bigint, customer_state string"),
        sellers=spark.createDataFrame(list(sellers), "seller_id bigint, seller_state string"),
        states=spark.createDataFrame(list(states), "Sigla string, Estado string, Region string"),
        state_map=spark.createDataFrame(list(state_map), "nome string, geometry string"),
    )


def one_order(spark, reviews, n_items=1, payments=(), category="cat", photos=1, length=100):
    """One delivered order with ``n_items`` items and the given review rows."""
    t0 = D(2020, 1, 1)
    return tables(
        spark,
        orders=[(1, 10, "delivered", t0)],
        items=[(1, i + 1, 100 + i, 7, t0, 10.0, 1.0) for i in range(n_items)],
        reviews=reviews, payments=payments,
        products=[(100 + i, category, photos, length) for i in range(n_items)],
        customers=[(10, "SP")], states=[("SP", "são paulo", "Southeast")],
        state_map=[("SÃO PAULO", "POLY"), ("RIO DE JANEIRO", "POLY2")],
    )
