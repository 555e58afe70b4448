"""Factorized full-outer metrics equal the same metrics over the materialised m:m table."""

from __future__ import annotations

from dataclasses import replace
from decimal import Decimal

from pyspark.sql import functions as F

from helpers import D, tables
from vitrine import catalog
from vitrine.plans import outer, profile


def _fixture(spark):
    t0, t1 = D(2018, 3, 5, 10), D(2019, 7, 6, 11)
    return tables(
        spark,
        orders=[(1, 10, "delivered", t0), (2, 11, "shipped", t1), (3, 10, "delivered", None), (4, 12, "canceled", t1)],
        items=[(1, 1, 100, 7, t0, 10.0, 1.0), (1, 2, 101, 8, t0, 20.5, 2.0), (1, 3, 100, 7, t0, 30.0, 3.0),
               (2, 1, 102, 8, t1, 5.0, 0.5), (3, 1, 999, 7, t0, 7.0, 1.0),
               (77, 1, 100, 7, t0, 1.0, 1.0)],                      # item of an unknown order: dropped
        payments=[(1, "credit_card", 15.0), (1, "boleto", 16.0), (1, "voucher", None), (1, "credit_card", 3.0),
                  (2, "boleto", 5.5), (5, "debit_card", 9.0)],       # order 5 has no order row
        reviews=[(1, 1, 5, t0, t0), (2, 1, None, t0, t0), (3, 2, 2, t1, t1), (4, 6, 4, t1, t1)],
        products=[(100, "a", 1, 100), (101, None, None, 200), (102, "b", 3, None), (103, "c", 2, 50)],
        customers=[(10, "SP"), (11, "RJ"), (13, "MG")], sellers=[(7, "SP"), (8, "PR"), (9, "BA")],
        states=[("SP", "sp", "SE")], state_map=[("SP", "x")],
    )


def _c9(t):
    return profile.full_outer_wide(t)


def test_value_counts_match_materialised(spark):
    t = _fixture(spark)
    c9 = _c9(t)
    for fac, col in ((outer.payment_type_counts(t), "payment_type"), (outer.review_score_counts(t), "review_score")):
        got = {r[col]: r["count"] for r in fac.collect()}
        exp = {r[col]: r["count"] for r in profile.value_counts(c9, col).collect()}
        assert got == exp


def test_weighted_mean_matches_materialised(spark):
    t = _fixture(spark)
    got = {(r.order_purchase_year, r.order_purchase_dayofweek): r.price
           for r in outer.mean_price_by_year_weekday(t).collect()}
    exp = {(r.order_purchase_year, r.order_purchase_dayofweek): r.price
           for r in profile.mean_by_year_weekday(_c9(t)).collect()}
    assert got == exp


def test_correlation_matches_materialised(spark):
    t = _fixture(spark)
    a = ["order_item_id", "price", "freight_value", "product_photos_qty", "product_description_lenght"]
    got = {(r.col_a, r.col_b): r.corr for r in outer.correlation_matrix(t, a, ["payment_value"],
                                                                          ["review_score"]).collect()}
    exp = {(r.col_a, r.col_b): r.corr
           for r in profile.correlation_matrix(_c9(t), a + ["payment_value", "review_score"]).collect()}
    assert got.keys() == exp.keys()
    for k in got:
        assert (got[k] is None and exp[k] is None) or abs(got[k] - exp[k]) < 1e-12, k


def test_complete_row_histogram_matches_materialised(spark):
    t = _fixture(spark)
    c9 = _c9(t)
    cols = c9.columns
    got = {r.bin: (r.bin_lo, r.bin_hi, r["count"]) for r in outer.complete_price_histogram(t, 4, cols).collect()}
    complete = c9.na.drop("any")
    exp = {r.bin: (r.bin_lo, r.bin_hi, r["count"]) for r in
           profile.weighted_histogram(complete.select(F.col("price").cast("double").alias("x"),
                                                      F.lit(1).alias("w")), "x", "w", 4).collect()}
    assert got == exp


def test_counts_with_repeated_products_and_null_keys(spark):
    t = _fixture(spark)
    more = {"products": [(100, "again", 1, 1)], "orders": [(None, 10, "shipped", None), (2, 11, "shipped", None)],
            "order_items": [(None, 1, 100, 7, None, 1, 1), (78, 1, 100, 7, None, 1, 1)], "reviews": [(9, 78, 1, None, None)]}
    t = replace(t, **{n: getattr(t, n).unionByName(spark.createDataFrame(rows, getattr(t, n).schema)) for n, rows in {
        k: [tuple(Decimal(x) if f.dataType.typeName() == "decimal" and x is not None else x for x, f in zip(r, getattr(t, k).schema))
            for r in v] for k, v in more.items()}.items()})
    c9 = (t.orders.join(t.order_items, "order_id", "left").join(t.products, "product_id", "left")
          .join(t.payments, "order_id", "full_outer").join(t.reviews, "order_id", "full_outer"))
    for fac, col in ((outer.payment_type_counts(t), "payment_type"), (outer.review_score_counts(t), "review_score")):
        assert ({r[col]: r["count"] for r in fac.collect()}
                == {r[col]: r["count"] for r in c9.filter(f"{col} is not null").groupBy(col).count().collect()})
    wide = _c9(t)
    assert wide.filter("order_id is not null").count() == c9.filter("order_id is not null").count()


def test_side_counts_join_no_sides(spark):
    plan = outer.side_counts(_fixture(spark))._jdf.queryExecution().optimizedPlan().toString()
    assert "FullOuter" not in plan and plan.count("Join") == 1  # the products that repeat


def test_item_rows_meet_their_orders_sums_once(spark, monkeypatch):
    written = {}
    real = outer.materialize
    monkeypatch.setattr(outer, "materialize", lambda df, name="t": written.setdefault(name, real(df, name)))
    outer.correlation_matrix(_fixture(spark), ["price", "product_photos_qty"], ["payment_value"], ["review_score"])
    assert set(written) == {"beside", "items", "moments"}
    assert set(written["items"].columns) >= {"price", "product_photos_qty", "_many1", "_many2"}
    assert "order_status" not in written["items"].columns and len(written["moments"].columns) == 10


def test_c9_is_not_written_before_it_is_returned(spark):
    assert any("lineitem" in f for f in catalog.c9(spark, "/root/testdata/sf0.001").inputFiles())
