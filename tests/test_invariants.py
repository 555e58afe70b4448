"""SURVEY §5 (c) invariants on the driver tables (sf0.001)."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from vitrine import catalog
from vitrine.plans import category, geo, listing, price

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver test data not present")


def test_shares_sum_to_one_and_classes_add_up(spark):
    sel = catalog.selected(spark, SF, catalog.SCRIPT)
    m1 = category.category_class_summary(sel)
    for r in m1.groupBy("product_category_name").agg(F.sum("percent_notas").alias("s"),
                                                      F.sum("percent_sales").alias("g")).collect():
        assert abs(r.s - 1) < 1e-12 and abs(r.g - 1) < 1e-12
    assert m1.agg(F.sum("number_products")).first()[0] == sel.count()


def test_cell_table_one_pass_equals_two_level(spark):
    sol = listing.with_listing_cells(catalog.focus(spark, SF, catalog.SCRIPT))
    one = {(r.bucket_photos, r.quantil_desc): r for r in listing.cell_table(sol).collect()}
    # the reference's form: per (cell, class) first, then per cell with a 0/1 multiplier
    per_class = (sol.groupBy("bucket_photos", "quantil_desc", "review_simple")
                 .agg(F.sum("total_price").alias("g"), F.count(F.lit(1)).alias("n"))
                 .withColumn("m", F.when(F.col("review_simple") == "alta", 1).otherwise(0)))
    two = (per_class.groupBy("bucket_photos", "quantil_desc")
           .agg(F.sum("g").alias("g"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("m")).alias("nm"),
                F.sum(F.col("g") * F.col("m")).alias("gm")).collect())
    assert len(two) == len(one)
    for r in two:
        o = one[(r.bucket_photos, r.quantil_desc)]
        assert o.total_number_products == r.n and o.gross_sales1 == r.g
        assert o.prop_quantity == r.nm / r.n
        assert o.prop_sales == float(r.gm) / float(r.g)


def test_quartile_counts_are_balanced(spark):
    foc = catalog.focus(spark, SF, catalog.SCRIPT)
    m17 = price.quartile_class(foc)
    counts = [r.n for r in m17.groupBy("score").agg(F.sum("n_orders").alias("n")).collect()]
    assert len(counts) == 4 and max(counts) - min(counts) <= 1 and sum(counts) == foc.count()


def test_state_map_has_every_state(spark):
    from vitrine.sources import fixtures

    m13 = geo.state_map_metrics(fixtures.state_map(spark, SF),
                                geo.state_metrics(catalog.focus(spark, SF, catalog.SCRIPT)))
    assert m13.count() == fixtures.state_map(spark, SF).count()
