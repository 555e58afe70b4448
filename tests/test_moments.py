"""Correlations from co-moments: no overflow, no cancellation, NULLs pair by pair."""

import datetime as dt
import random

import numpy as np
import pytest

from helpers import tables
from vitrine.plans import moments, outer, profile


def test_against_numpy_with_nulls_and_large_offsets(spark):
    rnd = random.Random(2)
    rows = [(rnd.choice([None, 1e9 + rnd.random()]), rnd.choice([None, rnd.gauss(0, 1)]), 5.0) for _ in range(500)]
    got = {(r.col_a, r.col_b): r.corr for r in profile.correlation_matrix(
        spark.createDataFrame(rows, "a double, b double, c double"), ["a", "b", "c"]).collect()}
    both = np.array([(a, b) for a, b, _ in rows if a is not None and b is not None])
    want = np.corrcoef(both[:, 0] - 1e9, both[:, 1])[0, 1]
    assert got["a", "b"] == pytest.approx(want, abs=1e-9) and got["a", "a"] == 1.0
    assert got["a", "c"] is None and got["c", "c"] is None


def test_ten_to_the_thirteen_rows_of_ten_to_the_five(spark):
    """An order of 10^2 items, 10^5 payments and 10^6 reviews stands for 10^13 rows."""
    rows = spark.createDataFrame([(100000.0 + k % 7, float(k % 7) + (k % 2), 1e13 / 50) for k in range(50)],
                                 "x double, y double, _w double")
    sums = moments.pattern_moments(moments.centred(rows, ["x", "y"]), [0, 1])
    got = {(r.col_a, r.col_b): r.corr for r in moments.correlations(sums, ["x", "y"]).collect()}
    x, y = np.array([k % 7 for k in range(50)]), np.array([k % 7 + k % 2 for k in range(50)])
    assert got["x", "y"] == pytest.approx(np.corrcoef(x, y)[0, 1], abs=1e-12) and got["x", "x"] == 1.0


def test_orders_that_stand_for_many_rows(spark):
    t0 = dt.datetime(2020, 1, 1)
    t = tables(spark, orders=[(1, 1, "delivered", t0), (2, 1, "delivered", t0)],
               items=[(o, i, i, 1, t0, 100000.0 + i, float(i % 3)) for o in (1, 2) for i in range(40)],
               payments=[(o, "boleto", 100000.0 + (i * o) % 11) for o in (1, 2) for i in range(300)],
               reviews=[(k, 1 + k % 2, 1 + k % 5, t0, t0) for k in range(200)])
    a, b, c = ["price", "freight_value"], ["payment_value"], ["review_score"]
    got = {(r.col_a, r.col_b): r.corr for r in outer.correlation_matrix(t, a, b, c).collect()}
    want = {(r.col_a, r.col_b): r.corr for r in profile.correlation_matrix(profile.full_outer_wide(t), a + b + c).collect()}
    assert got.keys() == want.keys()
    for pair, r in want.items():
        assert got[pair] == pytest.approx(r, abs=1e-12), pair


def test_null_order_keys_stand_alone(spark):
    t0 = dt.datetime(2020, 1, 1)
    t = tables(spark, orders=[(1, 1, "delivered", t0)], items=[(1, 1, 1, 1, t0, 3.0, 1.0), (1, 2, 1, 1, t0, 4.0, 1.5)],
               payments=[(1, "boleto", 5.0), (None, "boleto", 7.0), (None, "boleto", 9.0)],
               reviews=[(1, 1, 5, t0, t0), (2, None, 1, t0, t0), (3, None, 2, t0, t0)], products=[(1, "a", 1, 10)])
    args = ["price", "freight_value"], ["payment_value"], ["review_score"]
    got = {(r.col_a, r.col_b): r.corr for r in outer.correlation_matrix(t, *args).collect()}
    want = {(r.col_a, r.col_b): r.corr for r in profile.correlation_matrix(
        profile.full_outer_wide(t), [c for cols in args for c in cols]).collect()}
    assert got == pytest.approx(want)
