"""One test per semantic trap."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from helpers import D, one_order, tables
from vitrine.functions import classify, labels
from vitrine.operators import rank, share
from vitrine.operators import wide as W
from vitrine.params import Params
from vitrine.plans import category, geo, listing, payment, profile, text, whatif


def test_review_mismatch_keeps_no_row(spark):
    t = one_order(spark, [(1, 1, 5, D(2020, 1, 1), D(2020, 1, 9)), (2, 1, 4, D(2020, 1, 2), D(2020, 1, 5))])
    assert W.latest_reviews(t.reviews).count() == 0
    assert W.items_wide(t).count() == 0


def test_review_tie_doubles_items(spark):
    t = one_order(spark, [(1, 1, 5, D(2020, 1, 2), D(2020, 1, 5)), (2, 1, 4, D(2020, 1, 2), D(2020, 1, 5))],
                  n_items=2)
    assert W.latest_reviews(t.reviews).count() == 2
    assert W.items_wide(t).count() == 4
    assert W.latest_reviews(t.reviews, mode="one_row").count() == 1


def test_orders_without_items_or_review_vanish(spark):
    t0 = D(2020, 1, 1)
    t = tables(spark,
               orders=[(1, 10, "delivered", t0), (2, 10, "delivered", t0), (3, 10, "delivered", t0)],
               items=[(1, 1, 100, 7, t0, 10.0, 1.0), (3, 1, 100, 7, t0, 10.0, 1.0)],
               reviews=[(1, 1, 5, t0, t0), (2, 2, 5, t0, t0)],
               products=[(100, "cat", 1, 100)], customers=[(10, "SP")], states=[("SP", "sp", "SE")])
    got = [r.order_id for r in W.items_wide(t).collect()]
    assert got == [1]


def test_quartiles_n8_floor_formula(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(1, 9)], "id long, price double")
    out = rank.ntile_labels(df, "price", ["id"], ["primeiro", "segundo", "terceiro", "quarto"], "score")
    counts = {r.score: r["count"] for r in out.groupBy("score").count().collect()}
    assert counts == {"primeiro": 2, "segundo": 2, "terceiro": 2, "quarto": 2}


def test_null_length_gets_null_label_and_is_not_counted(spark):
    df = spark.createDataFrame([(1, None), (2, 1), (3, 2)], "id long, len long")
    out = {r.id: r.lab for r in rank.ntile_labels(df, "len", ["id"], ["a", "b"], "lab").collect()}
    assert out == {1: None, 2: "a", 3: "b"}


def test_top_n_keeps_ties(spark):
    df = spark.createDataFrame([("a", 5), ("b", 3), ("c", 3), ("d", 1)], "k string, v long")
    assert sorted(r.k for r in share.top_n_with_ties(df, "k", "v", 2).collect()) == ["a", "b", "c"]


def test_null_category_in_top(spark):
    df = spark.createDataFrame([(None, 9), ("a", 5), ("b", 3)], "k string, v long")
    assert sorted(r.k for r in share.top_n_with_ties(df, "k", "v", 2).collect()) == ["a", "b"]
    assert sorted(r.k for r in share.top_n_with_ties(df, "k", "v", 2, drop_null_first=False).collect()) == ["a"]


def test_payment_grain(spark):
    t = one_order(spark, [(1, 1, 5, D(2020, 1, 1), D(2020, 1, 2))], n_items=2,
                  payments=[(1, "credit_card", 10.0)])
    foc = classify.selected(W.items_wide(t), Params(new_category_name="cat"))
    item = payment.method_class(foc).collect()[0]
    order = payment.method_class(foc, grain="order").collect()[0]
    assert float(item.gross_sales) == 20.0 and float(order.gross_sales) == 10.0


def test_no_good_review_gives_zero_approval(spark):
    t = one_order(spark, [(1, 1, 1, D(2020, 1, 1), D(2020, 1, 2))])
    p = Params(good_scores=(4, 5), new_category_name="cat")
    kpi = category.focus_kpis(classify.focus(classify.selected(W.items_wide(t), p), p)).collect()[0]
    assert kpi.approval == 0.0 and kpi.number_products == 1


def test_negated_membership_null_is_true(spark):
    df = spark.createDataFrame([(None,), (1,), (7,)], "x int")
    got = [r.v for r in df.select(classify.not_in(F.col("x"), [1, 2]).alias("v")).collect()]
    assert got == [True, False, True]


def test_only_one_class_present(spark):
    t = one_order(spark, [(1, 1, 5, D(2020, 1, 1), D(2020, 1, 2))])
    sel = classify.selected(W.items_wide(t), Params())
    row = category.category_table(category.category_class_summary(sel), 3).collect()[0]
    assert row.alta == 1.0 and row.baixa is None


def test_state_without_orders_kept_on_map(spark):
    t = one_order(spark, [(1, 1, 5, D(2020, 1, 1), D(2020, 1, 2))])
    sel = classify.selected(W.items_wide(t), Params(new_category_name="cat"))
    m = {r.nome: r.n_orders for r in geo.state_map_metrics(t.state_map, geo.state_metrics(sel)).collect()}
    assert m == {"SÃO PAULO": 1, "RIO DE JANEIRO": None}


def test_scenario_in_empty_cell_and_zero_share(spark):
    # cell (1 photo, all lengths) has share 0: uplift must be NULL, no error
    t = one_order(spark, [(1, 1, 1, D(2020, 1, 1), D(2020, 1, 2))], n_items=3)
    p = Params(good_scores=(4, 5), new_category_name="cat")
    sol = listing.with_listing_cells(classify.focus(classify.selected(W.items_wide(t), p), p))
    cells = listing.cell_table(sol)
    scen = spark.createDataFrame([(1, 7, 100, 2.0), (2, 1, 100, 2.0)], "scenario_id int, fotos int, caracteres int, frete double")
    out = {r.scenario_id: r for r in whatif.recommend(sol, cells, scen).collect()}
    assert out[1].sim_prop_quantity is None and out[1].increase_quantity is None
    assert out[2].sim_prop_quantity == 0.0 and out[2].increase_quantity is None
    assert out[2].current_situation_quantity.startswith("Você está usando 1 fotos")


def test_payment_names_and_count(spark):
    df = spark.createDataFrame([(1.0, None, 2.0, 0.0)], "a double, b double, c double, d double")
    names = {"credit_card": F.col("a"), "boleto": F.col("b"), "voucher": F.col("c"), "debit_card": F.col("d")}
    r = df.select(labels.count_present(*names.values()).alias("n"), labels.names_present(names).alias("nm")).first()
    assert r.n == 3 and r.nm == ["credit_card", "voucher", "debit_card"]


def test_accented_words(spark):
    msgs = spark.createDataFrame([("não é",)], "review_comment_message string")
    got = {r.word: r["count"] for r in text.word_counts(msgs, text.stop_words(spark, [])).collect()}
    assert got == {"não": 1, "é": 1}


def test_bad_date_text_is_null(spark):
    df = spark.createDataFrame([("bad",), ("2020-01-02 03:04:05",)], "s string")
    got = [r.t for r in df.select(profile.parse_timestamp(F.col("s")).alias("t")).collect()]
    assert got[0] is None and got[1] is not None


def test_percent_and_money_labels(spark):
    df = spark.createDataFrame([(0.4567, 1234567.891)], "p double, m double")
    r = df.select(labels.percent(F.col("p"), 2).alias("p2"), labels.percent(F.col("p")).alias("p1"),
                  labels.reais(F.col("m")).alias("r"), labels.k_reais(F.col("m")).alias("k")).first()
    assert (r.p2, r.p1, r.r, r.k) == ("46%", "46%", "R$1.234.567,89", "R$1.235k")
    minus = df.select(labels.reais(F.lit(-5.0)).alias("a"), labels.reais(F.lit(-5.0), digits=None).alias("b"),
                      labels.reais(F.lit(1234.5), digits=None).alias("c"), labels.thousands(F.col("m")).alias("n")).first()
    assert tuple(minus) == ("-R$5,00", "-R$5", "R$1.234,50", "1.234.568")


def test_moments_survive_cancellation_and_large_integers(spark):
    rows = [(10 ** 9 if k % 2 else 10 ** 9 - 1, 100000000 + k % 2, None if k % 7 == 0 else k % 3) for k in range(1000)]
    df = (spark.createDataFrame(rows, "big long, p long, r long")
          .select("big", F.col("p").cast("decimal(18,2)").alias("price"), "r"))
    got = {r.column_name: r for r in profile.numeric_profile(df, ["big", "price"]).collect()}
    assert abs(got["price"].sd - 0.5002501876563868) < 1e-9 and abs(got["big"].sd - 0.5002501876563868) < 1e-9
    corr = {(r.col_a, r.col_b): r.corr for r in profile.correlation_matrix(df, ["big", "price", "r"]).collect()}
    assert corr["price", "price"] == 1.0 and corr["big", "price"] == 1.0
    both = df.filter("r is not null").select(F.corr(F.col("price").cast("double"), F.col("r").cast("double"))).first()[0]
    assert abs(corr["price", "r"] - both) < 1e-9


def test_shares_sum_to_one(spark):
    t = one_order(spark, [(1, 1, 5, D(2020, 1, 1), D(2020, 1, 2)), (2, 1, 2, D(2020, 1, 1), D(2020, 1, 2))],
                  n_items=3)
    sel = classify.selected(W.items_wide(t), Params())
    m1 = category.category_class_summary(sel)
    tot = m1.groupBy("product_category_name").agg(F.sum("percent_notas").alias("s")).collect()
    assert all(abs(r.s - 1.0) < 1e-12 for r in tot)


def test_ntz_micros_are_zone_free_and_monotone(spark):
    import datetime as dt

    from vitrine.functions.timeutil import micros_to_ntz, ntz_to_micros

    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        ts = [dt.datetime(2021, 3, 14, 2, 45), dt.datetime(2021, 3, 14, 3, 0), dt.datetime(1969, 12, 31, 23, 59, 59, 1),
              dt.datetime(2018, 11, 4, 1, 30, 0, 123456)]
        df = spark.createDataFrame([(t,) for t in ts], "t timestamp_ntz")
        rows = df.select("t", ntz_to_micros(F.col("t")).alias("us")).withColumn("back", micros_to_ntz(F.col("us"))).collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
    epoch = dt.datetime(1970, 1, 1)
    for r in rows:
        assert r.us == (r.t - epoch) // dt.timedelta(microseconds=1)
        assert r.back == r.t


def test_density_bandwidth_falls_back_when_iqr_is_zero(spark):
    from vitrine.plans import price

    # most values equal: IQR = 0, so the bandwidth must come from sd, not be 0
    rows = [("alta", 100.0)] * 20 + [("alta", 1000.0)]
    df = spark.createDataFrame(rows, "review_simple string, total_price double")
    out = price.density(df, grid=8, fine_bins=16).collect()
    assert len(out) == 8 and all(r.bw > 0 and r.density >= 0 for r in out)


def test_strict_aggregates_follow_r_without_na_rm(spark):
    from vitrine.functions.aggregates import strict_max, strict_sum

    df = spark.createDataFrame([("a", 1.0), ("a", None), ("b", 2.0), ("b", 3.0)], "k string, x double")
    got = {r.k: (r.s, r.m, r.plain) for r in df.groupBy("k").agg(
        strict_sum("x").alias("s"), strict_max("x").alias("m"), F.sum("x").alias("plain")).collect()}
    assert got == {"a": (None, None, 1.0), "b": (5.0, 3.0, 5.0)}


def test_unmatched_state_names_are_reported(spark):
    # trap S23: the map is joined on the upper-cased name; a spelling difference finds no state
    metrics = spark.createDataFrame([("SÃO PAULO", 3), ("SAO PAULO", 1)], "nome string, n_orders long")
    smap = spark.createDataFrame([("SÃO PAULO", "POLY")], "nome string, geometry string")
    assert [r.nome for r in geo.unmatched_states(metrics, smap).collect()] == ["SAO PAULO"]


def test_character_profile_counts_empty_and_blank(spark):
    df = spark.createDataFrame([("ab",), ("",), ("  ",), (None,), ("ab",)], "s string")
    r = profile.character_profile(df, ["s"]).first()
    assert (r.n_missing, r.min_length, r.max_length, r.empty, r.whitespace, r.n_unique) == (1, 0, 2, 1, 1, 3)
    assert r.complete_rate == 0.8
    f = profile.frequencies(df).first()
    assert (f.unique_values, f.missing) == (3, 1)


def test_timestamp_profile_median_and_bounds(spark):
    ts = [D(2020, 1, 1), D(2020, 1, 3), D(2020, 1, 2, 12), D(2020, 1, 5), None]
    df = spark.createDataFrame([(t,) for t in ts], "t timestamp_ntz")
    r = profile.timestamp_profile(df, ["t"]).first()
    assert (r.n_missing, r.min, r.max, r.n_unique) == (1, D(2020, 1, 1), D(2020, 1, 5), 4)
    assert r.median == D(2020, 1, 2, 18)   # midpoint of the two middle values (type 7)
