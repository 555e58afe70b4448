"""Distributed rank operators against brute force (global sort in pandas/numpy)."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest

from vitrine.operators import rank

LABELS4 = ["q1", "q2", "q3", "q4"]
LABELS6 = ["1º", "2º", "3º", "4º", "5º", "6º"]


def brute_labels(rows, labels, part_of=lambda r: 0):
    """Reference rule: rank by (value, a, b) among non-null values of the part."""
    n = len(labels)
    out = {}
    parts = {}
    for r in rows:
        parts.setdefault(part_of(r), []).append(r)
    for prow in parts.values():
        nn = sorted([r for r in prow if r[1] is not None], key=lambda r: (r[1], r[2], r[3]))
        N = len(nn)
        for i, r in enumerate(nn, start=1):
            q = (10000 * (i - 1)) // N + 1
            idx = sum(1 for k in range(1, n) if n * q >= 10000 * k)
            out[r[0]] = labels[idx]
        for r in prow:
            if r[1] is None:
                out[r[0]] = None
    return out


def make_rows(n, hot_share, n_distinct, seed, null_share=0.05):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        u = rnd.random()
        if u < null_share:
            v = None
        elif u < null_share + hot_share:
            v = 42  # one hot value holding a large share of rows
        else:
            v = rnd.randrange(n_distinct)
        rows.append((i, v, rnd.randrange(7), rnd.randrange(3)))
    return rows


@pytest.mark.parametrize("n,hot,nd,labels,seed", [
    (1000, 0.0, 50, LABELS4, 1),
    (2000, 0.34, 200, LABELS6, 2),      # hot value straddles boundaries
    (500, 0.9, 5, LABELS4, 3),           # almost everything is one value
    (37, 0.0, 1000, LABELS6, 4),         # N << 10000 (the floor rule matters)
])
def test_ntile_labels_match_brute_force(spark, n, hot, nd, labels, seed):
    # rows with identical (v, a, b) are indistinguishable: compare label counts per full key
    rows = make_rows(n, hot, nd, seed)
    df = spark.createDataFrame(rows, "id long, v long, a long, b long")
    got = Counter((r.v, r.a, r.b, r.lab)
                  for r in rank.ntile_labels(df, "v", ["a", "b"], labels, "lab", blocks=16).collect())
    exp_by_id = brute_labels(rows, labels)
    exp = Counter((v, a, b, exp_by_id[i]) for (i, v, a, b) in rows)
    assert got == exp


def test_ntile_labels_with_duplicate_full_keys(spark):
    # 10 identical (v, a, b) rows spanning a boundary: label counts must still be exact
    rows = [(i, 1, 0, 0) for i in range(10)] + [(10 + i, i + 2, 0, 0) for i in range(10)]
    df = spark.createDataFrame(rows, "id long, v long, a long, b long")
    out = rank.ntile_labels(df, "v", ["a", "b"], ["x", "y"], "lab")
    counts = {r.lab: r["count"] for r in out.groupBy("lab").count().collect()}
    assert counts == {"x": 10, "y": 10}


def test_ntile_labels_per_part(spark):
    rows = make_rows(600, 0.2, 30, 5)
    rows = [(i, v, a, b, i % 3) for (i, v, a, b) in rows]
    df = spark.createDataFrame(rows, "id long, v long, a long, b long, g long")
    got = Counter((r.g, r.v, r.a, r.b, r.lab)
                  for r in rank.ntile_labels(df, "v", ["a", "b"], LABELS4, "lab", part=["g"]).collect())
    exp_by_id = brute_labels(rows, LABELS4, part_of=lambda r: r[4])
    exp = Counter((g, v, a, b, exp_by_id[i]) for (i, v, a, b, g) in rows)
    assert got == exp


def test_prefix_before_double_keys(spark):
    rnd = random.Random(7)
    vals = sorted({round(rnd.uniform(-5, 5), 3) for _ in range(300)})
    w = {v: rnd.randrange(1, 9) for v in vals}
    df = spark.createDataFrame([(v, w[v]) for v in vals], "k double, w long")
    got = {r.k: r._pb for r in rank.prefix_before(df, [], "k", "w", blocks=8).collect()}
    acc, exp = 0, {}
    for v in vals:
        exp[v] = acc
        acc += w[v]
    assert got == exp


@pytest.mark.parametrize("seed", [1, 2])
def test_exact_quantiles_match_numpy(spark, seed):
    rnd = random.Random(seed)
    xs = [rnd.choice([3.5, 3.5, 3.5, rnd.uniform(0, 100)]) for _ in range(777)]
    df = spark.createDataFrame([(x, i % 2) for i, x in enumerate(xs)], "x double, g long")
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]
    names = [f"p{i}" for i in range(len(probs))]
    got = {r.g: r for r in rank.exact_quantiles(df, "x", probs, ["g"], names=names).collect()}
    for g in (0, 1):
        arr = np.array([x for i, x in enumerate(xs) if i % 2 == g])
        for nm, p in zip(names, probs):
            assert got[g][nm] == pytest.approx(float(np.quantile(arr, p)), rel=1e-12, abs=1e-12)


@pytest.mark.parametrize("n_rows,precision", [(8, 4), (37, 1), (1000, 2), (257, 1)])
def test_sql_method_matches_spark_ntile(spark, n_rows, precision):
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    rnd = random.Random(n_rows)
    rows = [(i, rnd.randrange(50)) for i in range(n_rows)]
    df = spark.createDataFrame(rows, "id long, v long")
    labels = [f"L{k}" for k in range(4)]
    got = {r.id: r.lab for r in rank.ntile_labels(df, "v", ["id"], labels, "lab", precision=precision,
                                                      method="sql").collect()}
    scale = 10 ** precision
    ref = df.withColumn("q", F.ntile(scale).over(Window.orderBy("v", "id"))).collect()
    exp = {r.id: labels[sum(1 for k in range(1, 4) if 4 * r.q >= scale * k)] for r in ref}
    assert got == exp


def test_scenario_placement_matches_brute_force(spark):
    from vitrine.plans import listing, whatif

    rnd = random.Random(11)
    lens = [None if rnd.random() < 0.1 else rnd.choice([100, 250, 250, 250, 400, 800, 1200]) for _ in range(97)]
    sol = spark.createDataFrame([(i, v) for i, v in enumerate(lens)], "id long, product_description_lenght long")
    scen_rows = [(1, 3, 250, 1.0), (2, 1, 99, 1.0), (3, 6, 5000, 1.0), (4, None, None, 1.0), (5, 2, 400, 1.0)]
    scen = spark.createDataFrame(scen_rows, "scenario_id int, fotos int, caracteres int, frete double")
    got = {r.scenario_id: r.quantil_desc for r in whatif.place_scenarios(sol, scen).collect()}
    nn = [v for v in lens if v is not None]
    n1 = len(nn) + 1
    for sid, _, c, _ in scen_rows:
        if c is None:
            assert got[sid] is None
            continue
        rank_ = sum(1 for v in nn if v <= c) + 1   # appended last: after its ties
        q = (10000 * (rank_ - 1)) // n1 + 1
        exp = listing.SEXTILES[sum(1 for k in range(1, 6) if 6 * q >= 10000 * k)]
        assert got[sid] == exp, sid


def test_box_stats_match_numpy(spark):
    from vitrine.plans import price

    rnd = random.Random(5)
    rows = [(cls, float(rnd.choice([rnd.lognormvariate(3, 1), 20.0, 20.0])))
            for cls in ("alta", "baixa") for _ in range(301)]
    df = spark.createDataFrame(rows, "review_simple string, total_price double")
    got = {r.review_simple: r for r in price.box_stats(df).collect()}
    for cls in ("alta", "baixa"):
        x = np.array([v for c, v in rows if c == cls])
        q1, q2, q3 = np.quantile(x, [0.25, 0.5, 0.75])
        lo, hi = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
        inside = x[(x >= lo) & (x <= hi)]
        r = got[cls]
        assert r.n == len(x) and r.n_outliers == int(((x < lo) | (x > hi)).sum())
        assert r.lower == pytest.approx(q1, rel=1e-12) and r.middle == pytest.approx(q2, rel=1e-12)
        assert r.upper == pytest.approx(q3, rel=1e-12)
        assert r.ymin == inside.min() and r.ymax == inside.max()


def test_ntile_labels_keep_null_tie_breaks(spark):
    rows = [(i, 1, None if i % 2 else f"ORD-{i:010d}") for i in range(20)]
    df = spark.createDataFrame(rows, "id long, v long, a string")
    got = {r.id: r.lab for r in rank.ntile_labels(df, "v", ["a"], ["x", "y"], "lab").collect()}
    assert got == {i: "x" if a is None else "y" for i, _, a in rows}  # NULL orders first


def test_ranges_hold_outliers_common_prefixes_and_null_groups(spark):
    from vitrine.operators.lineage import materialize

    rows = [(i if i < 3999 else 10 ** 12, f"ORD-{i:010d}", "a" if i % 2 else None) for i in range(4000)]
    df = spark.createDataFrame(rows, "v long, s string, g string")
    for key in ("v", "s"):
        ranges = materialize(df.select(key).repartitionByRange(8, key).withColumn("b", rank.F.spark_partition_id()))
        sizes = [r["count"] for r in ranges.groupBy("b").count().collect()]
        assert len(sizes) == 8 and max(sizes) < 1500
        out = rank.ntile_labels(df, key, [], LABELS4, "lab", blocks=8).groupBy("lab").count().collect()
        assert {r["lab"]: r["count"] for r in out} == dict.fromkeys(LABELS4, 1000)
    got = {r.g: r.m for r in rank.exact_quantiles(df, "v", [0.5], ["g"], names=["m"]).collect()}
    assert got == {None: 1999.0, "a": 2000.0}


def test_interpolation_has_no_stray_digits(spark):
    import duckdb

    rnd = random.Random(4)
    rows = [(g, round(rnd.uniform(0, 90000), 2)) for g in range(60) for _ in range(rnd.choice([1, 2, 3, 4, 5, 6]))]
    df = spark.createDataFrame(rows, "g long, x double")
    got = {r.g: (r.a, r.b, r.c) for r in rank.exact_quantiles(df, "x", [0.25, 0.5, 0.75], ["g"], ["a", "b", "c"]).collect()}
    for g, want in got.items():
        xs = [x for k, x in rows if k == g]
        assert want == duckdb.execute("select quantile_cont(x, 0.25), quantile_cont(x, 0.5), quantile_cont(x, 0.75) "
                                      "from (select unnest(?::double[]) x)", [xs]).fetchall()[0]


def test_only_brackets_are_shuffled_by_value(spark):
    df = spark.range(0, 200_000, 1, 4).select((rank.F.col("id") * 7919 % 200_000).alias("v"))
    at, sizes = rank.values_at(df, [], "v", ["1", "_n div 2", "_n"])
    assert {r._k: (r.v, r._r) for r in at.collect()} == {0: (0, 1), 1: (99_999, 1), 2: (199_999, 1)}
    assert sizes.first()[0] == 200_000
    known = rank.brackets(df, [], "v", ["_n div 2"])
    b = known.first()
    assert b._lo0 < 99_999 < b._hi0 and b._hi0 - b._lo0 < 0.02 * 200_000


def test_ranks_outside_their_brackets_are_found_without(spark, monkeypatch):
    def wrong(rows, part, value, ranks):
        out = rows.groupBy(*part).agg(rank.F.count("*").alias("_n"))
        for k, r in enumerate(ranks):
            out = out.withColumns({f"_r{k}": rank.F.expr(r), f"_lo{k}": rank.F.lit(5.0), f"_hi{k}": rank.F.lit(6.0)})
        return out

    monkeypatch.setattr(rank, "brackets", wrong)
    df = spark.range(100).selectExpr("id", "id % 10 as v", "id % 2 as g")
    got = {r.g: (r.a, r.b) for r in rank.exact_quantiles(df, "v", [0.0, 0.5], ["g"], ["a", "b"]).collect()}
    assert got == {0: (0.0, 4.0), 1: (1.0, 5.0)}


def test_many_ranges_give_the_same_labels(spark, monkeypatch):
    rows = make_rows(3000, 0.3, 400, 9)
    df = spark.createDataFrame(rows, "id long, v long, a long, b long")
    one = Counter((r.v, r.a, r.b, r.lab) for r in rank.ntile_labels(df, "v", ["a", "b"], LABELS6, "lab").collect())
    monkeypatch.setattr(rank, "RANGE_ROWS", 100)
    assert one == Counter((r.v, r.a, r.b, r.lab) for r in rank.ntile_labels(df, "v", ["a", "b"], LABELS6, "lab").collect())


def test_box_stats_and_density_keep_a_null_class(spark):
    from vitrine.plans import price

    df = spark.createDataFrame([(c, float(v)) for c in ("a", None) for v in range(1, 30)], "review_simple string, total_price double")
    assert {r.review_simple: r.n for r in price.box_stats(df).collect()} == {"a": 29, None: 29}
    assert {r.review_simple for r in price.density(df, grid=8, fine_bins=16).collect()} == {"a", None}
