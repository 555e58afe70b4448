"""The outer join that is safe for NULL and hot keys, against a plain full-outer join."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from vitrine.operators import outer_join as oj


def rows(df, cols):
    return Counter(tuple(r[c] for c in cols) for r in df.select(*cols).collect())


def sides(spark, seed, hot=0):
    rnd = random.Random(seed)

    def key():
        return None if rnd.random() < 0.3 else rnd.randrange(25)

    a = [(key(), k) for k in range(120)] + [(7, 1000 + k) for k in range(hot)]
    b = [(key(), f"b{k % 9}") for k in range(60)]
    c = [(key(), k * 1.5) for k in range(40)] + [(99, 1.0)]
    return (spark.createDataFrame(a, "k long, a long"), spark.createDataFrame(b, "k long, b string"),
            spark.createDataFrame(c, "k long, c double"))


@pytest.mark.parametrize("seed,hot", [(1, 0), (2, 400)])
def test_three_tables_as_a_plain_full_outer_join(spark, seed, hot):
    a, b, c = sides(spark, seed, hot)
    want = a.join(b, "k", "full_outer").join(c, "k", "full_outer")
    assert rows(oj.outer_join([a, b, c], "k"), ["k", "a", "b", "c"]) == rows(want, ["k", "a", "b", "c"])


def test_left_join(spark):
    a, b, c = sides(spark, 3, 200)
    want = a.join(b, "k", "left").join(c, "k", "left")
    assert rows(oj.outer_join([a, b, c], "k", [True, False, False]), ["k", "a", "b", "c"]) == rows(want, ["k", "a", "b", "c"])


def test_empty_tables_and_names(spark):
    a, b, _ = sides(spark, 4)
    none = b.limit(0)
    assert rows(oj.outer_join([a, none], "k"), ["k", "a", "b"]) == rows(a.join(none, "k", "full_outer"), ["k", "a", "b"])
    assert oj.outer_join([none, none.withColumnRenamed("b", "d")], "k").count() == 0
    with pytest.raises(ValueError):
        oj.outer_join([a, b], "k", [False, False])


def test_hot_keys_are_few_and_dealt_out(spark):
    hot = spark.range(30_000).select(F.lit(5).cast("long").alias("k"), F.col("id").alias("a"))
    rest = spark.range(60_000).select((F.col("id") % 3000 + 10).alias("k"), F.col("id").alias("a"))
    nulls = spark.range(40_000).select(F.lit(None).cast("long").alias("k"), F.col("id").alias("a"))
    a = hot.unionByName(rest).unionByName(nulls)
    b = spark.range(3010).select(F.col("id").alias("k"), F.lit("x").alias("b"))
    counts = oj.key_counts([a, b], "k")
    found = oj.hot_keys(counts, "k", 2).collect()
    assert len(found) <= 1 / oj.HOT_SHARE and [r.k for r in found if r._salts > 100] == [5]
    old = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    for k, v in zip(old, ("false", "-1")):  # no help by the engine: each task's rows as the join deals them
        spark.conf.set(k, v)
    try:
        joined = oj.outer_join([a, b], "k", [True, False]).filter("k is not null")
        sizes = sorted(r["count"] for r in joined.groupBy(F.spark_partition_id().alias("p")).count().collect())
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert sum(sizes) == 90_000 and sizes[-1] <= 3 * sizes[len(sizes) // 2]


def test_null_keys_are_not_shuffled(spark):
    a, b, _ = sides(spark, 6)
    plan = oj.outer_join([a, b], "k")._jdf.queryExecution().optimizedPlan().toString()
    assert "FullOuter" not in plan and plan.count("isnull(k") >= 2


def test_a_table_under_another_counts_only_beside_its_rows(spark):
    rnd = random.Random(11)
    keys = [None, *range(12)]
    a, b, c = ([(rnd.choice(keys), k) for k in range(n)] for n in (20, 30, 25))
    c += [(99, 1000)]
    b += [(99, 2000), (99, 2001), (98, 2002)]  # beside c or nothing, not beside a
    tables = [spark.createDataFrame(rows, f"k int, {name} int") for rows, name in ((a, "a"), (b, "b"), (c, "c"))]
    left = tables[0].join(tables[1], "k", "left")
    want = left.join(tables[2], "k", "full_outer").select("k", "a", "b", "c")
    got = oj.outer_join(tables, "k", [True, False, True], under={1: 0}).select("k", "a", "b", "c")
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
