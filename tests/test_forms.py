"""Further forms: re-cut cells, scenario tables, digits from a column, sketches, pushed filters, released tables."""

import os
import random

import pytest
from pyspark.sql import functions as F

from vitrine import catalog
from vitrine.functions import classify, labels
from vitrine.operators import lineage
from vitrine.params import Params
from vitrine.plans import listing, profile, whatif

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("n,seed", [(0, 1), (1, 2), (5, 3), (60, 4), (200, 5)])
def test_cell_bounds_against_ranking_anew(spark, n, seed):
    rnd = random.Random(seed)
    rows = [(k, k, k, rnd.choice([None, 1, 2, 3, 6]), rnd.choice([None, 10, 20, 20, 30, rnd.randrange(90)])) for k in range(n)]
    sol = spark.createDataFrame(rows, "order_id long, order_item_id long, review_id long, product_photos_qty int, "
                                "product_description_lenght long").withColumn(
        "bucket_photos", listing.photo_bucket(F.col("product_photos_qty")))
    scen = [(k, rnd.choice([None, 1, 3, 7]), rnd.choice([None, 0, 20, 25, 95])) for k in range(25)]
    got = {r.scenario_id: (r.quantil_desc, r.min_characters, r.max_characters) for r in whatif.cell_bounds(
        sol, spark.createDataFrame(scen, "scenario_id int, fotos int, caracteres int")).collect()}

    def bucket(photos):
        return None if photos is None else "1" if photos == 1 else "2-3" if photos < 4 else "4-5" if photos < 6 else "6+"

    for sid, photos, length in scen:
        if length is None:
            assert got[sid] == (None, None, None)
            continue
        every = sorted([(v, 0, k, p) for k, _, _, p, v in rows if v is not None] + [(length, 1, -1, photos)])
        cell = {}
        for i, (v, _, k, p) in enumerate(every):
            q = (10000 * i) // len(every) + 1
            cell[k] = (listing.SEXTILES[sum(6 * q >= 10000 * j for j in range(1, 6))], bucket(p), v)
        own = [v for s, b, v in cell.values() if (s, b) == cell[-1][:2]]
        assert got[sid] == (cell[-1][0], min(own), max(own))


def digits_of(values):
    """The formatter's rule, as its documentation states it."""
    x = sorted({round(v, 10) for v in values if v is not None})
    gaps = [b - a for a, b in zip(x, x[1:])]
    if not gaps or min(gaps) < 1.5e-8:
        return 0
    import math

    digits = 1 - math.floor(math.log10(min(gaps)))
    if all(round(v * 10.0 ** digits) % 10 == 0 for v in x):
        digits -= 1
    return max(0, digits)


@pytest.mark.parametrize("values", [[0.1, 0.2], [0.1, 0.25], [1.0, 2.0, 5.0], [0.123, 0.124, 0.5], [3.0], [None, 7.0], [1200.0, 3400.0]])
def test_digits_come_from_the_whole_column(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "x double")
    out = labels.with_column_accuracy(df, "x", 1.0, "d").withColumn("t", labels.number(F.col("x"), F.col("d")))
    want = digits_of(values)
    assert {r.d for r in out.collect()} == {want}
    assert {r.x: r.t for r in out.collect()} == {v: None if v is None else f"{v:.{want}f}" for v in values}


def test_bars(spark):
    r = spark.range(1).select(labels.bar_percent(F.lit(1), F.lit(8)).alias("p"), labels.bar_thousands(F.lit(1234567)).alias("k")).first()
    assert (r.p, r.k) == ("12.5%", "1234.57k")


def test_sketch_stays_within_its_error(spark):
    df = spark.range(50_000).select(F.col("id"), (F.col("id") % 777).alias("m"), F.when(F.col("id") % 3 > 0, F.col("id")).alias("n"))
    exact = {r.column_name: (r.unique_values, r.missing) for r in profile.frequencies(df).collect()}
    sketch = profile.sketched_frequencies(df)
    for r in sketch.collect():
        assert abs(r.unique_values - exact[r.column_name][0]) <= 3 * 0.02 * exact[r.column_name][0]
        assert r.missing == exact[r.column_name][1]
    assert "hashpartitioning" not in sketch._jdf.queryExecution().executedPlan().toString()


def test_focus_filter_reaches_the_scan(spark):
    plan = catalog.focus(spark, SF, catalog.DASH)._jdf.queryExecution().executedPlan().toString()
    assert "In(product_category_name" in plan.split("PushedFilters")[1].split("]")[0] + "]"
    p = Params(merge_categories=("a", "b"), new_category_name="n")
    df = spark.createDataFrame([("a",), ("b",), ("n",), ("c",), (None,)], "product_category_name string")
    assert {r[0] for r in df.filter(classify.in_focus(F.col("product_category_name"), p)).collect()} == {"a", "b", "n"}


def test_bad_reviews_filter_before_the_joins(spark):
    plan = catalog.REGISTRY["n5_bad_reviews"].run(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "FullOuter" not in plan
    for line in plan.splitlines():
        if "events.parquet" in line or "Relation" in line and "event_id" in line:
            break
    assert "< 4" in plan


def test_release_deletes_what_was_written(spark):
    df = lineage.materialize(spark.range(3), "kept")
    path = df.inputFiles()[0].replace("file://", "").rsplit("/", 1)[0]
    assert os.path.isdir(path)
    other = dict(lineage._WRITTEN)
    try:
        lineage._WRITTEN[spark.sparkContext.applicationId] = [f"file://{path}"]
        lineage.release(spark)
    finally:
        lineage._WRITTEN.update(other)
    assert not os.path.exists(path)


def test_entry_without_the_training_data_folders(tmp_path):
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for name in ("vitrine", "__spark_entry__.py", "corpus_pipeline.py"):
        if not os.path.exists(f"{root}/{name}"):
            continue
        copy = shutil.copytree if os.path.isdir(f"{root}/{name}") else shutil.copy
        copy(f"{root}/{name}", tmp_path / name, **({"ignore": shutil.ignore_patterns("llm", "__pycache__")} if copy is shutil.copytree else {}))
    for gone in ((), ("corpus_pipeline.py",)):
        for name in gone:
            (tmp_path / name).unlink(missing_ok=True)
        said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print('m3_category_table' in e.queries(), "
                               "any(q.startswith('op') or q == 'pipeline' for q in e.queries()))"],
                              cwd=tmp_path, capture_output=True, text=True, timeout=120, env={**os.environ, "PYTHONPATH": ""})
        assert said.stdout.strip() == "True False", said.stderr
