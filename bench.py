"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query runs end to end from the parquet files and is fully executed into
Spark's ``noop`` sink (no rows pulled to the driver).  Prints ONE JSON line:
{"metric": "total_query_sec", "value": N, "unit": "sec", "queries": {...}, "sf": ...}
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "c12_items_wide", "m3_category_table", "m1_category_class", "m8_basket_buckets", "m9_basket_histogram",
    "m11_state_metrics", "m13_state_map", "m17_price_quartile_class", "m18_payment_method_class",
    "m19_payment_mix", "m22_cell_table", "x1_x6_whatif", "g8_order_total_quantiles", "g9_numeric_profile_items",
    "g11_payment_type_counts", "g13_price_by_year_weekday", "g15_correlation_matrix", "g17_price_histogram",
    "c9_full_outer_wide", "n3_word_counts", "n4_top_words",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q]

    from vitrine.catalog import REGISTRY
    from vitrine.session import local_session

    n = int(cpus) if cpus.isdigit() else os.cpu_count() or 8
    spark = local_session(cores=cpus, shuffle_partitions=max(8, 2 * n), app="vitrine-bench")
    names = only or HEADLINE
    # start-up of the session itself (JVM, first job) is not query time: one tiny job first
    spark.range(1000).selectExpr("sum(id)").collect()
    times: dict[str, float] = {}
    # shared base tables (built once, as in the reference); timed on their own
    from vitrine import catalog
    for base, build in (("base_items_wide", lambda: catalog.wide_table(spark, sf_dir)),
                        ("base_order_side_counts", lambda: catalog.c9_keys(spark, sf_dir)),
                        ("base_order_side_items", lambda: catalog.c9_items(spark, sf_dir))):
        t0 = time.time()
        build()
        times[base] = round(time.time() - t0, 3)
        print(f"{base}: {times[base]}s", file=sys.stderr)
    for name in names:
        t0 = time.time()
        REGISTRY[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
        print(f"{name}: {times[name]}s", file=sys.stderr)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "total_query_sec", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": float(m.group(1)) if m else sf_dir, "cpus": cpus}))
    spark.stop()


if __name__ == "__main__":
    main()
