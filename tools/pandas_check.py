"""Second local compare: Spark ``toPandas()`` vs DuckDB ``.df()``, order-insensitive
row hashes (``pandas.util.hash_pandas_object``) after sorting columns by name.

usage: python tools/pandas_check.py [sf_dir] [name-substring ...]
"""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def main() -> int:
    import duckdb
    import pandas as pd

    from tools.oracle_check import TABLES
    from vitrine.catalog import REGISTRY
    from vitrine.session import local_session

    args = sys.argv[1:]
    sf_dir = args[0] if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    pats = [a for a in args if not a.startswith("/")]
    spark = local_session()
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    bad = 0
    for name, q in REGISTRY.items():
        if (pats and not any(p in name for p in pats)) or q.oracle() is None:
            continue
        a = q.run(spark, sf_dir).toPandas()
        b = con.sql(q.oracle()).df()
        a, b = a[sorted(a.columns)], b[sorted(b.columns)]
        for c in a.columns:
            if str(a[c].dtype).startswith("datetime") or str(b[c].dtype).startswith("datetime"):
                a[c] = pd.to_datetime(a[c]).astype("datetime64[us]")
                b[c] = pd.to_datetime(b[c]).astype("datetime64[us]")
        ha = sorted(pd.util.hash_pandas_object(a, index=False).tolist())
        hb = sorted(pd.util.hash_pandas_object(b, index=False).tolist())
        ok = ha == hb
        bad += not ok
        kinds = [(c, str(a[c].dtype), str(b[c].dtype)) for c in a.columns if a[c].dtype.kind != b[c].dtype.kind]
        print(f"{'OK ' if ok else 'BAD'} {name:40s} rows={len(a)}/{len(b)} dtype-kind-diffs={kinds}")
    print("bad:", bad)
    spark.stop()
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
