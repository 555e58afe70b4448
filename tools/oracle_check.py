"""Run every registered query in Spark and its SQL in DuckDB; compare results.

usage: python tools/oracle_check.py [sf_dir] [name-substring ...]
Prints one line per query and a JSON summary.  Local harness only.
"""

from __future__ import annotations

import json
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return v
    if hasattr(v, "isoformat"):
        return str(v)[:19]
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    try:
        import numpy as np
        if isinstance(v, np.ndarray):
            return tuple(_norm(x) for x in v.tolist())
        if isinstance(v, np.generic):
            return _norm(v.item())
    except ImportError:
        pass
    return v


def rows_of(records, cols):
    out = [tuple(_norm(r[c]) for c in cols) for r in records]
    return sorted(out, key=lambda t: tuple((x is None, str(type(x)), x if x is not None else 0)
                                           if not isinstance(x, tuple) else (False, "t", str(x))
                                           for x in t))


def main() -> int:
    import duckdb

    from vitrine.catalog import REGISTRY
    from vitrine.session import local_session

    args = sys.argv[1:]
    sf_dir = args[0] if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    pats = [a for a in args if not a.startswith("/")]
    spark = local_session()
    if os.environ.get("ORACLE_CHECK_TZ"):  # e.g. check that no query depends on the session zone
        spark.conf.set("spark.sql.session.timeZone", os.environ["ORACLE_CHECK_TZ"])
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    summary = {}
    for name, q in REGISTRY.items():
        if pats and not any(p in name for p in pats):
            continue
        t0 = time.time()
        try:
            sdf = q.run(spark, sf_dir)
            cols = sorted(sdf.columns)
            srows = [r.asDict(recursive=True) for r in sdf.collect()]
            ts = time.time() - t0
            sql = q.oracle()
            if sql is None:
                summary[name] = {"rows": len(srows), "oracle": None}
                print(f"{name:40s} rows={len(srows):7d}  (no oracle)  {ts:.1f}s")
                continue
            rel = con.sql(sql)
            dcols = sorted(rel.columns)
            drows = [dict(zip(rel.columns, r)) for r in rel.fetchall()]
            ok_cols = cols == dcols
            ok_n = len(srows) == len(drows)
            ok_v = ok_cols and rows_of(srows, cols) == rows_of(drows, cols)
            summary[name] = {"rows": len(srows), "oracle_rows": len(drows), "cols": ok_cols, "values": ok_v}
            flag = "OK " if (ok_cols and ok_n and ok_v) else "BAD"
            print(f"{flag} {name:40s} rows={len(srows):7d}/{len(drows):7d} cols={ok_cols} values={ok_v} {ts:.1f}s")
            if not ok_cols:
                print("   spark:", cols, "\n   duck: ", dcols)
            elif not ok_v:
                a, b = rows_of(srows, cols), rows_of(drows, cols)
                diff = [(x, y) for x, y in zip(a, b) if x != y][:3]
                print("   cols:", cols)
                for x, y in diff:
                    print("   spark:", x, "\n   duck: ", y)
        except Exception as e:  # report and continue
            summary[name] = {"error": str(e)[:300]}
            print(f"ERR {name:40s} {str(e)[:400]}")
    print(json.dumps({"sf_dir": sf_dir, "n": len(summary),
                      "ok": sum(1 for v in summary.values() if v.get("values") or v.get("oracle", 1) is None)}))
    spark.stop()
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
