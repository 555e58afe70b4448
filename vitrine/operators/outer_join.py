"""Full-outer joins of several tables on one key, safe for NULL and hot keys.

Spark can split a skewed partition of an inner join, not of a full-outer one, and a
shuffled outer join sends every NULL key to one task.  So:

* Rows with a NULL key match nothing; they are appended without any shuffle.
* One pass counts the rows of each key and table.  A key that a table lacks gets one
  row of NULLs there (found from the counts), after which an inner join gives the
  outer join's rows.
* A key is hot when it makes at least ``HOT_SHARE`` of all joined rows; so at most
  1 / HOT_SHARE keys are, a proven bound for a broadcast.  Its largest table is dealt
  over several salts by a hash of the row, the others are repeated for each salt, so
  no task makes much more than ``HOT_SHARE`` of the rows for one key.

A table whose ``keep`` is false adds no rows of its own, as the right side of a left join.
A table that is ``under`` another one counts only beside rows of it, so that a left join
need not be written before its rows meet the other tables.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.operators.lineage import materialize

HOT_SHARE = 0.001


def key_counts(sides: Sequence[DataFrame], key: str) -> DataFrame:
    """(key, _n0, _n1, ...): the rows of each table with the key; NULL keys are left out."""
    many = range(len(sides))
    rows = [side.filter(f"`{key}` is not null").selectExpr(f"`{key}`", *[f"{int(i == j)}L as _n{i}" for i in many])
            for j, side in enumerate(sides)]
    return reduce(DataFrame.unionByName, rows).groupBy(key).agg(*[F.expr(f"sum(_n{i}) as _n{i}") for i in many])


def hot_keys(counts: DataFrame, key: str, many: int) -> DataFrame:
    """(key, _big, _salts): keys that make HOT_SHARE of the joined rows, their largest table and its parts."""
    made = " * ".join(f"cast(greatest(_n{j}, 1L) as double)" for j in range(many))
    largest = f"greatest({', '.join(f'_n{j}' for j in range(many))})"
    big = " ".join(f"when _n{j} = {largest} then {j}" for j in range(many))
    part = counts.agg(F.expr(f"sum({made}) * {HOT_SHARE}")).scalar()
    return (counts.withColumn("_part", part).filter(f"{made} >= _part")
            .selectExpr(f"`{key}`", f"case {big} end as _big", f"cast(least(ceil({made} / _part), {largest}) as int) as _salts")
            .filter("_salts > 1"))


def outer_join(sides: Sequence[DataFrame], key: str, keep: Sequence[bool] | None = None,
               key_rows: Sequence[DataFrame] | None = None, under: dict[int, int] | None = None,
               counts: DataFrame | None = None) -> DataFrame:
    """The tables' rows joined on ``key``, which is the only column name that they share.

    ``key_rows`` may give cheaper tables with the same keys to count them from, ``counts`` their written
    ``key_counts``.  ``under``: places of tables, each with that of the table whose rows it needs."""
    keep = list(keep or [True] * len(sides))
    if len(sides) < 2 or len(keep) != len(sides) or not any(keep):
        raise ValueError("outer_join needs two tables or more, one of which is kept")
    many, under = range(len(sides)), dict(under or {})
    marked = {*under, *under.values()}
    own = [[c for c in side.columns if c != key] for side in sides]
    quoted = [[f"`{c}`" for c in cols] for cols in own]
    kept = " or ".join(f"_n{j} > 0" for j in many if keep[j])
    if counts is None:
        counts = materialize(key_counts(key_rows or sides, key).filter(kept), "keys")
    counts = counts.withColumns({f"_n{j}": F.expr(f"if(_n{i} = 0, 0L, _n{j})") for j, i in under.items()}).filter(kept)
    hot = hot_keys(counts, key, len(sides))
    hot = hot.sparkSession.createDataFrame(hot.collect(), hot.schema)  # 1 / HOT_SHARE rows at most

    def nothing(j: int) -> list[str]:
        kinds = dict(sides[j].dtypes)
        return [f"cast(null as {kinds[c]}) as `{c}`" for c in own[j]]

    def dealt(j: int) -> DataFrame:
        here = (lambda real: [f"{real} as _here{j}"]) if j in marked else (lambda real: [])
        rows = sides[j].filter(f"`{key}` is not null").selectExpr(f"`{key}`", *quoted[j], *here("true"))
        if any(keep[i] for i in many if i != j):  # another table may have keys that this one lacks
            rows = rows.unionByName(counts.filter(f"_n{j} = 0").selectExpr(f"`{key}`", *nothing(j), *here("false")))
        rows = rows.join(F.broadcast(hot), key, "left")
        mine = f"pmod(xxhash64({', '.join([f'`{key}`', *quoted[j]])}), _salts)"
        salts = (f"case when _salts is null then array(0) when _big = {j} then array(cast({mine} as int)) "
                 "else sequence(0, _salts - 1) end")
        return rows.selectExpr(f"`{key}`", *quoted[j], *([f"_here{j}"] if j in marked else []), f"explode({salts}) as _salt")

    out = dealt(0)
    for k in many[1:]:
        out = out.join(dealt(k), [key, "_salt"])
        for j, i in under.items():
            if k == max(i, j):  # beside a row of NULLs only the row of NULLs stays
                out = out.filter(f"_here{i} or not _here{j}")
    out = out.drop("_salt", *[f"_here{j}" for j in marked])
    for j in many:
        if keep[j]:
            rows = sides[j].filter(f"`{key}` is null")
            out = out.unionByName(rows.selectExpr(f"`{key}`", *[c for i in many for c in (quoted[i] if i == j else nothing(i))]))
    return out
