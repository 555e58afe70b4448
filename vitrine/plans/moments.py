"""Weighted co-moments for correlations.

Each column is shifted by its approximate median, a value that occurs in it, before
anything is multiplied: sums of shifted doubles neither overflow nor cancel, and add up in
any order (partial aggregates, NULL patterns, orders).  A shifted constant is exactly
zero, so a column without variance gives NULL and not noise.

A pair's moments are six sums over the rows where both columns are present: weight,
w x, w y, w x x, w y y, w x y.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PARTS = ("n", "a", "b", "aa", "bb", "ab")
#: Relative variance (about the median) below which a pair counts as constant: rounding alone reaches this.
CONSTANT = 1e-12


def centred(df: DataFrame, cols: Sequence[str], first: int = 0) -> DataFrame:
    """``df`` with ``_x{first}``, ``_x{first + 1}``, ...: the columns minus their medians, as doubles.

    The medians are one row, fetched here, as several sums read the result."""
    return df.withColumns(centres(df, cols, first))


def centres(df: DataFrame, cols: Sequence[str], first: int = 0) -> dict[str, Column]:
    """The columns of ``centred`` by name."""
    middle = df.agg(*[F.percentile_approx(c, 0.5, 1000).alias(f"m{i}") for i, c in enumerate(cols)]).first()
    return {f"_x{first + i}": (F.col(c) - F.lit(middle[i]).cast(df.schema[c].dataType)).cast("double")
            for i, c in enumerate(cols)}


def pattern_moments(rows: DataFrame, own: Sequence[int]) -> DataFrame:
    """One row with the moments ``{part}_{i}_{j}`` of every pair i <= j of ``own``,
    from ``_x{i}`` and the weight ``_w``: first one group for each NULL pattern, then the pairs."""
    own = list(own)
    pairs = [(i, j) for k, i in enumerate(own) for j in own[k:]]
    mask = " + ".join(f"if(_x{i} is null, 0L, {1 << i}L)" for i in own)
    groups = rows.withColumn("_mask", F.expr(mask)).groupBy("_mask").agg(
        F.expr("sum(_w) as n"), *[F.expr(f"sum(_w * _x{i}) as s{i}") for i in own],
        *[F.expr(f"sum(_w * _x{i} * _x{j}) as x{i}_{j}") for i, j in pairs])
    sums = []
    for i, j in pairs:
        bits = 1 << i | 1 << j
        for part, c in zip(PARTS, ("n", f"s{i}", f"s{j}", f"x{i}_{i}", f"x{j}_{j}", f"x{i}_{j}")):
            sums.append(f"sum(if((_mask & {bits}L) = {bits}L, {c}, null)) as {part}_{i}_{j}")
    return groups.agg(*[F.expr(x) for x in sums])


def correlations(sums: DataFrame, cols: Sequence[str], digits: int = 2) -> DataFrame:
    """One row per ordered pair of columns: col_a, col_b, corr, corr_rounded; NULL without variance."""
    pairs = [(i, j) for i in range(len(cols)) for j in range(i, len(cols))]
    each = ", ".join(f"named_struct('i', {i}, 'j', {j}, " + ", ".join(f"'{p}', {p}_{i}_{j}" for p in PARTS) + ")"
                     for i, j in pairs)
    one = sums.select(F.expr(f"inline(array({each}))"))
    one = one.selectExpr("i", "j", "n", "aa", "bb", "n * ab - a * b as cross", "n * aa - a * a as va", "n * bb - b * b as vb")
    one = one.selectExpr("i", "j", f"if(va > {CONSTANT} * n * aa and vb > {CONSTANT} * n * bb, "
                                   "try_divide(cross, sqrt(va) * sqrt(vb)), null) as r")
    # rounding may carry a perfect correlation past one or just below it
    one = one.selectExpr("i", "j", "if(abs(abs(r) - 1.0D) < 1e-13, signum(r), r) as corr")
    names = F.array(*[F.lit(c) for c in cols])
    both = one.select(F.explode(F.expr("if(i = j, array(struct(i, j)), array(struct(i, j), struct(j as i, i as j)))")).alias("p"), "corr")
    rounded = F.bround("corr", digits)
    # one sign of zero, whatever the engine's rounding returns for tiny negatives
    return both.select(F.get(names, F.col("p.i")).alias("col_a"), F.get(names, F.col("p.j")).alias("col_b"), "corr",
                       F.when(rounded == 0, F.lit(0.0)).otherwise(rounded).alias("corr_rounded"))
