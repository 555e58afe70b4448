"""Distributed exact rank machinery.

The reference labels rows by ``ntile(10000)`` over the whole column -- a global
row number.  ``Window.orderBy`` without a partition sorts everything in one
task, so here the rank is never materialised per row.  Instead ``values_at``
finds the values that hold given ranks in two scans:

1. A mergeable quantile sketch (``percentile_approx``) and the row count give a
   bracket of values around every wanted rank; the sketch's error is a share of
   the rows, so a bracket holds a small share of them.
2. One aggregate counts the rows between the brackets as one number each, and
   the rows inside by value.  Only what lies inside is shuffled by value.
   The running sum over these counts is exact and shows the value that holds
   each rank, and the rank within it.

For labels the rows of those values (at most ``n_labels - 1`` values per group)
are ranked by their tie-break columns with ``prefix_before`` -- the third scan --
and every row is labelled by comparing its keys with the boundary rows.

``prefix_before`` cuts its rows into as many ranges as their count asks for
(``RANGE_ROWS`` each), by Spark's own sampling, which works for any orderable type
and any distribution; the totals of the ranges give the offsets.

NULL keys order first, as in Spark's ascending sort, and NULL groups stay.  The
tie-break replaces R's "row order" (trap S21) with identifying columns.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitrine.operators.lineage import materialize

#: Rows of a range of ``prefix_before``.
RANGE_ROWS = 500_000
#: The sketch errs by at most 1 / ACCURACY of the rows; brackets end on a grid of GRID steps.
ACCURACY, GRID = 2000, 500


def join_null_safe(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on equal columns where NULL equals NULL; the right side's copies are dropped."""
    if not on:
        raise ValueError("join_null_safe needs columns")
    right = right.select(*[F.col(c).alias(f"_right_{c}") if c in on else F.col(c) for c in right.columns])
    cond = [F.col(c).eqNullSafe(F.col(f"_right_{c}")) for c in on]
    return left.join(right, cond, how).drop(*[f"_right_{c}" for c in on])


def prefix_before(df: DataFrame, part: Sequence[str], key, weight: str, blocks: int | None = None,
                  out: str = "_pb") -> DataFrame:
    """Add ``out`` = sum(weight) over rows of the same ``part`` group whose ``key``
    (a column, or a list of columns compared lexicographically) is smaller.

    ``df`` must have one row per (part, key) -- an aggregated table.  ``blocks`` is the
    number of ranges, by default one per ``RANGE_ROWS`` rows."""
    part = list(part)
    keys = [key] if isinstance(key, str) else list(key)
    if blocks is None:
        df = materialize(df)
        blocks = 1 + df.count() // RANGE_ROWS
    if blocks == 1:  # at most RANGE_ROWS rows
        before = Window.partitionBy(*part).orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
        return df.withColumn(out, F.coalesce(F.sum(weight).over(before), F.lit(0)))
    # written once: the ranges are sampled, so a second evaluation could cut them elsewhere
    ranges = materialize(df.repartitionByRange(blocks, *part, *keys).withColumn("_blk", F.spark_partition_id()))
    totals = ranges.groupBy(*part, "_blk").agg(F.sum(weight).alias("_bt"))
    earlier = Window.partitionBy(*part).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*part, "_blk", F.coalesce(F.sum("_bt").over(earlier), F.lit(0)).alias("_bo"))
    within = Window.partitionBy("_blk", *part).orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    return (join_null_safe(ranges, offsets, [*part, "_blk"])
            .withColumn(out, F.col("_bo") + F.coalesce(F.sum(weight).over(within), F.lit(0))).drop("_blk", "_bo"))


def ntile_index(rank: str, n_rows: str, n: int, precision: int = 4, method: str = "floor") -> Column:
    """0-based label index of the reference's cut rule.

    ``method="floor"`` (default, dplyr < 1.0 ``ntile``, trap S2):
    q = floor(10^p * (rank - 1) / N) + 1.  ``method="sql"``: q = SQL
    ``NTILE(10^p)`` of the rank (the first N mod 10^p buckets hold one row more).
    The label is the number of cuts ``10^p / n * k`` (k = 1..n-1) with q >= cut,
    evaluated in integers: n * q >= 10^p * k.
    """
    scale = 10 ** precision
    if method == "floor":
        q = F.expr(f"(CAST({scale} AS BIGINT) * ({rank} - 1)) div {n_rows} + 1")
    elif method == "sql":
        size, extra = f"({n_rows} div {scale})", f"({n_rows} % {scale})"
        big = f"({extra} * ({size} + 1))"
        q = F.expr(f"CASE WHEN {rank} <= {big} THEN ({rank} - 1) div ({size} + 1) + 1 "
                   f"ELSE {extra} + ({rank} - 1 - {big}) div {size} + 1 END")
    else:
        raise ValueError(f"unknown ntile method {method!r}")
    idx = F.lit(0)
    for k in range(1, n):
        idx = idx + (F.lit(n) * q >= F.lit(scale * k)).cast("int")
    return idx


def label_from_index(idx: Column, labels: Sequence[str]) -> Column:
    expr = F.lit(labels[-1])
    for i in range(len(labels) - 2, -1, -1):
        expr = F.when(idx == i, F.lit(labels[i])).otherwise(expr)
    return expr


def first_rank(n_rows: str, k: int, n: int, precision: int, method: str) -> str:
    """SQL of the smallest rank whose ``ntile_index`` is at least ``k`` (beyond the last row if none is)."""
    scale = 10 ** precision
    q = (scale * k + n - 1) // n  # the bucket where label k begins
    if method == "floor":
        return f"1 + (CAST({q - 1} AS BIGINT) * {n_rows} + {scale - 1}) div {scale}"
    if method == "sql":
        return f"CAST({q - 1} AS BIGINT) * ({n_rows} div {scale}) + least({q - 1}, {n_rows} % {scale}) + 1"
    raise ValueError(f"unknown ntile method {method!r}")


def at_ranks(ranked: DataFrame, targets: DataFrame, groups: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """The row of ``ranked`` (with ``_pb`` and ``_c``) that holds each target rank ``_r``, and the rank within it."""
    if groups:
        both = join_null_safe(ranked, targets, groups)
    else:  # one group: its few targets as one array
        few = targets.agg(F.expr("collect_list(struct(_k, _r)) as _t")).scalar()
        both = ranked.withColumn("_t", few).selectExpr(*[f"`{c}`" for c in ranked.columns], "inline(_t)")
    return both.filter("_pb < _r and _r <= _pb + _c").selectExpr(*[f"`{c}`" for c in keep], "_k", "_r - _pb as _r")


def brackets(rows: DataFrame, part: Sequence[str], value: str, ranks: Sequence[str]) -> DataFrame:
    """Per group: the row count ``_n``, each wanted rank ``_r{k}`` (SQL over ``_n``), and values ``_lo{k}`` and
    ``_hi{k}`` (as doubles) that enclose it.  Columns that are not numbers get no sketch: all lies inside."""
    below, above = "double('-infinity')", "double('NaN')"  # NaN is the largest double
    numeric = isinstance(rows.schema[value].dataType, T.NumericType)
    aggs = ["count(1) as _n"]
    if numeric:
        steps = ", ".join(f"{i / GRID}D" for i in range(GRID + 1))
        aggs.append(f"percentile_approx(cast(`{value}` as double), array({steps}), {ACCURACY}) as _grid")
    known = [f"`{c}`" for c in part]
    out = rows.groupBy(*part).agg(*[F.expr(x) for x in aggs])
    out = out.selectExpr("*", *[f"cast({rank} as bigint) as _r{k}" for k, rank in enumerate(ranks)])
    ends, slack = [], 2 * GRID / ACCURACY
    for k in range(len(ranks)):
        first = f"cast(floor((_r{k} - 1) / greatest(_n, 1) * {GRID} - {slack}) as int)"
        last = f"cast(ceil(_r{k} / greatest(_n, 1) * {GRID} + {slack}) as int)"
        ends.append(f"if({first} > 0, get(_grid, {first}), {below}) as _lo{k}" if numeric else f"{below} as _lo{k}")
        ends.append(f"if({last} < {GRID}, get(_grid, {last}), {above}) as _hi{k}" if numeric else f"{above} as _hi{k}")
    return out.selectExpr(*known, "_n", *[f"_r{k}" for k in range(len(ranks))], *ends)


def values_at(rows: DataFrame, part: Sequence[str], value: str, ranks: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(part, _k, value, _r) for each rank k in 1.._n: the value that holds it and the rank within that
    value; and (part, _n), the groups' row counts.

    ``ranks`` are SQL over ``_n``; ``rows`` must not hold NULL values.  Should a rank lie outside its
    bracket, the counts are taken again without brackets."""
    part, many, value_of = list(part), range(len(ranks)), rows.select(*part, value)
    known = materialize(brackets(value_of, part, value, ranks))  # one row per group
    each = ", ".join(f"named_struct('_k', {k}, '_r', _r{k})" for k in many)
    targets = known.selectExpr(*[f"`{c}`" for c in part], "_n", f"inline(array({each}))")
    targets = targets.filter("_r >= 1 and _r <= _n").drop("_n")
    found = materialize(_found(value_of, part, value, known, targets, many))
    if found.filter("_outside").limit(1).count():
        free = known.selectExpr(*[f"`{c}`" for c in part], *[x for k in many for x in (
            f"double('-infinity') as _lo{k}", f"double('NaN') as _hi{k}")])
        found = materialize(_found(value_of, part, value, free, targets, many))
    return found.drop("_outside"), known.select(*part, "_n")


def _found(rows: DataFrame, part: list[str], value: str, known: DataFrame, targets: DataFrame, many) -> DataFrame:
    ends = [f"_{side}{k}" for k in many for side in ("lo", "hi")]
    if part:
        both = join_null_safe(rows, known.select(*part, *ends), part)
    else:
        few = known.select(F.expr(f"struct({', '.join(ends)})")).scalar()
        both = rows.withColumn("_few", few).selectExpr(f"`{value}`", "_few.*")
    x = f"cast(`{value}` as double)" if isinstance(rows.schema[value].dataType, T.NumericType) else "0.0D"
    inside = " or ".join(f"({x} >= _lo{k} and {x} <= _hi{k})" for k in many)
    region = " + ".join(f"cast({x} >= _lo{k} as int)" for k in many)
    # outside rows of a region lie above its inside rows and below the next region's
    placed = both.selectExpr(*[f"`{c}`" for c in part], f"{region} as _region", f"not ({inside}) as _outside",
                             f"if({inside}, `{value}`, null) as `{value}`")
    order = ["_region", "_outside", value]
    counts = placed.groupBy(*part, *order).agg(F.expr("count(1) as _c"))
    return at_ranks(prefix_before(counts, part, order, "_c"), targets, part, [*part, "_outside", value])


def boundary_rows(rows: DataFrame, part: Sequence[str], keys: Sequence[str], ranks: Sequence[str],
                  blocks: int | None = None) -> DataFrame:
    """(part, _k, keys) of the row at each rank k: rows ordered by ``keys``, of which the first is the
    value (never NULL) and all together tell rows apart."""
    part, value = list(part), keys[0]
    targets, _ = values_at(rows, part, value, ranks)
    group = [*part, value]
    inside = join_null_safe(rows, targets.select(*group).distinct(), group, "left_semi").withColumn("_c", F.lit(1))
    ranked = prefix_before(inside.select(*dict.fromkeys([*part, *keys]), "_c"), group, list(keys[1:]), "_c", blocks)
    return at_ranks(ranked, targets, group, [*part, *keys]).drop("_r")


def ntile_labels(df: DataFrame, value: str, tie_break: Sequence[str], labels: Sequence[str], out: str,
                 part: Sequence[str] = (), precision: int = 4, blocks: int | None = None,
                 with_index: str | None = None, checkpoint_output: bool = False,
                 method: str = "floor") -> DataFrame:
    """Label each row by the n-tile (n = len(labels)) of its exact rank of ``value``.

    NULL values get a NULL label and do not count in N (trap S3).  ``part``
    ranks independently within groups.  ``method`` picks the n-tile rule
    (``ntile_index``).  The input is written once with a row id, the last
    tie-break, so pass only the columns that are needed.  Returns ``df`` with
    ``out`` (and the 0-based index as ``with_index``); ``checkpoint_output``
    cuts the lineage of the result for callers that read it several times.
    """
    part, n = list(part), len(labels)
    keys = [value, *tie_break, "_rid"]
    df = materialize(df.withColumn("_rid", F.monotonically_increasing_id()))
    rows = df.filter(F.col(value).isNotNull()).select(*dict.fromkeys([*part, *keys]))
    starts = [first_rank("_n", k, n, precision, method) for k in range(1, n)]
    found = boundary_rows(rows, part, keys, starts, blocks)  # at most n - 1 rows per group
    bounds = materialize(found.groupBy(*part).agg(F.collect_list(F.struct(*keys)).alias("_bounds")))
    if part:
        labelled = join_null_safe(df, bounds, part, "left")
    else:
        labelled = df.withColumn("_bounds", bounds.select("_bounds").scalar())
    own = F.struct(*keys)
    passed = F.size(F.filter(F.coalesce("_bounds", F.array()), lambda b: b <= own))
    labelled = (labelled.withColumn("_idx", F.when(F.col(value).isNotNull(), passed)).drop("_bounds", "_rid")
                .withColumn(out, F.when(F.col("_idx").isNotNull(), label_from_index(F.col("_idx"), labels))))
    if checkpoint_output:
        labelled = materialize(labelled)
    if with_index:
        return labelled.withColumnRenamed("_idx", with_index)
    return labelled.drop("_idx")


def interpolate(low: str, high: str, share: str) -> str:
    """SQL of low (1 - share) + high share as one rounded sum: the rounding error of the first product is
    added back, so the middle of two amounts of money shows no stray last digit."""
    def top(x: str) -> str:  # the upper half of a double's digits, by 2^27 + 1
        return f"(134217729.0D * {x} - (134217729.0D * {x} - {x}))"

    part = f"(1.0D - {share})"
    a, c = top(low), top(part)
    b, d = f"({low} - {a})", f"({part} - {c})"
    product, other = f"({low} * {part})", f"({high} * {share})"
    lost = f"({b} * {d} - ((({product} - {a} * {c}) - {b} * {c}) - {a} * {d}))"
    total = f"({product} + {other})"
    back = f"({total} - {product})"
    return f"{total} + ((({product} - ({total} - {back})) + ({other} - {back})) + {lost})"


def exact_quantiles(df: DataFrame, value: str, probs: Sequence[float], part: Sequence[str] = (),
                    names: Sequence[str] | None = None) -> DataFrame:
    """Exact quantiles with linear interpolation (R type 7, Spark ``percentile``).

    With 0-based position h = (N - 1) p: x[floor h] + (h - floor h) (x[floor h + 1] - x[floor h]).

    The order statistics come from ``values_at``: no global sort, and only values near them are
    shuffled.  (``F.percentile`` keeps every distinct value of a group in one buffer.)  One row
    per part group, a NULL group included, one column per probability.
    """
    part = list(part)
    names = list(names or [f"q{int(round(p * 100)):02d}" for p in probs])
    rows = df.filter(F.col(value).isNotNull())
    spots = [f"(cast(_n - 1 as double) * {float(p)!r}D)" for p in probs]
    ranks = [r for pos in spots for r in (f"floor({pos}) + 1", f"least(floor({pos}) + 2, _n)")]
    at, sizes = values_at(rows, part, value, ranks)
    picked = [F.expr(f"min(if(_k = {k}, cast(`{value}` as double), null)) as _x{k}") for k in range(len(ranks))]
    if part:
        wide = join_null_safe(sizes, at.groupBy(*part).agg(*picked), part)
    else:
        wide = at.agg(*picked).withColumn("_n", sizes.scalar())
    wide = wide.selectExpr("*", *[f"{pos} - floor({pos}) as _f{i}" for i, pos in enumerate(spots)])
    return wide.selectExpr(*[f"`{c}`" for c in part], *[
        f"if(_x{2 * i} = _x{2 * i + 1}, _x{2 * i}, {interpolate(f'_x{2 * i}', f'_x{2 * i + 1}', f'_f{i}')}) as `{nm}`"
        for i, nm in enumerate(names)])
