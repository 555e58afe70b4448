"""Display labels (H3, H5-H9, H12-H13) as Column expressions.

Labels are strings computed next to the raw numbers, never instead of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def percent(x: Column, accuracy: float = 1.0) -> Column:
    """H6: ``scales::percent(x, accuracy)`` -- x*100 rounded (half-even) to the
    nearest multiple of ``accuracy``; integer accuracies print no decimals."""
    scaled = F.bround(x * F.lit(100.0) / F.lit(float(accuracy)), 0) * F.lit(float(accuracy))
    if float(accuracy).is_integer():
        return F.concat(scaled.cast("bigint").cast("string"), F.lit("%"))
    digits = max(0, len(str(accuracy).split(".")[1]))
    return F.concat(F.format_number(scaled, digits), F.lit("%"))


def _swap_marks(s: Column) -> Column:
    # 1,234.56 -> 1.234,56
    return F.translate(s, ",.", ".,")


def reais(x: Column, digits: int | None = 2) -> Column:
    """H7: R$1.234,56 (dot thousands, comma decimals), -R$5,00 below zero.

    ``digits=None`` prints cents only where the amount has some."""
    if digits is None:
        whole = F.bround(x, 2) == F.round(x, 0)
        body = F.when(whole, F.format_number(F.abs(x), 0)).otherwise(F.format_number(F.abs(x), 2))
    else:
        body = F.format_number(F.abs(x), digits)
    return F.concat(F.when(x < 0, F.lit("-")).otherwise(F.lit("")), F.lit("R$"), _swap_marks(body))


def k_reais(x: Column) -> Column:
    """H8: R$1.234k -- thousands, no cents."""
    return F.concat(F.lit("R$"), _swap_marks(F.format_number(F.bround(x / F.lit(1000.0), 0), 0)),
                    F.lit("k"))


def thousands(x: Column) -> Column:
    """H9: 1.234.567 with dot thousands and no decimals."""
    return _swap_marks(F.format_number(F.bround(x, 0), 0))


def with_column_accuracy(df: DataFrame, col: str, scale: float, out: str = "accuracy") -> DataFrame:
    """The accuracy that a formatter without one takes from the whole column: a tenth of the power of ten
    of the smallest gap between two values (times ``scale``), ten times that if all last digits are
    zero, never above 1; 1 for equal or nearly equal values.

    ``df`` is an aggregate, one row per label, as its window over the distinct values shows."""
    x = F.round(F.col(col).cast("double") * F.lit(float(scale)), 10)
    values = df.select(x.alias("_x")).filter(F.col("_x").isNotNull()).distinct()
    gaps = values.withColumn("_gap", F.col("_x") - F.lag("_x").over(Window.orderBy("_x")))
    gap = F.col("_least")
    digits = F.lit(1) - F.floor(F.log10(gap))  # as digits after the point, so that powers of ten stay exact
    last = F.pmod(F.bround(F.col("_x") * F.pow(F.lit(10.0), digits), 0), F.lit(10.0))
    zero = (values.withColumn("_least", gaps.agg(F.min("_gap")).scalar())
            .agg(F.max(digits).alias("_digits"), F.bool_and(last == 0).alias("_zero"), F.max(gap).alias("_least")))
    kept = F.greatest(F.when(F.col("_zero"), F.col("_digits") - 1).otherwise(F.col("_digits")), F.lit(0))
    found = F.when(gap.isNull() | (gap < 1.5e-8), F.lit(0)).otherwise(kept)
    return df.withColumn(out, zero.select(found.cast("int")).scalar())


def number(x: Column, digits: Column, scale: float = 1.0, suffix: str = "", marks: bool = False) -> Column:
    """A number with as many decimals as ``digits`` says (0 to 9), half to even; ``marks`` swaps to 1.234,5."""
    scaled = x.cast("double") * F.lit(float(scale))
    out = F.lit(None).cast("string")
    for d in range(9, -1, -1):
        text = F.format_number(F.bround(scaled, d), d)
        out = F.when(digits == d, _swap_marks(text) if marks else F.replace(text, F.lit(","))).otherwise(out)
    return F.concat(out, F.lit(suffix))


def bar_percent(count: Column, total: Column) -> Column:
    """A bar as percent of the total, one decimal."""
    return F.concat(F.replace(F.format_number(F.lit(100.0) * count.cast("double") / total.cast("double"), 1), F.lit(",")), F.lit("%"))


def bar_thousands(count: Column) -> Column:
    """A bar in thousands, two decimals."""
    return F.concat(F.replace(F.format_number(count.cast("double") / F.lit(1000.0), 2), F.lit(",")), F.lit("k"))


def paste(*parts: Column, sep: str = " ") -> Column:
    """H5: R ``paste`` -- NULL pieces print as ``NA``."""
    return F.concat_ws(sep, *[F.coalesce(p.cast("string"), F.lit("NA")) for p in parts])


def count_present(*cols: Column) -> Column:
    """H12 ``one_if_present``: number of non-NULL arguments."""
    total = F.lit(0)
    for c in cols:
        total = total + c.isNotNull().cast("int")
    return total


def names_present(named: dict[str, Column]) -> Column:
    """H13 ``name_if_present``: array of the names whose column is non-NULL, in order."""
    return F.array_compact(F.array(*[F.when(c.isNotNull(), F.lit(n)) for n, c in named.items()]))
