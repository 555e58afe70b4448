"""R-style aggregates without ``na.rm`` (trap S4): NULL when any input is NULL.

Spark's aggregates skip NULLs, as R does with ``na.rm = TRUE``.  Where the
reference calls ``sum``/``max``/``min`` without it, these give its result on
request; the default everywhere stays Spark's.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strict(agg, col: str) -> Column:
    """``agg(col)`` if no value of the group is NULL, else NULL."""
    return F.when(F.count(col) == F.count(F.lit(1)), agg(col))


def strict_sum(col: str) -> Column:
    return strict(F.sum, col)


def strict_max(col: str) -> Column:
    return strict(F.max, col)


def strict_min(col: str) -> Column:
    return strict(F.min, col)
