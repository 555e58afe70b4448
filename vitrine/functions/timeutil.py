"""Zone-free microsecond arithmetic for ``timestamp_ntz`` values.

Casting a ``timestamp_ntz`` to ``timestamp`` (or ``unix_micros``/``timestamp_diff``
on it) goes through the session time zone: wall times inside a daylight-saving
gap move and the mapping is no longer monotone.  These helpers use only the
calendar fields, so they are exact and monotone in any session.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_DAY = 86_400_000_000


def ntz_to_micros(ts: Column) -> Column:
    """Microseconds since 1970-01-01 00:00:00 of a zone-less timestamp."""
    days = F.date_diff(F.to_date(ts), F.lit("1970-01-01").cast("date")).cast("bigint")
    secs = F.extract(F.lit("SECOND"), ts)  # seconds with microseconds, decimal(8,6)
    return (days * F.lit(_DAY) + F.hour(ts).cast("bigint") * F.lit(3_600_000_000)
            + F.minute(ts).cast("bigint") * F.lit(60_000_000) + (secs * F.lit(1_000_000)).cast("bigint"))


def micros_to_ntz(us: Column) -> Column:
    """Inverse of ``ntz_to_micros``."""
    days = F.floor(us / F.lit(_DAY))
    rem = us - days * F.lit(_DAY)
    day = F.date_add(F.lit("1970-01-01").cast("date"), days.cast("int"))
    hours = F.floor(rem / F.lit(3_600_000_000))
    minutes = F.floor((rem - hours * F.lit(3_600_000_000)) / F.lit(60_000_000))
    micros = rem - hours * F.lit(3_600_000_000) - minutes * F.lit(60_000_000)
    return F.make_timestamp_ntz(F.year(day), F.month(day), F.dayofmonth(day), hours.cast("int"),
                                minutes.cast("int"), (micros.cast("decimal(16,0)") / F.lit(1_000_000)).cast("decimal(16,6)"))
