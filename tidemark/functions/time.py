"""Time bucketing for local civil time (``timestamp_ntz``).

``date_trunc`` returns a zoned ``timestamp`` and round-trips through the session
zone; building the bucket from its fields keeps it zone-free.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def hour_of(ts) -> Column:
    """Start of the hour of a ``timestamp_ntz`` (T2 bucket)."""
    ts = _c(ts)
    return F.make_timestamp_ntz(F.year(ts), F.month(ts), F.dayofmonth(ts), F.hour(ts),
                                F.lit(0), F.lit(0))


def day_of(ts) -> Column:
    """Calendar day of a timestamp."""
    return F.to_date(_c(ts))


def epoch_day(d) -> Column:
    """Days since 1970-01-01 as an int; differences are calendar days."""
    return F.unix_date(_c(d))


def is_weekday(d) -> Column:
    """Monday to Friday (``weekday``: Monday = 0 … Sunday = 6)."""
    return F.weekday(_c(d)) < 5
