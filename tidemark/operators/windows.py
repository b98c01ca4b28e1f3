"""Window operators over daily series and panels.

A series with no key (one crude, one weather station) is ordered in a single
window partition. That is only ever done on a time-grain series (one row per
trading day), never on a fact; panels are always partitioned by their key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.predicates import delta
from tidemark.functions.time import epoch_day

MILLION = 1_000_000.0     # units of a moving average's sums


def _w(by, order):
    w = Window.partitionBy(*by) if by else Window.partitionBy()
    return w.orderBy(order)


def with_lag(df: DataFrame, value: str, order: str, by: list[str] | None = None,
             prefix: str = "prev_") -> DataFrame:
    """Previous *recorded* row (not the previous calendar day).

    Adds ``prev_<value>``, ``prev_<order>``, ``gap_days`` (calendar days to the
    previous row) and ``change``. A ragged panel keeps its gaps visible. Rows without
    an ``order`` value are left out: they are no one's previous row.
    """
    df = df.where(F.col(order).isNotNull())
    w = _w(by or [], order)
    prev_v, prev_o = F.lag(value).over(w), F.lag(order).over(w)
    # One projection; Spark evaluates both lags in a single Window operator.
    return df.withColumns({prefix + value: prev_v, prefix + order: prev_o,
                           "gap_days": F.datediff(F.col(order), prev_o),
                           "change": delta(value, prev_v)})


def moving_average(df: DataFrame, value: str, order: str, n: int = 5,
                   by: list[str] | None = None, frame: str = "rows",
                   require_full: bool = False, out: str = "ma") -> DataFrame:
    """Moving average of the last ``n`` rows (``frame='rows'``) or of the last
    ``n`` calendar days (``frame='range'``, gaps are not filled).

    Leading rows use a partial frame as plain SQL does; ``require_full`` makes
    them NULL instead. Values are summed as whole millionths, so frames of equal content
    have equal averages in any order (a phase compares them exactly); a value beyond
    9e12 has no such form and counts as missing.
    """
    base = _w(by or [], order)
    if frame == "rows":
        w = base.rowsBetween(-(n - 1), 0)
    elif frame == "range":
        w = (Window.partitionBy(*(by or [])).orderBy(epoch_day(order))
             .rangeBetween(-(n - 1), 0))
    else:
        raise ValueError(frame)
    units = F.round(F.col(value) * MILLION).try_cast("long")
    ma = F.sum(units).over(w).cast("double") / (F.count(units).over(w).cast("double") * MILLION)
    if require_full:
        if frame == "rows":
            full = F.count(value).over(w) == n
        else:
            first = F.first(order).over(base.rowsBetween(Window.unboundedPreceding, 0))
            full = F.datediff(F.col(order), first) >= n - 1
        ma = F.when(full, ma)
    return df.withColumn(out, ma)
