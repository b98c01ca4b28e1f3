"""Dated masters: the stretches of days on which a station's attributes hold (T3 over
time) and the join of a fact to the stretch in force on its day (J3 as of a day)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def versions(fact: DataFrame, id_col: str, date_col: str, attrs: list[str],
             out_id: str = "station_id", open_start: bool = True) -> DataFrame:
    """T3 over time: out_id, the attributes, ``valid_from`` and ``valid_to`` (exclusive;
    NULL: still in force), one row per stretch of recorded days with the same values.

    Days between two records belong to the earlier one. A day recorded several times
    counts once, with its greatest values; rows without a station, a day or any value
    tell nothing. With ``open_start`` a station's first stretch has no start
    (``valid_from`` NULL), so facts from before its first record find a version.
    The fact is reduced to station-days before the shuffle; both windows share one."""
    told = fact.where(F.col(id_col).isNotNull() & F.col(date_col).isNotNull()
                      & F.coalesce(*[F.col(a).cast("string") for a in attrs]).isNotNull())
    days = told.groupBy(F.col(id_col).alias(out_id), F.col(date_col).alias("_d")) \
               .agg(F.max(F.struct(*attrs)).alias("_v"))
    w = Window.partitionBy(out_id).orderBy("_d")
    days = days.withColumns({"_prev": F.lag("_v").over(w), "_first": F.row_number().over(w) == 1})
    starts = days.where(F.col("_first") | ~F.col("_v").eqNullSafe(F.col("_prev")))
    starts = starts.withColumn("valid_to", F.lead("_d").over(w))
    since = F.when(~F.col("_first"), F.col("_d")) if open_start else F.col("_d")
    return starts.select(out_id, *[F.col("_v")[a].alias(a) for a in attrs],
                         since.alias("valid_from"), "valid_to")


def in_force(day, valid_from="valid_from", valid_to="valid_to"):
    """Whether a version holds on a day."""
    f, t = F.col(valid_from), F.col(valid_to)
    return (f.isNull() | (F.col(day) >= f)) & (t.isNull() | (F.col(day) < t))


def join_in_force(fact: DataFrame, dim: DataFrame, key: str, date_col: str, attrs: list[str],
                  how: str = "inner") -> DataFrame:
    """J3 as of a day: the fact's rows with the attributes in force on their day. An equi
    join on the station with the stretch as a further condition; a station's stretches do
    not overlap, so a row meets one at most. ``how='left'`` keeps rows without a version."""
    if how not in ("inner", "left"):
        raise ValueError(how)
    d = dim.select(F.col(key).alias("_key"), F.struct(*attrs).alias("_v"), "valid_from", "valid_to")
    f = fact.select(F.col(key).alias("_k"), F.col(date_col).alias("_day"), F.struct("*").alias("_row"))
    on = (F.col("_k") == F.col("_key")) & in_force("_day")
    return f.join(d, on, how).select("_row.*", *[F.col("_v")[a].alias(a) for a in attrs])


def split_by_version(spans: DataFrame, dim: DataFrame, key: str, attrs: list[str],
                     first: str = "_s", last: str = "_e") -> DataFrame:
    """Spans of days (``first`` to ``last``, both inclusive) cut at the days on which the
    station's attributes change: one row per span and version that meet."""
    d = dim.select(key, *attrs, "valid_from", F.date_sub("valid_to", 1).alias("_until"))
    # greatest/least skip NULLs: an open end leaves the span's own.
    cut = spans.join(d, key).withColumns({first: F.greatest(first, "valid_from"),
                                          last: F.least(last, "_until")})
    return cut.where(F.col(first) <= F.col(last)).drop("valid_from", "_until")
