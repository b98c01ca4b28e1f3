"""Running totals (T1): what a counter rose by, per hour.

A meter shows a total that grows until it restarts: at midnight (a daily total), by a reset, or
never. Two readings bound a rise; a reading below its predecessor starts a new segment, which
has counted up from zero. A rise whose readings are far apart belongs to no single hour: it is
spread over the time between them, or its hours are marked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.time import day_of, epoch_day, hour_of

#: Rises are split in whole millionths, so the shares of a rise add up to it exactly.
UNITS = 1_000_000
GAPS = ("spread", "mark")


def _seconds(ts) -> Column:
    """Seconds of civil time since 1970-01-01T00:00 (whole; zone-free)."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    return epoch_day(day_of(ts)).cast("long") * 86400 + F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)


def meter_rises(readings: DataFrame, time_col: str, value_col: str, by: list[str], daily: bool = True) -> DataFrame:
    """One row per reading: ``by``, day, from_s, to_s (seconds the rise lies between), units (rise in
    millionths), is_reset.

    Readings without a time or value are left out; of several at one time the highest counts. ``daily``: the
    total restarts at midnight, so each day's first reading rose from midnight. Otherwise the counter runs on:
    a day's first reading follows the last one of the latest day before, and the very first rises by nothing.
    Windows hold one key and day, and one row a day: never the whole history of a key."""
    at = (readings.where(F.col(time_col).isNotNull() & F.col(value_col).isNotNull() & ~F.isnan(F.col(value_col).cast("double")))
          .groupBy(*by, F.col(time_col).alias("_t")).agg(F.max(value_col).alias("_v"))
          .select(*by, day_of("_t").alias("_day"), _seconds("_t").alias("to_s"), F.round(F.col("_v") * UNITS).cast("long").alias("_u")))
    w = Window.partitionBy(*by, "_day").orderBy("to_s", "_u")
    seen = at.withColumn("from_s", F.lag("to_s").over(w)).withColumn("_before", F.lag("_u").over(w))
    if daily:
        seen = (seen.withColumn("_before", F.coalesce("_before", F.lit(0)))
                .withColumn("from_s", F.coalesce("from_s", epoch_day("_day").cast("long") * 86400)))
    else:
        ends = at.groupBy(*by, "_day").agg(F.max(F.struct("to_s", "_u")).alias("_end"))
        days = Window.partitionBy(*by).orderBy("_day")
        ends = ends.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(by)], F.col("_day").alias("_kd"), F.lag("_end").over(days).alias("_end"))
        same = [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(by)] + [F.col("_day") == F.col("_kd")]
        on = same[0]
        for c in same[1:]:
            on = on & c
        seen = (seen.join(ends, on, "left").withColumn("_before", F.coalesce("_before", "_end._u"))
                .withColumn("from_s", F.coalesce("from_s", "_end.to_s")))
    reset = F.col("_u") < F.col("_before")
    units = F.when(reset, F.col("_u")).otherwise(F.coalesce(F.col("_u") - F.col("_before"), F.lit(0)))
    return seen.select(*by, F.col("_day").alias("day"), F.coalesce("from_s", "to_s").alias("from_s"), "to_s",
                       units.alias("units"), F.coalesce(reset, F.lit(False)).alias("is_reset"))


def meter_hours(readings: DataFrame, time_col: str = "obs_datetime", value_col: str = "precipitation", by: list[str] | None = None,
                daily: bool = True, gaps: str = "spread", max_gap_minutes: int = 60, max_spread_hours: int = 24 * 31) -> DataFrame:
    """``by``, ``time_col`` (hour), ``value_col`` (rise within the hour, never negative), n_resets, is_estimated.

    A rise over at most ``max_gap_minutes`` counts for the hour of its second reading. Beyond that,
    ``gaps='spread'`` deals it over the hours between in proportion to their time, and marks them estimated;
    ``gaps='mark'`` leaves those hours NULL. A gap of more than ``max_spread_hours`` is always marked, in its last
    hour alone, so one wrong stamp makes no long axis. An hour that no rise reaches has no row. Without a
    reading there is no row."""
    if gaps not in GAPS:
        raise ValueError(gaps)
    by = list(by or [])
    rises = meter_rises(readings, time_col, value_col, by, daily)
    long = F.col("to_s") - F.col("from_s") > max_gap_minutes * 60
    vast = long & (F.col("to_s") - F.col("from_s") > max_spread_hours * 3600)
    last = F.floor(F.col("to_s") / 3600)
    # a reading on the full hour closes the hour before for a spread rise; its first second lies in the next
    spread_to = F.floor((F.col("to_s") - 1) / 3600)
    first = F.when(long & ~vast, F.floor(F.col("from_s") / 3600)).otherwise(last)
    hours = rises.select(*by, "from_s", "to_s", "units", "is_reset", long.alias("long"), vast.alias("vast"),
                         F.explode(F.sequence(first, F.when(long & ~vast, spread_to).otherwise(last))).alias("h"))
    span = F.col("to_s") - F.col("from_s")
    # in whole units: the share up to the hour's end less that up to its start
    until = lambda s: F.floor(F.col("units").cast("decimal(20,0)") * (F.least(F.greatest(s, F.col("from_s")), F.col("to_s")) - F.col("from_s")).cast("decimal(12,0)")
                              / F.nullif(span, F.lit(0)).cast("decimal(12,0)")).cast("long")
    dealt = until((F.col("h") + 1) * 3600) - until(F.col("h") * 3600)
    lost = F.col("vast") | (F.col("long") & F.lit(gaps == "mark"))
    share = F.when(lost, F.lit(None).cast("long")).when(F.col("long"), dealt).otherwise(F.col("units"))
    hour = F.timestamp_add("HOUR", F.pmod(F.col("h"), F.lit(24)).cast("int"), F.date_from_unix_date(F.floor(F.col("h") / 24).cast("int")).cast("timestamp_ntz"))
    out = (hours.select(*by, "h", share.alias("units"), lost.alias("lost"), F.col("long").alias("long"),
                        (F.col("is_reset") & (F.col("h") == F.when(F.col("long") & ~F.col("vast"), spread_to).otherwise(last))).alias("is_reset"))
           .groupBy(*by, "h").agg(F.when(~F.bool_or("lost"), F.sum("units")).alias("units"), F.count_if("is_reset").alias("n_resets"),
                                  F.bool_or("long").alias("is_estimated")))
    return out.select(*by, hour.alias(time_col), (F.col("units") / F.lit(float(UNITS))).alias(value_col), "n_resets", "is_estimated")
