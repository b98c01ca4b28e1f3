"""Ingest transforms: roll-ups, bucketing, masters, typing, overlap, spines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import (DateType, FractionalType, StructType, TimestampNTZType,
                               TimestampType, NumericType)
from pyspark.sql.window import Window

from tidemark.functions.time import hour_of
from tidemark.operators.meter import meter_hours


def hourly_weather(minute: DataFrame, time_col: str = "obs_datetime",
                   precip_mode: str = "increment", by: list[str] | None = None,
                   feel: str = "max", gaps: str = "spread") -> DataFrame:
    """Per-minute observations to one row per hour.

    precipitation: ``increment`` sums minute amounts; ``cumulative`` treats the
    column as a running daily total (``operators.meter``): the rise within the hour, a
    reset starting again from zero, and a rise over missing time dealt over the hours
    it spans (``gaps='spread'``, which adds those hours with n_obs 0) or those hours
    left NULL (``gaps='mark'``). feel_temp: maximum over the hour (``feel='mean'``: the mean).
    temperature, humidity: mean. n_obs: minutes seen.
    A column that is NULL in every minute of an hour stays NULL. Minutes without a time
    belong to no hour and are left out. ``by``: keys such as the station; without it,
    ``minute`` must hold one station.
    """
    by = list(by or [])
    minute = minute.where(F.col(time_col).isNotNull())
    h = hour_of(time_col).alias(time_col)
    if feel not in ("max", "mean"):
        raise ValueError(feel)
    aggs = [(F.max if feel == "max" else F.avg)("feel_temp").alias("feel_temp"),
            F.count("*").alias("n_obs")]
    aggs += [F.avg(c).alias(c) for c in ("temperature", "humidity") if c in minute.columns]
    if precip_mode == "increment":
        aggs.insert(0, F.sum("precipitation").alias("precipitation"))
        return minute.groupBy(*by, h).agg(*aggs)
    if precip_mode != "cumulative":
        raise ValueError(f"precip_mode: {precip_mode}")
    hourly = minute.groupBy(*by, h).agg(*aggs)
    rises = meter_hours(minute, time_col, "precipitation", by, gaps=gaps).select(*by, time_col, "precipitation")
    # Both sides have one row per key and hour; an hour may stand in one of them alone.
    rest = [c for c in hourly.columns if c not in (*by, time_col)]
    both = hourly.unionByName(rises, allowMissingColumns=True).groupBy(*by, time_col)
    return (both.agg(F.max("precipitation").alias("precipitation"), *[F.max(c).alias(c) for c in rest])
            .withColumn("n_obs", F.coalesce("n_obs", F.lit(0).cast("long"))))


def hourly_counts(fact: DataFrame, time_col: str, out_time: str = "obs_datetime",
                  count_name: str = "n_rentals", by: list[str] | None = None) -> DataFrame:
    """Events per hour (partial + final hash aggregate; a hot hour is combined
    map-side before the shuffle)."""
    by = list(by or [])
    return fact.groupBy(*by, hour_of(time_col).alias(out_time)).agg(F.count("*").alias(count_name))


def station_master(fact: DataFrame, id_col: str, time_col: str,
                   attrs: list[str] | None = None, order_col: str | None = None,
                   out_id: str = "station_id") -> DataFrame:
    """One row per station derived from a fact; for each attribute the latest
    value wins (by ``order_col``, default the time column)."""
    order = F.col(order_col or time_col)
    aggs = [F.min(time_col).alias("first_seen"), F.max(time_col).alias("last_seen"),
            F.count("*").alias("n_rows")]
    aggs += [F.max_by(a, order).alias(a) for a in (attrs or [])]
    return fact.groupBy(F.col(id_col).alias(out_id)).agg(*aggs)


# Date forms read when no format is named; all start with a four-digit year.
DATE_FORMATS = ("yyyy-MM-dd", "yyyyMMdd", "yyyy.MM.dd", "yyyy/MM/dd")


def typed(df: DataFrame, schema: StructType, timestamp_format: str | None = None,
          date_format: str | None = None, lost: str | None = None) -> DataFrame:
    """T4: text columns to the schema's types. Blank cells become NULL; a value that
    does not parse becomes NULL (``try_*``), never 0 and never an error. ``lost`` names
    an added column: the names of the row's cells that held text but became NULL."""
    cols, gone = [], []
    for f in schema.fields:
        if f.name not in df.columns:
            cols.append(F.lit(None).cast(f.dataType).alias(f.name))
            continue
        raw = F.nullif(F.trim(F.col(f.name).cast("string")), F.lit(""))
        t = f.dataType
        if isinstance(t, TimestampNTZType):
            v = _to_ntz(raw, timestamp_format)
        elif isinstance(t, TimestampType):
            v = F.try_to_timestamp(raw, F.lit(timestamp_format)) if timestamp_format \
                else F.try_to_timestamp(raw)
        elif isinstance(t, DateType):
            v = F.coalesce(*[F.try_to_date(raw, f) for f in
                             ([date_format] if date_format else DATE_FORMATS)])
        elif isinstance(t, NumericType):
            v = F.regexp_replace(raw, ",", "").try_cast(t)
            if isinstance(t, FractionalType):     # text such as NaN or Infinity is no reading
                d = v.cast("double")
                v = F.when(~F.isnan(d) & (F.abs(d) < F.lit(float("inf"))), v)
        else:
            v = raw.try_cast(t)
        cols.append(v.alias(f.name))
        gone.append(F.when(raw.isNotNull() & v.isNull(), F.lit(f.name)))
    if lost:
        cols.append(F.array_compact(F.array(*gone)).alias(lost))
    return df.select(*cols)


def _to_ntz(raw: Column, fmt: str | None) -> Column:
    """Local civil time; unparseable text becomes NULL."""
    if fmt:
        # Parsed and cast in the session zone, so the wall-clock value is kept.
        return F.try_to_timestamp(raw, F.lit(fmt)).cast("timestamp_ntz")
    # Only a four-digit year: 202605 is no timestamp of the year 202605.
    return F.when(raw.rlike(r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}([ T]|$)"),
                  raw.try_cast("timestamp_ntz"))


def overlap(a: DataFrame, a_col: str, b: DataFrame, b_col: str) -> DataFrame:
    """T5: the common period of two series as one row (lo, hi); lo > hi means none."""
    ra = a.agg(F.min(a_col).alias("lo"), F.max(a_col).alias("hi"))
    rb = b.select(F.struct(F.min(b_col).alias("lo"), F.max(b_col).alias("hi"))).scalar()
    return ra.select(F.greatest(F.col("lo"), rb["lo"]).alias("lo"),
                     F.least(F.col("hi"), rb["hi"]).alias("hi"))


def islands(times: DataFrame, time_col: str, max_gap_hours: int) -> DataFrame:
    """The stretches of hours in which no two neighbours lie more than ``max_gap_hours`` apart, as rows
    (lo, hi, n_hours, n_seen): first and last hour, hours from one to the other, hours seen.

    Rows are first reduced to distinct hours per month; only those neighbours that may be apart, and the ends of
    months, meet in one window: a time-grain series, never a fact. Rows without a time are left out."""
    seen = times.where(F.col(time_col).isNotNull()).select(hour_of(time_col).alias("_h")).distinct()
    seen = seen.withColumn("_n", F.unix_date(F.to_date("_h")).cast("long") * 24 + F.hour("_h"))
    seen = seen.withColumn("_m", F.year("_h") * 12 + F.month("_h"))
    month = Window.partitionBy("_m").orderBy("_n")
    apart = F.col("_n") - F.lag("_n").over(month) > max_gap_hours
    # runs within a month
    runs = (seen.withColumn("_cut", F.coalesce(apart, F.lit(False)).cast("int"))
            .withColumn("_run", F.sum("_cut").over(month))
            .groupBy("_m", "_run").agg(F.min("_n").alias("_lo"), F.max("_n").alias("_hi"), F.count("*").alias("n_seen")))
    # runs of neighbouring months that are near belong together: one row per run
    line = Window.partitionBy().orderBy("_lo")
    cut = F.coalesce(F.col("_lo") - F.lag("_hi").over(line) > max_gap_hours, F.lit(True)).cast("int")
    joined = (runs.withColumn("_cut", cut).withColumn("_island", F.sum("_cut").over(line))
              .groupBy("_island").agg(F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi"), F.sum("n_seen").alias("n_seen")))
    hour = lambda c: F.timestamp_add("HOUR", F.pmod(F.col(c), F.lit(24)).cast("int"),
                                     F.date_from_unix_date(F.floor(F.col(c) / 24).cast("int")).cast("timestamp_ntz"))
    return joined.select(hour("_lo").alias("lo"), hour("_hi").alias("hi"), (F.col("_hi") - F.col("_lo") + 1).alias("n_hours"), "n_seen")


#: Hours of one piece of an island's axis: long islands are dealt over tasks.
PIECE_HOURS = 24 * 31


def island_axis(stretches: DataFrame, name: str) -> DataFrame:
    """Every hour of every island (rows lo, hi), in pieces of bounded length."""
    piece, one = F.expr(f"INTERVAL {PIECE_HOURS} HOURS"), F.expr("INTERVAL 1 HOUR")
    pieces = stretches.select("hi", F.explode(F.sequence("lo", "hi", piece)).alias("_at")).hint("rebalance")
    return pieces.select(F.explode(F.sequence("_at", F.least(F.col("hi"), F.col("_at") + piece - one), one)).alias(name))


def spine(spark: SparkSession, lo: Column, hi: Column, step: str, name: str) -> DataFrame:
    """Every point from ``lo`` to ``hi`` (inclusive) at ``step`` ("1 hour", "1 day").

    ``lo``/``hi`` are usually scalar subqueries over the data, so the spine follows
    the data's span. A NULL bound gives no points.
    """
    seq = spark.range(1).select(F.sequence(lo, hi, F.expr(f"INTERVAL {step}")).alias("_s"))
    return seq.select(F.explode("_s").alias(name))


def fill_gaps(series: DataFrame, time_col: str, step: str, values: list[str],
              until=None, out: str | None = None, source_col: str | None = None,
              max_steps: int | None = None) -> DataFrame:
    """T6 + J7 in one pass: the complete axis of a series, gaps included.

    Each observation is expanded to every point up to the next observation (the
    last one up to ``until`` if given). ``values`` are carried into the gap
    (backward as-of: the last known value) and ``source_col`` names the column
    holding the observation time they come from. Without ``source_col`` the gap
    rows get NULL values instead (a plain spine left-joined to the series).

    ``max_steps``: a gap of more steps is not filled; the point before it stands alone.

    The series is ordered in one window partition: it must be a time-grain series
    (one row per hour or day of its span), never a fact. Rows without a time have no
    place on the axis and are left out.
    """
    out = out or time_col
    w = Window.partitionBy().orderBy(time_col)
    series = series.where(F.col(time_col).isNotNull()).withColumn("_next", F.lead(time_col).over(w))
    one = F.expr(f"INTERVAL {step}")
    last = F.col("_next") - one
    if until is not None:
        last = F.coalesce(last, F.greatest(F.col(time_col), until))
    else:
        last = F.coalesce(last, F.col(time_col))
    # A duplicated time (a key violation Q1 reports) must not run the sequence
    # backwards: each duplicate then yields just its own point.
    last = F.greatest(last, F.col(time_col))
    if max_steps is not None:
        last = F.when(last < F.col(time_col) + F.expr(f"INTERVAL {step}") * max_steps, last).otherwise(F.col(time_col))
    gap = F.sequence(F.col(time_col), last, one)
    ex = series.select(time_col, *values, F.explode(gap).alias("_t"))
    if source_col:
        cols = [F.col(v) for v in values] + [F.col(time_col).alias(source_col)]
    else:
        cols = [F.when(F.col("_t") == F.col(time_col), F.col(v)).alias(v) for v in values]
    return ex.select(F.col("_t").alias(out), *cols)
