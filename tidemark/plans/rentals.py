"""Topic 1: bike rentals against weather.

Grain: the fact (rentals) is only ever aggregated map-side first (per hour, or per
station and hour class); the weather side is an hourly series, bounded by the
span. No query but J2, which returns them, shuffles raw rental rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.predicates import HEAT_LIMIT_C, is_hot, precip_band
from tidemark.functions.time import hour_of
from tidemark.operators.aggregates import ratio, split_counts
from tidemark.operators.ingest import fill_gaps, hourly_counts, islands
from tidemark.plans.memo import per_tables

HOUR = "obs_datetime"


#: A gap of the weather longer than this ends the period: hours beyond it are not on the axis.
MAX_GAP_HOURS = 24 * 31


def weather_axis(weather: DataFrame) -> DataFrame:
    """T6 + J1 (weather side): every hour of the weather period, first to last
    observed hour; an hour without an observation has NULL weather. A gap of more than
    ``MAX_GAP_HOURS`` is no part of the period: a wrong stamp far off adds its own hour
    alone (``weather_islands`` reports it)."""
    return fill_gaps(weather, HOUR, "1 hour", ["precipitation", "feel_temp"], max_steps=MAX_GAP_HOURS)


def weather_islands(weather: DataFrame) -> DataFrame:
    """The stretches of the weather period that long gaps part."""
    return islands(weather, HOUR, MAX_GAP_HOURS)


def hour_spine(spark: SparkSession, weather: DataFrame) -> DataFrame:
    """Every hour of the weather period."""
    return weather_axis(weather).select(HOUR)


def period_rentals(t) -> DataFrame:
    """Rentals that can meet an observed hour. On tables partitioned by day
    (``rental_date``), whole days outside the weather period are skipped: the
    bounds are a scalar subquery, which Spark applies as a partition filter at run
    time. Without that column the rentals are returned as they are (the hour
    joins drop out-of-period rentals either way)."""
    r = t.rental
    if "rental_date" not in r.columns:
        return r
    b = t.weather.select(F.struct(F.min(HOUR).cast("date").alias("lo"),
                                  F.max(HOUR).cast("date").alias("hi"))).scalar()
    return r.where(F.col("rental_date").between(b["lo"], b["hi"]))


def hourly_rentals(rental: DataFrame) -> DataFrame:
    """(obs_datetime, n_rentals)."""
    return hourly_counts(rental, "rental_time", HOUR, "n_rentals")


def hours_with_rentals(spark: SparkSession, t) -> DataFrame:
    """Every hour of the spine with its weather (NULL if unobserved) and its
    rental count (0 if none). The hour is the kept side of both LEFT joins."""
    r = hourly_rentals(period_rentals(t))
    return (weather_axis(t.weather)
            .join(r, HOUR, "left")
            .select(HOUR, "precipitation", "feel_temp",
                    F.coalesce("n_rentals", F.lit(0)).cast("long").alias("n_rentals")))


def q1a(spark: SparkSession, t) -> DataFrame:
    """1-A: mean rentals per hour by precipitation band (A2 then A1).

    band, n_hours, rentals, avg_rentals. Hours with no rental count as 0;
    unobserved hours form their own band.
    """
    h = hours_with_rentals(spark, t).withColumn("band", precip_band("precipitation"))
    g = h.groupBy("band").agg(F.count("*").alias("n_hours"),
                              F.sum("n_rentals").cast("long").alias("rentals"))
    return g.withColumn("avg_rentals", ratio("rentals", "n_hours"))


BASELINES = ("all", "same_hour")


@per_tables
def hour_classes(t, threshold: float = HEAT_LIMIT_C, baseline: str = "all") -> DataFrame:
    """Observed hours with their heat flag (P2): (obs_datetime, is_hot).

    ``baseline='all'``: every observed hour that is not hot is a normal hour.
    ``'same_hour'``: only normal hours at an hour of day that has a hot hour
    (a left semi join to at most 24 hours of day)."""
    if baseline not in BASELINES:
        raise ValueError(baseline)
    w = t.weather
    hc = w.where(F.col("feel_temp").isNotNull()).select(
        HOUR, is_hot("feel_temp", threshold).alias("is_hot"))
    if baseline == "same_hour":
        hods = hc.where("is_hot").select(F.hour(HOUR).alias("_hod")).distinct()
        hc = hc.join(hods, F.hour(HOUR) == F.col("_hod"), "left_semi")
    return hc


def rentals_in_classes(t, threshold: float = HEAT_LIMIT_C, baseline: str = "all") -> DataFrame:
    """J2 (first half): rentals joined to their hour's class. Rentals in an
    unobserved hour have no class and drop out. The class table (one row per hour) is
    broadcast where its size allows; beyond that, rentals are shuffled by hour."""
    r = period_rentals(t).withColumn(HOUR, hour_of("rental_time"))
    return r.join(hour_classes(t, threshold, baseline), HOUR)


def station_heat_counts(t, threshold: float = HEAT_LIMIT_C, baseline: str = "all") -> DataFrame:
    """A3: per station, rentals in hot and in normal hours (one conditional pass).
    Rentals are counted per station and hour first: whatever way the classes join, no raw
    rental is shuffled, and an hour's or a station's many rentals are one row per task."""
    per_hour = (period_rentals(t).groupBy(F.col("rental_station_id").alias("station_id"),
                                          hour_of("rental_time").alias(HOUR))
                .agg(F.count("*").alias("_n")))
    return split_counts(per_hour.join(hour_classes(t, threshold, baseline), HOUR), "station_id",
                        "is_hot", "hot_rentals", "normal_rentals", weight="_n")


@per_tables
def exposure(t, threshold: float = HEAT_LIMIT_C, baseline: str = "all") -> tuple:
    """A7 denominators as scalar subqueries: number of hot and of normal hours."""
    hc = hour_classes(t, threshold, baseline)
    tot = hc.select(F.struct(F.count_if("is_hot").alias("hot"),
                             F.count_if(~F.col("is_hot")).alias("normal"))).scalar()
    return tot["hot"], tot["normal"]


def station_drop(spark: SparkSession, t, threshold: float = HEAT_LIMIT_C,
                 baseline: str = "all") -> DataFrame:
    """1-B before ranking: per station, rate per hot hour, rate per normal hour,
    drop = normal rate - hot rate, pct_drop = drop / normal rate.

    Stations come from the rentals (aggregated first) and are then joined to the
    master for their name (J2, second half). A station with no rental in the heat
    keeps a hot rate of 0: the conditional aggregate runs over all observed hours,
    not over an inner join to hot hours.
    """
    n_hot, n_normal = exposure(t, threshold, baseline)
    c = station_heat_counts(t, threshold, baseline)
    m = t.rental_station.select("station_id", "station_name")
    # The totals enter once, as columns; the rates are derived from the columns.
    j = c.join(m, "station_id").select(
        "station_id", "station_name",
        n_hot.alias("n_hot_hours"), n_normal.alias("n_normal_hours"),
        "hot_rentals", "normal_rentals")
    hot_rate = ratio("hot_rentals", "n_hot_hours")
    normal_rate = ratio("normal_rentals", "n_normal_hours")
    return j.select("*", hot_rate.alias("hot_rate"), normal_rate.alias("normal_rate")) \
            .select("*", (F.col("normal_rate") - F.col("hot_rate")).alias("rate_drop")) \
            .select("*", (F.col("rate_drop") * 100.0
                          / F.nullif(F.col("normal_rate"), F.lit(0.0))).alias("pct_drop"))


def q1b(spark: SparkSession, t, threshold: float = HEAT_LIMIT_C, k: int = 5,
        order_by: str = "rate_drop", baseline: str = "all") -> DataFrame:
    """1-B: the ``k`` stations whose rentals fall most in hot hours.

    ``order_by``: ``rate_drop`` (rentals per hour lost) or ``pct_drop`` (share
    lost; stations with no normal-hour rental have none and sort last).
    ``baseline``: see ``hour_classes``.
    Empty when the period has no hot hour (a drop needs a hot hour to exist).
    Ties: station_id ascending.
    """
    if order_by not in ("rate_drop", "pct_drop"):
        raise ValueError(order_by)
    d = station_drop(spark, t, threshold, baseline).where(F.col("n_hot_hours") > 0)
    return d.orderBy(F.col(order_by).desc_nulls_last(), F.col("station_id").asc()).limit(k)


def class_rates(t, threshold: float = HEAT_LIMIT_C) -> DataFrame:
    """Rentals per exposed hour for hot and normal hours over all stations.
    hour_class, n_hours, rentals, rate."""
    hc = hour_classes(t, threshold)
    hours = hc.groupBy("is_hot").agg(F.count("*").alias("n_hours"))
    rentals = hourly_rentals(period_rentals(t))
    per = (hc.join(rentals, HOUR, "left")
             .groupBy("is_hot").agg(F.coalesce(F.sum("n_rentals"), F.lit(0)).cast("long")
                                    .alias("rentals")))
    j = hours.join(per, "is_hot")
    return j.select(F.when(F.col("is_hot"), F.lit("hot")).otherwise(F.lit("normal"))
                    .alias("hour_class"), "n_hours", "rentals",
                    ratio("rentals", "n_hours").alias("rate"))


def top_stations(t, k: int = 5) -> DataFrame:
    """L1 as a generic top-k: the ``k`` stations with most rentals (ties by id)."""
    c = t.rental.groupBy(F.col("rental_station_id").alias("station_id")) \
                .agg(F.count("*").alias("n_rentals"))
    return c.orderBy(F.col("n_rentals").desc(), F.col("station_id").asc()).limit(k)
