"""The reference's six tables, derived by Spark from the driver's Parquet tables.

The reference's own data files are not available; these stand-ins follow the
mapping in FIXTURES.md §3 and keep the reference's table and column names, so the
query code is the same for real ingested tables (see ``sources.files``) and for
the stand-ins. Every stand-in is a lazy DataFrame over the full input tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.time import day_of, hour_of, is_weekday

# Fixed values of the stand-in mapping (FIXTURES.md §3).
RENTAL_EVENT_TYPE = "click"
OIL_EVENT_TYPE = "purchase"
PRECIP_FROM = 50.0     # precipitation = 0 if v1 < 50 else (v1 - 50) / 5
PRECIP_SCALE = 5.0
FEEL_SCALE = 2.0       # feel_temp = v2 / 2


# Schemas of the driver's input tables used here (read with a fixed schema: no
# footer-sampling job and no drift if a file changes).
INPUT_SCHEMAS = {
    "events": "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, "
              "value DOUBLE, props STRING",
    "customer": "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, "
                "c_mktsegment STRING",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    r = spark.read
    if name in INPUT_SCHEMAS:
        r = r.schema(INPUT_SCHEMAS[name])
    return r.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


def rental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rental(rental_id, rental_station_id, rental_time): the click events."""
    return (events(spark, sf_dir)
            .where(F.col("event_type") == RENTAL_EVENT_TYPE)
            .select(F.col("event_id").alias("rental_id"),
                    F.col("user_id").cast("string").alias("rental_station_id"),
                    F.col("ts").alias("rental_time")))


def rental_station(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (table(spark, sf_dir, "customer")
            .select(F.col("c_custkey").cast("string").alias("station_id"),
                    F.col("c_name").alias("station_name")))


def weather(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly weather(obs_datetime, precipitation, feel_temp).

    One observation per hour (the first and the last event of the hour by id), so
    the spread of the bands is the same at every scale. Hours without an event are
    absent here and become NULL on the hour spine.
    """
    hourly = (events(spark, sf_dir)
              .groupBy(hour_of("ts").alias("obs_datetime"))
              .agg(F.min_by("value", "event_id").alias("v1"),
                   F.max_by("value", "event_id").alias("v2")))
    return hourly.select(
        "obs_datetime",
        F.when(F.col("v1") < PRECIP_FROM, F.lit(0.0))
         .otherwise((F.col("v1") - PRECIP_FROM) / PRECIP_SCALE).alias("precipitation"),
        (F.col("v2") / FEEL_SCALE).alias("feel_temp"))


def exact_mean(c: str):
    """Mean of a column holding whole cents (every test value has two decimals):
    integer cents are summed exactly and divided once, so the result does not
    depend on summation order (it is the same double on any engine)."""
    cents = F.round(F.col(c) * 100).cast("long")
    return F.sum(cents).cast("double") / (F.count(c).cast("double") * 100.0)


def gas_station(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (table(spark, sf_dir, "customer")
            .select(F.col("c_custkey").cast("string").alias("station_id"),
                    F.col("c_mktsegment").alias("brand")))


def gas_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily station price: mean event value per user and day (a ragged panel)."""
    return (events(spark, sf_dir)
            .groupBy(F.col("user_id").cast("string").alias("station_id"),
                     day_of("ts").alias("price_date"))
            .agg(exact_mean("value").alias("price")))


def brand_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The brand recorded beside each station price: the type of the user's last event of
    the day, so stations change their brand often."""
    return (events(spark, sf_dir)
            .groupBy(F.col("user_id").cast("string").alias("station_id"),
                     day_of("ts").alias("price_date"))
            .agg(F.max_by("event_type", "event_id").alias("brand")))


def oil_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily crude prices on weekdays only (trading days).

    dubai = mean, brent = max, wti = min of the day's purchase values.
    """
    p = events(spark, sf_dir).where(F.col("event_type") == OIL_EVENT_TYPE)
    return (p.where(is_weekday(F.col("ts")))
            .groupBy(day_of("ts").alias("price_date"))
            .agg(exact_mean("value").alias("dubai"), F.max("value").alias("brent"),
                 F.min("value").alias("wti")))


STANDINS = {
    "rental": rental,
    "rental_station": rental_station,
    "weather": weather,
    "gas_station": gas_station,
    "gas_price": gas_price,
    "brand_days": brand_days,
    "oil_price": oil_price,
}


class Tables:
    """Access to the six tables of one dataset (stand-ins over ``sf_dir``)."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self._memo: dict[str, DataFrame] = {}

    def period(self, name: str, time_col: str) -> DataFrame:
        """(lo, hi) of a table's days as one row, read from the times its rows are made of: one column of
        the source, no aggregate by station and day."""
        if name != "gas_price":
            df = getattr(self, name)
            return df.agg(F.min(time_col).alias("lo"), F.max(time_col).alias("hi"))
        times = events(self.spark, self.sf_dir).agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"))
        return times.select(day_of("lo").alias("lo"), day_of("hi").alias("hi"))

    def __getattr__(self, name):
        # One DataFrame object per table: the files are listed once and every
        # use of a table is the same plan, so Spark can reuse its exchanges.
        if name.startswith("_") or name not in STANDINS:
            raise AttributeError(name)
        if name not in self._memo:
            self._memo[name] = STANDINS[name](self.spark, self.sf_dir)
        return self._memo[name]
