"""Registry: one callable ``(spark, sf_dir) -> DataFrame`` per operator key.

mapping (``sources.testdata``), so its work grows with them.
"""

from __future__ import annotations

import weakref
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, DoubleType, LongType, StructField, StructType

from tidemark.operators import quality
from tidemark.operators.ingest import hourly_weather, islands, station_master, typed
from tidemark.operators.meter import meter_hours
from tidemark.operators.windows import moving_average
from tidemark.plans import prices, rentals
from tidemark.schemas import FOREIGN_KEYS, PRIMARY_KEYS
from tidemark.sources.testdata import RENTAL_EVENT_TYPE, Tables, events, table

Query = Callable[[SparkSession, str], DataFrame]


# One Tables object per (session, dataset folder), as a user defines their tables
# once and runs many queries on them: files are listed once per session and the
# stand-in DataFrames (immutable) are shared by every query.
_TABLES: "weakref.WeakKeyDictionary[SparkSession, dict[str, Tables]]" = weakref.WeakKeyDictionary()


def _t(spark, d) -> Tables:
    per = _TABLES.setdefault(spark, {})
    if d not in per:
        per[d] = Tables(spark, d)
    return per[d]


def q1a(spark, d):
    return rentals.q1a(spark, _t(spark, d))


def q1b(spark, d):
    return rentals.q1b(spark, _t(spark, d))


def q2a(spark, d):
    return prices.q2a(spark, _t(spark, d))


def q2a_crudes(spark, d):
    return prices.q2a_crudes(spark, _t(spark, d))


def q2b(spark, d):
    return prices.q2b(spark, _t(spark, d))


def q2a_dated(spark, d):
    return prices.q2a_dated(spark, _t(spark, d))


def a4_waits(spark, d):
    return prices.q2a_waits(spark, _t(spark, d))


def a4_curve(spark, d):
    return prices.wait_curve(spark, _t(spark, d))


def t3_versions(spark, d):
    return prices.station_brands(_t(spark, d))


def j3_dated(spark, d):
    return prices.station_with_dated_brand(_t(spark, d))


def t1_weather(spark, d):
    return _t(spark, d).weather


def t1_increment(spark, d):
    """Every event as one observation at its time; the event type names the station."""
    obs = events(spark, d).select(
        F.col("event_type").alias("station_id"), F.col("ts").alias("obs_datetime"),
        F.col("value").alias("precipitation"), (F.col("value") / 2).alias("feel_temp"),
        F.col("value").alias("temperature"))
    return hourly_weather(obs, "obs_datetime", by=["station_id"])


def t1_cumulative(spark, d):
    """Every event as a reading of a daily total: a smaller value than the one before is a reset."""
    obs = events(spark, d).select(F.col("event_type").alias("station_id"), F.col("ts").alias("obs_datetime"),
                                  F.col("value").alias("precipitation"))
    return meter_hours(obs, by=["station_id"])


def t6_islands(spark, d):
    """Stretches of hours with errors, parted where more than six hours hold none."""
    return islands(events(spark, d).where(F.col("event_type") == "error"), "ts", 6)


def t4_typed(spark, d):
    """Every event written as text cells (blank, not a number, negative, malformed, grouped
    digits; dates in four forms, one of them short) and typed again."""
    i, cents = F.col("event_id"), F.round(F.col("value") * 100).cast("long").cast("string")
    price = (F.when(i % 6 == 0, "  ").when(i % 6 == 1, "NaN").when(i % 6 == 2, F.concat(F.lit("-"), cents))
             .when(i % 6 == 3, "n/a").when(i % 6 == 4, " 1,234.50 ").otherwise(cents))
    day = (F.when(i % 4 == 0, F.date_format("ts", "yyyyMMdd")).when(i % 4 == 1, F.date_format("ts", "yyyy.MM.dd"))
           .when(i % 4 == 2, F.date_format("ts", "yyyyMM")).otherwise(F.date_format("ts", "yyyy-MM-dd")))
    raw = events(spark, d).select(i.cast("string").alias("event_id"), price.alias("price"),
                                  day.alias("price_date"))
    schema = StructType([StructField("event_id", LongType()), StructField("price", DoubleType()),
                         StructField("price_date", DateType())])
    return typed(raw, schema, lost="_lost").select("event_id", "price", "price_date",
                                                   F.size("_lost").alias("n_lost"))


def q1_dups(spark, d):
    """Users with several events of a type, as violations of the key (user, type)."""
    return quality.pk_violations(events(spark, d), ["user_id", "event_type"])


def q2_orphans(spark, d):
    """Customers whom no rental names, as orphans of that relation."""
    clicks = events(spark, d).where(F.col("event_type") == RENTAL_EVENT_TYPE)
    return quality.fk_orphans(table(spark, d, "customer"), "c_custkey", clicks, "user_id") \
        .select("c_custkey", "c_name")


def t2_hourly(spark, d):
    return rentals.hourly_rentals(_t(spark, d).rental)


def t3_master(spark, d):
    clicks = (events(spark, d).where(F.col("event_type") == RENTAL_EVENT_TYPE)
              .withColumn("station_id", F.col("user_id").cast("string")))
    return station_master(clicks, "station_id", "ts", attrs=["props"], order_col="event_id")


def t5_overlap(spark, d):
    return prices.common_period(_t(spark, d))


def t6_spine(spark, d):
    return rentals.hour_spine(spark, _t(spark, d).weather)


def q1_pk(spark, d):
    t = _t(spark, d)
    return quality.pk_summary({n: (getattr(t, n), k) for n, k in PRIMARY_KEYS.items()})


def q2_fk(spark, d):
    t = _t(spark, d)
    return quality.fk_summary({f"{f}.{fk}->{dim}.{pk}": (getattr(t, f), fk, getattr(t, dim), pk)
                               for f, fk, dim, pk in FOREIGN_KEYS})


def q3_audit(spark, d):
    t = _t(spark, d)
    return quality.count_audit({"rental": (t.rental, "rental_time"),
                                "weather": (t.weather, "obs_datetime"),
                                "oil_price": (t.oil_price, "price_date"),
                                "gas_price": (t.gas_price, "price_date")})


def p1_band(spark, d):
    from tidemark.functions.predicates import precip_band
    h = rentals.hours_with_rentals(spark, _t(spark, d))
    return h.select("obs_datetime", "precipitation", precip_band("precipitation").alias("band"))


def p2_heat(spark, d):
    from tidemark.functions.predicates import is_hot
    w = _t(spark, d).weather
    return w.select("obs_datetime", "feel_temp", is_hot("feel_temp").alias("is_hot"))


def p3_phase(spark, d):
    return prices.oil_phases(_t(spark, d))


def p4_rise(spark, d):
    return prices.oil_lagged(_t(spark, d)).select("price_date", "price", "prev_price", "is_rise")


def p5_days(spark, d):
    return prices.response_counts(_t(spark, d))


def p6_delta(spark, d):
    return prices.station_lagged(_t(spark, d)).select("station_id", "price_date", "change",
                                                      "pct_change")


def p7_unpivot(spark, d):
    return prices.oil_long(_t(spark, d))


def j1(spark, d):
    return rentals.hours_with_rentals(spark, _t(spark, d))


def j2(spark, d):
    t = _t(spark, d)
    r = rentals.rentals_in_classes(t).withColumnRenamed("rental_station_id", "station_id")
    return r.join(t.rental_station, "station_id").select(
        "rental_id", "station_id", "station_name", "obs_datetime", "is_hot")


def j3(spark, d):
    return prices.station_with_brand_prices(_t(spark, d))


def j4(spark, d):
    return prices.station_with_oil(_t(spark, d))


def j5(spark, d):
    return prices.response_pairs(spark, _t(spark, d))


def j6(spark, d):
    return prices.station_changes_by_phase(spark, _t(spark, d))


def j7(spark, d):
    return prices.daily_phase(spark, _t(spark, d))


def a3_cond(spark, d):
    return rentals.station_heat_counts(_t(spark, d))


def a5_phase(spark, d):
    return prices.changes_by_phase(spark, _t(spark, d))


def a6_asym(spark, d):
    return prices.q2b(spark, _t(spark, d), subject="oil")


def a7_rate(spark, d):
    return rentals.class_rates(_t(spark, d))


def w1(spark, d):
    return prices.oil_lagged(_t(spark, d)).drop("is_rise")


def w2(spark, d):
    return prices.station_lagged(_t(spark, d)).drop("pct_change")


def w3(spark, d):
    o = prices.oil_series(_t(spark, d))
    o = moving_average(o, "price", "price_date", 5, frame="rows", out="ma_rows")
    return moving_average(o, "price", "price_date", 5, frame="range", out="ma_days")


def l1(spark, d):
    return rentals.top_stations(_t(spark, d))


def l2(spark, d):
    return prices.brand_ranking(spark, _t(spark, d))


def x1(spark, d):
    return prices.price_lag_correlation(spark, _t(spark, d))


QUERIES: dict[str, Query] = {
    "q1a": q1a, "q1b": q1b, "q2a": q2a, "q2b": q2b, "q2a_crudes": q2a_crudes,
    "q2a_dated": q2a_dated, "a4_waits": a4_waits, "a4_curve": a4_curve,
    "t3_versions": t3_versions, "j3_dated": j3_dated,
    "t1_weather": t1_weather, "t1_increment": t1_increment, "t1_cumulative": t1_cumulative,
    "t6_islands": t6_islands, "t4_typed": t4_typed,
    "q1_dups": q1_dups, "q2_orphans": q2_orphans, "t2_hourly": t2_hourly, "t3_master": t3_master,
    "t5_overlap": t5_overlap, "t6_spine": t6_spine,
    "q1_pk": q1_pk, "q2_fk": q2_fk, "q3_audit": q3_audit,
    "p1_band": p1_band, "p2_heat": p2_heat, "p3_phase": p3_phase, "p4_rise": p4_rise,
    "p5_days": p5_days, "p6_delta": p6_delta, "p7_unpivot": p7_unpivot,
    "j1": j1, "j2": j2, "j3": j3, "j4": j4, "j5": j5, "j6": j6, "j7": j7,
    "a3_cond": a3_cond, "a5_phase": a5_phase, "a6_asym": a6_asym, "a7_rate": a7_rate,
    "w1": w1, "w2": w2, "w3": w3,
    "l1": l1, "l2": l2, "x1": x1,
}
