"""Topic 2: international oil price against filling-station prices.

The oil table is a daily series of trading days (weekends and holidays absent);
the station table is a ragged daily panel. "Previous row" is never assumed to be
"yesterday": lags run over recorded rows and carry ``gap_days``; calendar-day
questions go through a calendar spine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.predicates import is_rise, phase, phase_vs_ma, response_days
from tidemark.operators.aggregates import asymmetry, by_phase, ratio
from tidemark.operators.asof import (
    asof_fill, event_span, next_event_counts, next_event_pairs, next_event_stats, response_spells, wait_counts,
)
from tidemark.operators.correlation import lag_correlation
from tidemark.operators.dated import join_in_force, split_by_version, versions
from tidemark.operators.ingest import fill_gaps
from tidemark.operators.reshape import crudes_long
from tidemark.operators.survival import product_limit, wait_summary
from tidemark.operators.windows import moving_average, with_lag
from tidemark.plans.memo import per_tables
from tidemark.schemas import CRUDES

DATE = "price_date"
DEFAULT_CRUDE = "dubai"


@per_tables
def oil_series(t, crude: str = DEFAULT_CRUDE) -> DataFrame:
    """One crude as (price_date, price)."""
    return t.oil_price.select(DATE, F.col(crude).alias("price")).where("price IS NOT NULL")


@per_tables
def oil_lagged(t, crude: str = DEFAULT_CRUDE, min_change: float = 0.0) -> DataFrame:
    """W1 + P4: the oil series with its previous trading day and the rise flag."""
    o = with_lag(oil_series(t, crude), "price", DATE)
    return o.withColumn("is_rise", is_rise("price", "prev_price", min_change))


@per_tables
def station_lagged(t) -> DataFrame:
    """W2 + P6: each station's price with its previous recorded price."""
    g = with_lag(t.gas_price.select("station_id", DATE, "price"), "price", DATE, by=["station_id"])
    return g.withColumn("pct_change", F.col("change") * 100.0 / F.nullif(F.col("prev_price"), F.lit(0.0)))


def panel_period(t) -> DataFrame:
    """(lo, hi) of the station panel as one row, by the tables' own way if they have one
    (partition names, or the panel's source), which spares an aggregate over the panel."""
    if hasattr(t, "period"):
        return t.period("gas_price", DATE)
    return t.gas_price.agg(F.min(DATE).alias("lo"), F.max(DATE).alias("hi"))


def _panel_bounds(t):
    return panel_period(t).select(F.struct("lo", "hi")).scalar()


def common_period(t, crude: str = DEFAULT_CRUDE) -> DataFrame:
    """T5: (lo, hi) where both oil and station prices exist; lo > hi means none."""
    oil, g = oil_series(t, crude).agg(F.min(DATE).alias("lo"), F.max(DATE).alias("hi")), _panel_bounds(t)
    return oil.select(F.greatest("lo", g["lo"]).alias("lo"), F.least("hi", g["hi"]).alias("hi"))


@per_tables
def rise_events(t, crude: str = DEFAULT_CRUDE, min_change: float = 0.0) -> DataFrame:
    """Oil rise days inside the common period (the lag itself looks back past it)."""
    # Rise days are oil days, so they lie in the oil period already; the common
    # period (T5) only adds the station panel's bounds.
    return _in_panel(t, oil_lagged(t, crude, min_change)).select(F.col(DATE).alias("event_date"))


def _in_panel(t, oil: DataFrame) -> DataFrame:
    g = _panel_bounds(t)
    return oil.where(F.col("is_rise") & (F.col(DATE) >= g["lo"]) & (F.col(DATE) <= g["hi"]))


@per_tables
def crude_rise_events(t, min_change: float = 0.0) -> DataFrame:
    """Rise days of every crude (crude, event_date): the lag runs within each crude."""
    w = Window.partitionBy().orderBy(DATE).rowsBetween(Window.unboundedPreceding, -1)
    prev = {c: F.last(c, ignorenulls=True).over(w).alias(f"prev_{c}") for c in CRUDES}     # a crude's last recorded price
    o = t.oil_price.where(F.col(DATE).isNotNull()).select(DATE, *CRUDES, *prev.values())
    up = F.array_compact(F.array(*[F.when(is_rise(c, f"prev_{c}", min_change), F.lit(c)) for c in CRUDES]))
    o = o.select(DATE, F.explode(up).alias("crude")).withColumn("is_rise", F.lit(True))
    return _in_panel(t, o).select("crude", F.col(DATE).alias("event_date"))


@per_tables
def station_rises(t, max_gap_days: int | None = None) -> DataFrame:
    """The station panel with ``is_rise``: price above its previous recorded price, that
    one being ``max_gap_days`` old at most, if given."""
    up = F.col("change") > 0
    if max_gap_days is not None:
        up = up & (F.col("gap_days") <= int(max_gap_days))
    return station_lagged(t).withColumn("is_rise", F.coalesce(up, F.lit(False)))


@per_tables
def trading_day_index(t, crude: str = DEFAULT_CRUDE) -> DataFrame:
    """(d, idx): for every calendar day from the first oil day to the last station
    day, the number of oil trading days up to it (carried over weekends and
    holidays). A daily series, bounded by the span."""
    o = oil_series(t, crude).select(
        F.col(DATE).alias("d"), F.row_number().over(Window.orderBy(DATE)).alias("idx"))
    hi = _panel_bounds(t)["hi"]
    return fill_gaps(o, "d", "1 day", ["idx"], until=hi, source_col="_src").select("d", "idx")


def _check_unit(unit):
    if unit not in ("calendar", "trading"):
        raise ValueError(unit)


def response_pairs(spark: SparkSession, t, crude: str = DEFAULT_CRUDE,
                   min_change: float = 0.0, horizon_days: int | None = None,
                   unit: str = "calendar") -> DataFrame:
    """J5 + P5: every (oil rise, station) pair that got a response, with the first
    station rise strictly after the event and the days in between
    (``unit='trading'``: oil trading days elapsed, T(response) - T(event))."""
    _check_unit(unit)
    p = next_event_pairs(spark, rise_events(t, crude, min_change), "event_date",
                         station_rises(t), "station_id", DATE, "is_rise", horizon_days)
    if unit == "calendar":
        return p.withColumn("response_days", response_days("event_date", "response_date"))
    ix = trading_day_index(t, crude)
    e = ix.select(F.col("d").alias("event_date"), F.col("idx").alias("_ie"))
    r = ix.select(F.col("d").alias("response_date"), F.col("idx").alias("_ir"))
    return (p.join(e, "event_date", "left").join(r, "response_date", "left")
             .select("station_id", "event_date", "response_date",
                     (F.col("_ir") - F.col("_ie")).cast("int").alias("response_days")))


def response_counts(t, crude: str = DEFAULT_CRUDE, min_change: float = 0.0,
                    horizon_days: int | None = None) -> DataFrame:
    """P5: (response_days, n_pairs), the (oil rise, station) pairs by their wait."""
    c = next_event_counts(rise_events(t, crude, min_change), "event_date", station_rises(t),
                          "station_id", DATE, "is_rise", horizon_days)
    return (c.groupBy(response_days("event_date", "response_date").alias("response_days"))
             .agg(F.sum("n_keys").alias("n_pairs")))


def _by_brand(t, stats: DataFrame, averaging: str, *by: str) -> DataFrame:
    sb = stats.join(t.gas_station.select("station_id", "brand"), "station_id")
    g = sb.groupBy(*by, "brand").agg(
        F.count("*").alias("n_stations"),
        F.sum("n_events").cast("long").alias("n_events"),
        F.sum("n_responded").cast("long").alias("n_responded"),
        F.sum("sum_days").cast("long").alias("sum_days"),
        F.avg(ratio("sum_days", "n_responded")).alias("station_mean_days"))
    avg = ratio("sum_days", "n_responded") if averaging == "pairs" else F.col("station_mean_days")
    return g.select(*by, "brand", "n_stations", "n_events", "n_responded", avg.alias("avg_days"))


def q2a(spark: SparkSession, t, crude: str = DEFAULT_CRUDE,
        min_change: float = 0.0, horizon_days: int | None = None,
        averaging: str = "pairs", unit: str = "calendar",
        max_gap_days: int | None = None) -> DataFrame:
    """2-A: mean days until a station follows an oil rise, by brand.

    n_events counts (rise, station) pairs; n_responded those with a later station
    rise; avg_days averages the responded ones. Pairs still waiting at the end of
    the data are censored: counted in n_events, not in the mean; so are pairs
    whose response comes more than ``horizon_days`` after the event, if given.
    ``averaging='pairs'`` averages over (event, station) pairs; ``'stations'``
    averages each station's mean (stations without a response left out).
    ``unit='trading'`` counts the wait in oil trading days instead of calendar days.
    ``max_gap_days``: a station's rise counts only if its price before is at most that old.
    """
    if averaging not in ("pairs", "stations"):
        raise ValueError(averaging)
    _check_unit(unit)
    ev = rise_events(t, crude, min_change)
    # Per station in one pass over the panel (every station of the panel appears).
    stats = next_event_stats(spark, ev, "event_date", station_rises(t, max_gap_days), "station_id",
                             DATE, "is_rise", horizon_days,
                             trading_day_index(t, crude) if unit == "trading" else None)
    return _by_brand(t, stats, averaging)


def q2a_crudes(spark: SparkSession, t, min_change: float = 0.0, horizon_days: int | None = None,
               averaging: str = "pairs", max_gap_days: int | None = None) -> DataFrame:
    """2-A for each crude (P7's three columns) in one pass over the station panel:
    crude, brand, ... Waits are calendar days; the other parameters are those of ``q2a``."""
    if averaging not in ("pairs", "stations"):
        raise ValueError(averaging)
    stats = next_event_stats(spark, crude_rise_events(t, min_change), "event_date",
                             station_rises(t, max_gap_days), "station_id", DATE, "is_rise",
                             horizon_days, series="crude", names=CRUDES)
    return _by_brand(t, stats, averaging, "crude")


def _check_horizon(horizon_days):
    if horizon_days is not None and int(horizon_days) < 1:
        raise ValueError(f"horizon_days must be at least 1, not {horizon_days}")


def wait_curve(spark: SparkSession, t, crude: str = DEFAULT_CRUDE, min_change: float = 0.0,
               horizon_days: int | None = None, max_gap_days: int | None = None) -> DataFrame:
    """A4 with censoring: per brand and distinct wait, how many (oil rise, station) pairs
    were still waiting, responded and went out of sight, and the share that waits longer.

    A pair without a response is watched until its station's last price day (or the
    horizon); pairs whose rise falls on or after that day were never watched and are left
    out, as are brands all of whose pairs are. Prices before a station's first day are
    taken as unchanged, as in ``q2a``."""
    _check_horizon(horizon_days)
    ev, spells = response_spells(rise_events(t, crude, min_change), "event_date",
                                 station_rises(t, max_gap_days), "station_id", DATE, "is_rise")
    spells = spells.join(t.gas_station.select("station_id", "brand"), "station_id")
    return product_limit(wait_counts(spells, ev, ["brand"], horizon_days), ["brand"])


def q2a_waits(spark: SparkSession, t, crude: str = DEFAULT_CRUDE, min_change: float = 0.0,
              horizon_days: int | None = None, max_gap_days: int | None = None) -> DataFrame:
    """2-A with censoring: per brand the mean and median wait by the product-limit
    estimate, where ``q2a`` averages the waits that ended. Equal to it if all did."""
    return wait_summary(wait_curve(spark, t, crude, min_change, horizon_days, max_gap_days), ["brand"])


@per_tables
def station_brands(t) -> DataFrame:
    """T3 over time: (station_id, brand, valid_from, valid_to), from the brand recorded
    beside each station price."""
    return versions(t.brand_days, "station_id", DATE, ["brand"])


def station_with_dated_brand(t) -> DataFrame:
    """J3 as of a day: each station price with the brand its station had on that day."""
    p = t.gas_price.select("station_id", DATE, "price")
    return join_in_force(p, station_brands(t), "station_id", DATE, ["brand"]) \
        .select("station_id", "brand", DATE, "price")


def q2a_dated(spark: SparkSession, t, crude: str = DEFAULT_CRUDE, min_change: float = 0.0,
              horizon_days: int | None = None, max_gap_days: int | None = None) -> DataFrame:
    """2-A by the brand a station had on the day of the oil rise: a station that changes
    its brand counts for both, each (rise, station) pair for one. Columns and averaging
    (over pairs) of ``q2a``, to which it is equal where no brand changes. A station
    without any recorded brand counts for none."""
    _check_horizon(horizon_days)
    events, brands = rise_events(t, crude, min_change), station_brands(t)
    ev, spells = response_spells(events, "event_date", station_rises(t, max_gap_days), "station_id", DATE, "is_rise")
    cut = split_by_version(spells.where("answered"), brands, "station_id", ["brand"])
    waits = wait_counts(cut, ev, ["brand"], horizon_days).groupBy("brand").agg(
        F.sum("n_responded").alias("n_responded"),
        F.sum(F.col("wait_days") * F.col("n_responded")).alias("sum_days"))
    # Events by the brand in force: equal stretches are counted before they are expanded.
    _, lo, hi, _ = event_span(events, "event_date")
    asked = (brands.select("brand", F.greatest("valid_from", lo).alias("_s"),
                           F.least(F.date_sub("valid_to", 1), hi).alias("_e"))
             .where("_s <= _e").groupBy("brand", "_s", "_e").agg(F.count("*").alias("_n"))
             .select("brand", "_n", F.explode(F.sequence("_s", "_e")).alias("d")).join(ev, "d")
             .groupBy("brand").agg(F.sum("_n").alias("n_events")))
    stations = brands.groupBy("brand").agg(F.countDistinct("station_id").alias("n_stations"))
    zero = F.lit(0).cast("long")
    return stations.join(asked, "brand", "left").join(waits, "brand", "left").select(
        "brand", "n_stations", F.coalesce("n_events", zero).alias("n_events"),
        F.coalesce("n_responded", zero).alias("n_responded"), ratio("sum_days", "n_responded").alias("avg_days"))


def brand_ranking(spark: SparkSession, t, crude: str = DEFAULT_CRUDE) -> DataFrame:
    """L2: brands ordered by response speed (fastest first; no response last)."""
    a = q2a(spark, t, crude)
    w = Window.orderBy(F.col("avg_days").asc_nulls_last(), F.col("brand"))
    return a.withColumn("speed_rank", F.row_number().over(w)).orderBy("speed_rank")


@per_tables
def oil_phases(t, crude: str = DEFAULT_CRUDE, n: int = 5, frame: str = "rows",
               require_full: bool = False, rule: str = "ma_slope") -> DataFrame:
    """W3 + P3: moving average of the oil price and its phase per trading day.
    ``rule='ma_slope'``: the MA against the previous MA; ``'price_vs_ma'``: the
    price against its MA."""
    if rule not in ("ma_slope", "price_vs_ma"):
        raise ValueError(rule)
    o = moving_average(oil_series(t, crude), "price", DATE, n, frame=frame,
                       require_full=require_full)
    o = with_lag(o.withColumnRenamed("price", "oil_price").withColumnRenamed("ma", "price"),
                 "price", DATE)
    ph = (phase("price", "prev_price") if rule == "ma_slope"
          else phase_vs_ma("oil_price", "price"))
    return o.select(DATE, "oil_price", F.col("price").alias("ma"),
                    F.col("prev_price").alias("prev_ma"), ph.alias("phase"))


def daily_phase(spark: SparkSession, t, crude: str = DEFAULT_CRUDE, n: int = 5,
                **ma) -> DataFrame:
    """The oil phase of every calendar day, carried from the last trading day,
    up to the last station price day."""
    ph = oil_phases(t, crude, n, **ma).where(F.col("phase").isNotNull())
    hi = _panel_bounds(t)["hi"]
    return asof_fill(ph.select(DATE, "phase", "oil_price"), DATE, ["phase", "oil_price"],
                     hi=hi, out_date=DATE)


def station_changes_by_phase(spark: SparkSession, t, crude: str = DEFAULT_CRUDE,
                             n: int = 5, max_gap_days: int | None = None, **ma) -> DataFrame:
    """Each station price change with the oil phase of its day; changes over more than
    ``max_gap_days`` are left out, if given."""
    s = station_lagged(t).where(F.col("change").isNotNull())
    if max_gap_days is not None:
        s = s.where(F.col("gap_days") <= int(max_gap_days))
    ph = daily_phase(spark, t, crude, n, **ma).where(F.col("phase").isNotNull()) \
        .select(DATE, "phase", F.col("asof_date").alias("phase_date"))
    return s.join(ph, DATE).select(
        "station_id", DATE, "price", "prev_price", "gap_days", "change", "phase", "phase_date")


def q2b(spark: SparkSession, t, crude: str = DEFAULT_CRUDE, n: int = 5,
        subject: str = "station", frame: str = "rows", require_full: bool = False,
        rule: str = "ma_slope", max_gap_days: int | None = None) -> DataFrame:
    """2-B: do prices rise faster than they fall ("rockets and feathers")?

    subject='station': station price changes in rising vs falling oil phases;
    subject='oil': the oil price's own changes by its phase. Changes over more than
    ``max_gap_days`` calendar days are left out, if given. One row:
    n_rising, avg_change_rising, n_falling, avg_change_falling, asymmetry.
    """
    if subject == "station":
        ch = station_changes_by_phase(spark, t, crude, n, max_gap_days, frame=frame,
                                      require_full=require_full, rule=rule)
    elif subject == "oil":
        ph = oil_phases(t, crude, n, frame=frame, require_full=require_full, rule=rule)
        ch = with_lag(ph.select(DATE, "oil_price", "phase"), "oil_price", DATE) \
            .where(F.col("change").isNotNull())
        if max_gap_days is not None:
            ch = ch.where(F.col("gap_days") <= int(max_gap_days))
    else:
        raise ValueError(subject)
    return asymmetry(ch, "phase", "change")


def changes_by_phase(spark: SparkSession, t, crude: str = DEFAULT_CRUDE, n: int = 5) -> DataFrame:
    """A5: per phase, number and mean of station price changes."""
    return by_phase(station_changes_by_phase(spark, t, crude, n), "phase", "change")


def station_with_oil(t, crude: str = DEFAULT_CRUDE) -> DataFrame:
    """Station prices on the days with an oil price (equi join on the date)."""
    o = oil_series(t, crude).withColumnRenamed("price", "oil_price")
    return t.gas_price.join(o, DATE).select("station_id", DATE, "price", "oil_price")


def station_with_brand_prices(t) -> DataFrame:
    """J3 at price grain: each station price with its brand."""
    return t.gas_price.join(t.gas_station.select("station_id", "brand"), "station_id") \
        .select("station_id", "brand", DATE, "price")


def price_lag_correlation(spark: SparkSession, t, crude: str = DEFAULT_CRUDE,
                          max_lag: int = 7) -> DataFrame:
    """corr(oil(d), mean station price(d + k)) for k = 0..max_lag.
    The panel is first reduced to one mean per day (partial aggregation)."""
    daily = t.gas_price.groupBy(DATE).agg(F.avg("price").alias("station_price"))
    return lag_correlation(oil_series(t, crude), DATE, "price", daily, DATE, "station_price",
                           max_lag)


def oil_long(t) -> DataFrame:
    """Crudes as rows."""
    return crudes_long(t.oil_price)
