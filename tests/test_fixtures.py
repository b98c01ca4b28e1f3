"""Hand-made cases of FIXTURES.md §4 (F1–F8), small enough to check by eye."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tests.conftest import FakeTables
from tidemark.operators import quality
from tidemark.operators.aggregates import asymmetry
from tidemark.operators.asof import asof_fill
from tidemark.operators.windows import moving_average, with_lag
from tidemark.plans import prices, rentals

H0 = dt.datetime(2026, 1, 5, 0, 0)


def h(i, minute=0):
    return H0 + dt.timedelta(hours=i, minutes=minute)


def weather_df(spark, rows):
    return spark.createDataFrame(rows, "obs_datetime timestamp_ntz, precipitation double, "
                                       "feel_temp double")


def rental_df(spark, rows):
    return spark.createDataFrame(
        [(i, s, t) for i, (s, t) in enumerate(rows)],
        "rental_id bigint, rental_station_id string, rental_time timestamp_ntz")


def stations_df(spark, ids):
    return spark.createDataFrame([(i, f"name-{i}") for i in ids],
                                 "station_id string, station_name string")


def test_f1_bands_keep_the_hour(spark):
    w = weather_df(spark, [(h(0), 0.0, 1.0), (h(1), 9.9, 1.0), (h(2), 10.0, 1.0),
                           (h(3), None, 1.0), (h(4), 0.0, 1.0), (h(5), 0.1, 1.0)])
    counts = {0: 4, 1: 2, 2: 1, 3: 3, 5: 1}
    r = rental_df(spark, [("S", h(i, m)) for i, n in counts.items() for m in range(n)])
    t = FakeTables(weather=w, rental=r, rental_station=stations_df(spark, ["S"]))
    got = {x.band: (x.n_hours, x.rentals, x.avg_rentals) for x in rentals.q1a(spark, t).collect()}
    assert got == {"none": (2, 4, 2.0), "lt10": (2, 3, 1.5), "ge10": (1, 1, 1.0),
                   "unobserved": (1, 3, 3.0)}


def test_f1_missing_hour_is_unobserved(spark):
    # h1 has no weather row at all: the spine still has it.
    w = weather_df(spark, [(h(0), 0.0, 1.0), (h(2), 0.0, 1.0)])
    r = rental_df(spark, [("S", h(1, 5))])
    t = FakeTables(weather=w, rental=r, rental_station=stations_df(spark, ["S"]))
    got = {x.band: (x.n_hours, x.rentals) for x in rentals.q1a(spark, t).collect()}
    assert got == {"none": (2, 0), "unobserved": (1, 1)}


def _heat_tables(spark, temps):
    w = weather_df(spark, [(h(i), 0.0, temps[i]) for i in range(6)])
    rows = []
    # A: 0 hot, 8 normal; B: 2 hot, 4 normal; C: 4 hot, 4 normal
    rows += [("A", h(2 + i % 4, i)) for i in range(8)]
    rows += [("B", h(i % 2, i)) for i in range(2)] + [("B", h(2 + i, 1)) for i in range(4)]
    rows += [("C", h(i % 2, i)) for i in range(4)] + [("C", h(2 + i, 2)) for i in range(4)]
    return FakeTables(weather=w, rental=rental_df(spark, rows),
                      rental_station=stations_df(spark, ["A", "B", "C"]))


def test_f2_heat_drop_keeps_zero_heat_station(spark):
    t = _heat_tables(spark, [35.0, 36.0, 34.9, 20.0, 10.0, 30.0])
    got = [(x.station_id, x.rate_drop) for x in rentals.q1b(spark, t).collect()]
    assert got == [("A", 2.0), ("B", 0.0), ("C", -1.0)]


def test_f2_order_by_percent(spark):
    t = _heat_tables(spark, [35.0, 36.0, 34.9, 20.0, 10.0, 30.0])
    got = [(x.station_id, x.pct_drop) for x in rentals.q1b(spark, t, order_by="pct_drop").collect()]
    assert got == [("A", 100.0), ("B", 0.0), ("C", -100.0)]


def test_f3_no_heat_no_rows(spark):
    t = _heat_tables(spark, [5.0] * 6)
    assert rentals.q1b(spark, t).collect() == []


D0 = dt.date(2026, 5, 4)  # a Monday


def d(i):
    return D0 + dt.timedelta(days=i)


def oil_df(spark, rows):
    return spark.createDataFrame([(dd, p, p, p) for dd, p in rows],
                                 "price_date date, dubai double, brent double, wti double")


def gas_df(spark, rows):
    return spark.createDataFrame(rows, "station_id string, price_date date, price double")


def test_f4_response_days_and_censoring(spark):
    oil = oil_df(spark, [(d(0), 70.0), (d(1), 71.0), (d(2), 71.0), (d(3), 72.0), (d(4), 71.0)])
    gas = gas_df(spark, [("X", d(i), p) for i, p in
                         enumerate([1600.0, 1600.0, 1600.0, 1610.0, 1610.0, 1610.0])])
    st = spark.createDataFrame([("X", "P")], "station_id string, brand string")
    t = FakeTables(oil_price=oil, gas_price=gas, gas_station=st)
    got = [tuple(x) for x in prices.q2a(spark, t).collect()]
    assert got == [("P", 1, 2, 1, 2.0)]
    pairs = [tuple(x) for x in prices.response_pairs(spark, t).collect()]
    assert pairs == [("X", d(1), d(3), 2)]
    # A one-day horizon censors the two-day response.
    assert [tuple(x) for x in prices.q2a(spark, t, horizon_days=1).collect()] == [("P", 1, 2, 0, None)]
    assert prices.response_pairs(spark, t, horizon_days=1).count() == 0
    assert [tuple(x) for x in prices.q2a(spark, t, horizon_days=2).collect()] == [("P", 1, 2, 1, 2.0)]


def test_2a_mean_of_station_means(spark):
    # Y answers Tue's rise on Wed (1 day) and Thu's on Fri (1 day); X as in F4 (2 days).
    oil = oil_df(spark, [(d(0), 70.0), (d(1), 71.0), (d(2), 71.0), (d(3), 72.0), (d(4), 71.0)])
    gas = gas_df(spark, [("X", d(i), p) for i, p in
                         enumerate([1600.0, 1600.0, 1600.0, 1610.0, 1610.0, 1610.0])]
                 + [("Y", d(i), p) for i, p in enumerate([10.0, 10.0, 11.0, 11.0, 12.0, 12.0])])
    st = spark.createDataFrame([("X", "P"), ("Y", "P")], "station_id string, brand string")
    t = FakeTables(oil_price=oil, gas_price=gas, gas_station=st)
    pairs = prices.q2a(spark, t).first()
    assert (pairs.n_events, pairs.n_responded, pairs.avg_days) == (4, 3, 4 / 3)
    assert prices.q2a(spark, t, averaging="stations").first().avg_days == 1.5


def test_f5_weekend_rows_vs_range_and_carry(spark):
    fri, mon = dt.date(2026, 5, 8), dt.date(2026, 5, 11)
    o = spark.createDataFrame([(fri, 10.0), (mon, 40.0)], "price_date date, price double")
    rows = moving_average(o, "price", "price_date", 2, frame="rows", out="m")
    rng = moving_average(o, "price", "price_date", 2, frame="range", out="m")
    assert rows.where(F.col("price_date") == mon).first().m == 25.0
    assert rng.where(F.col("price_date") == mon).first().m == 40.0
    filled = {x.cal_date: (x.price, x.asof_date) for x in asof_fill(o, "price_date", ["price"]).collect()}
    assert filled[dt.date(2026, 5, 9)] == (10.0, fri)
    assert filled[dt.date(2026, 5, 10)] == (10.0, fri)
    assert filled[mon] == (40.0, mon)
    assert len(filled) == 4


def test_f6_ragged_panel_lag(spark):
    g = gas_df(spark, [("X", d(1), 1.0), ("X", d(2), 2.0), ("X", d(5), 5.0)])
    r = with_lag(g, "price", "price_date", by=["station_id"]).where(F.col("price_date") == d(5)).first()
    assert (r.prev_price, r.gap_days) == (2.0, 3)


def test_f7_asymmetry(spark):
    df = spark.createDataFrame([("rising", 10.0), ("rising", 20.0), ("falling", -5.0),
                                ("falling", -5.0), ("flat", 1.0)], "phase string, change double")
    r = asymmetry(df, "phase", "change").first()
    assert (r.avg_change_rising, r.avg_change_falling, r.asymmetry) == (15.0, -5.0, 3.0)
    r2 = asymmetry(df.where("phase <> 'falling'"), "phase", "change").first()
    assert r2.asymmetry is None and r2.n_falling == 0


def test_f8_integrity(spark):
    st = stations_df(spark, ["A", "B", "B"])
    assert quality.pk_violations(st, ["station_id"]).count() == 1
    r = rental_df(spark, [("A", h(0)), ("Z", h(1))])
    orphans = quality.fk_orphans(r, "rental_station_id", st, "station_id").collect()
    assert [o.rental_station_id for o in orphans] == ["Z"]
    s = quality.fk_summary({"r": (r, "rental_station_id", st, "station_id")}).first()
    assert (s.n_rows, s.n_orphans) == (2, 1)


def test_t6_spine_between_bounds(spark):
    from tidemark.operators.ingest import spine
    sp = spine(spark, F.lit(h(0)), F.lit(h(5)), "1 hour", "obs_datetime")
    assert [r.obs_datetime for r in sp.orderBy("obs_datetime").collect()] == [h(i) for i in range(6)]


def test_fill_gaps_long_gap_and_null_time(spark):
    from tidemark.operators.ingest import fill_gaps
    w = weather_df(spark, [(h(0), 0.0, 1.0), (h(50), 0.0, 1.0), (None, 5.0, 1.0), (h(24 * 365 * 11), 0.0, 1.0)])
    assert fill_gaps(w, "obs_datetime", "1 hour", ["precipitation"]).count() == 24 * 365 * 11 + 1


def test_missing_values(spark):
    from tidemark.functions.predicates import is_hot, precip_band
    from tidemark.operators.windows import with_lag
    df = spark.createDataFrame([(0, -9.0), (1, float("nan")), (2, 0.0), (3, None)], "i int, p double")
    rows = df.select("i", precip_band("p").alias("b"), is_hot("p").alias("hot")).orderBy("i").collect()
    assert [r.b for r in rows] == ["unobserved", "unobserved", "none", "unobserved"]
    assert [r.hot for r in rows] == [False, None, False, None]
    oil = oil_df(spark, [(None, 70.0), (dt.date(2026, 5, 4), 71.0), (dt.date(2026, 5, 5), 72.0)])
    col = [c for c in oil.columns if c != "price_date"][0]
    got = with_lag(oil, col, "price_date").orderBy("price_date").collect()
    assert [r["prev_" + col] for r in got] == [None, got[0][col]]


def test_2a_trading_days_over_a_weekend(spark):
    # Oil rises on Fri; the station rises on Mon: 3 calendar days, 1 trading day.
    fri, sat, mon = dt.date(2026, 5, 8), dt.date(2026, 5, 9), dt.date(2026, 5, 11)
    oil = oil_df(spark, [(fri - dt.timedelta(days=1), 70.0), (fri, 71.0), (mon, 71.0)])
    gas = gas_df(spark, [("X", fri - dt.timedelta(days=1), 100.0), ("X", fri, 100.0),
                         ("X", sat, 100.0), ("X", mon, 101.0)])
    st = spark.createDataFrame([("X", "P")], "station_id string, brand string")
    t = FakeTables(oil_price=oil, gas_price=gas, gas_station=st)
    assert prices.q2a(spark, t).first().avg_days == 3.0
    assert prices.q2a(spark, t, unit="trading").first().avg_days == 1.0
    p = prices.response_pairs(spark, t, unit="trading").first()
    assert (p.event_date, p.response_date, p.response_days) == (fri, mon, 1)


def test_fill_gaps_tolerates_duplicate_times(spark):
    from tidemark.operators.ingest import fill_gaps
    w = weather_df(spark, [(h(0), 0.0, 1.0), (h(0), 1.0, 1.0), (h(3), 0.0, 1.0)])
    got = sorted((r.obs_datetime, r.precipitation)
                 for r in fill_gaps(w, "obs_datetime", "1 hour", ["precipitation"]).collect())
    assert [g[0] for g in got] == [h(0), h(0), h(1), h(2), h(3)]


def test_1b_same_hour_baseline(spark):
    # Day 1 00:00 is hot; day 2 00:00 and 01:00 are normal. With the same-hour
    # baseline only day 2 00:00 is a normal hour.
    d2 = dt.timedelta(days=1)
    w = weather_df(spark, [(h(0), 0.0, 36.0), (h(0) + d2, 0.0, 20.0), (h(1) + d2, 0.0, 20.0)])
    r = rental_df(spark, [("A", h(0, 5)), ("A", h(0, 6) + d2), ("A", h(0, 7) + d2),
                          ("A", h(1, 5) + d2), ("A", h(1, 6) + d2), ("A", h(1, 7) + d2),
                          ("A", h(1, 8) + d2)])
    t = FakeTables(weather=w, rental=r, rental_station=stations_df(spark, ["A"]))
    a = rentals.q1b(spark, t).first()
    assert (a.n_normal_hours, a.normal_rentals, a.normal_rate, a.rate_drop) == (2, 6, 3.0, 2.0)
    b = rentals.q1b(spark, t, baseline="same_hour").first()
    assert (b.n_normal_hours, b.normal_rentals, b.normal_rate, b.rate_drop) == (1, 2, 2.0, 1.0)


def test_2b_price_vs_ma_rule(spark):
    oil = oil_df(spark, [(d(0), 10.0), (d(1), 20.0), (d(2), 12.0), (d(3), 14.0)])
    t = FakeTables(oil_price=oil)
    slope = {r.price_date: r.phase for r in prices.oil_phases(t, n=2).collect()}
    vs = {r.price_date: r.phase for r in prices.oil_phases(t, n=2, rule="price_vs_ma").collect()}
    # MAs: 10, 15, 16, 13.  slope: -, rising, rising, falling.  price vs MA: flat, rising, falling, rising
    assert [slope[d(i)] for i in range(4)] == [None, "rising", "rising", "falling"]
    assert [vs[d(i)] for i in range(4)] == ["flat", "rising", "falling", "rising"]


def test_equal_frames_have_equal_averages(spark):
    """A price cycle of period 5 has a constant 5-row mean: every full day is flat."""
    import datetime as dt
    from tidemark.functions.predicates import phase
    from tidemark.operators.windows import moving_average, with_lag
    cycle = [70.1, 70.7, 69.3, 71.9, 70.3]
    rows = [(dt.date(2026, 1, 1) + dt.timedelta(days=i), cycle[i % 5]) for i in range(60)]
    ma = moving_average(spark.createDataFrame(rows, "d date, price double"), "price", "d", 5)
    got = with_lag(ma, "ma", "d").select("d", phase("ma", "prev_ma").alias("phase")).orderBy("d").collect()
    assert {r.phase for r in got[5:]} == {"flat"}


def test_null_keys_are_violations(spark):
    from tidemark.operators import quality
    df = spark.createDataFrame([("a",), (None,), ("b",), ("b",)], "k string")
    assert {(r.k, r.n_rows) for r in quality.pk_violations(df, ["k"]).collect()} == {(None, 1), ("b", 2)}
