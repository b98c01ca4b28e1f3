"""Running totals: resets, missing hours, midnight; islands of the time axis."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tests.conftest import FakeTables
from tidemark.operators.ingest import hourly_weather, island_axis, islands
from tidemark.operators.meter import meter_hours, meter_rises
from tidemark.plans import rentals

D = dt.datetime(2026, 1, 5)


def at(h, m=0, d=0):
    return D + dt.timedelta(days=d, hours=h, minutes=m)


def frame(spark, rows, station="133"):
    return spark.createDataFrame([(station, t, v) for t, v in rows], "station string, obs_datetime timestamp_ntz, precipitation double")


def hours(df):
    return {r.obs_datetime: (r.precipitation, r.n_resets, r.is_estimated) for r in df.collect()}


def test_reset_in_the_middle_of_a_day(spark):
    """5.0 falls to 2.0 by a reset: the hour has risen by 2.0, not by -3.0."""
    df = frame(spark, [(at(0, 30), 1.0), (at(1), 4.0), (at(1, 30), 5.0), (at(2), 2.0), (at(2, 40), 2.5)])
    assert hours(meter_hours(df, by=["station"])) == {at(0): (1.0, 0, False), at(1): (4.0, 0, False), at(2): (2.5, 1, False)}
    hw = hourly_weather(df.withColumn("feel_temp", F.lit(1.0)), precip_mode="cumulative")
    assert all(r.precipitation >= 0 for r in hw.collect())


def test_rise_over_missing_hours(spark):
    """12 mm between 01:30 and 05:30, four hours apart."""
    df = frame(spark, [(at(0, 30), 0.0), (at(1, 30), 2.0), (at(5, 30), 14.0), (at(6), 14.5)])
    assert hours(meter_hours(df, by=["station"])) == {
        at(0): (0.0, 0, False), at(1): (2.0 + 1.5, 0, True), at(2): (3.0, 0, True), at(3): (3.0, 0, True), at(4): (3.0, 0, True),
        at(5): (1.5, 0, True), at(6): (0.5, 0, False)}
    marked = hours(meter_hours(df, by=["station"], gaps="mark"))
    assert {h for h, r in marked.items() if r[0] is None} == {at(k) for k in (1, 2, 3, 4, 5)} and marked[at(6)][0] == 0.5
    hw = {r.obs_datetime: (r.precipitation, r.n_obs) for r in hourly_weather(df.withColumn("feel_temp", F.lit(1.0)), precip_mode="cumulative").collect()}
    assert hw[at(3)] == (3.0, 0) and hw[at(5)] == (1.5, 1)
    with pytest.raises(ValueError):
        meter_hours(df, gaps="none")


def test_midnight_and_counters_that_run_on(spark):
    rows = [(at(23, 30), 7.0), (at(0, 10, 1), 0.5), (at(0, 40, 1), 0.75)]
    got = hours(meter_hours(frame(spark, rows), by=["station"]))
    assert got[at(0, 0, 1)] == (0.75, 0, False) and sum(r[0] for r in got.values()) == 7.75
    run_on = [(at(23, 30), 7.0), (at(0, 10, 1), 7.5), (at(0, 40, 1), 7.75), (at(9, 0, 3), 1.0)]
    got = hours(meter_hours(frame(spark, run_on), by=["station"], daily=False))
    assert got[at(23)][0] == 0.0 and got[at(0, 0, 1)][0] is not None
    assert abs(sum(r[0] for r in got.values()) - (0.5 + 0.25 + 1.0)) < 1e-9 and sum(r[1] for r in got.values()) == 1


def test_shares_add_up_and_nothing_is_negative(spark):
    rng, rows = random.Random(1), []
    for d in range(6):
        total = 0.0
        for _ in range(12):
            t = at(rng.randrange(24), rng.randrange(60), d)
            rows.append((t, round(rng.uniform(0, 9), 3)))
        total += 1
    df = frame(spark, rows).unionByName(frame(spark, rows, None))
    for daily in (True, False):
        out = meter_hours(df, by=["station"], daily=daily).collect()
        assert all(r.precipitation >= 0 for r in out)
        rises = meter_rises(df, "obs_datetime", "precipitation", ["station"], daily).agg(F.sum("units")).first()[0]
        assert round(sum(r.precipitation for r in out) * 1e6) == rises
        assert {r.station for r in out} == {"133", None}


def test_one_wrong_stamp_makes_no_long_axis(spark):
    rows = [(at(0, 30), 1.0), (at(1), 4.0), (dt.datetime(9999, 1, 1, 0, 10), 5.0), (None, 1.0), (at(3), None), (at(3), float("nan"))]
    got = meter_hours(frame(spark, rows), by=["station"], daily=False).collect()
    assert len(got) == 3 and [r.precipitation for r in sorted(got, key=lambda r: r.obs_datetime)] == [0.0, 3.0, None]
    assert meter_hours(frame(spark, []), by=["station"]).count() == 0


def test_islands_cut_the_axis(spark):
    seen = [at(0), at(1, 20), at(5), at(0, 0, 40), at(3, 0, 40), dt.datetime(9999, 6, 1, 7), None]
    df = spark.createDataFrame([(t,) for t in seen], "t timestamp_ntz")
    got = sorted(map(tuple, islands(df, "t", 24).collect()))
    assert got == [(at(0), at(5), 6, 3), (at(0, 0, 40), at(3, 0, 40), 4, 2), (dt.datetime(9999, 6, 1, 7),) * 2 + (1, 1)]
    axis = [r.h for r in island_axis(islands(df, "t", 24), "h").collect()]
    assert len(axis) == 11 == len(set(axis)) and dt.datetime(9999, 6, 1, 7) in axis
    # months apart by less than the limit stay one island
    edge = spark.createDataFrame([(dt.datetime(2026, 1, 31, 20),), (dt.datetime(2026, 2, 1, 3),), (dt.datetime(2026, 4, 1),)], "t timestamp_ntz")
    assert [tuple(r)[2:] for r in islands(edge, "t", 24 * 31).orderBy("lo").collect()] == [(8, 2), (1, 1)]
    long = spark.createDataFrame([(dt.datetime(2026, 1, 1),), (dt.datetime(2026, 12, 31, 23),)], "t timestamp_ntz")
    assert island_axis(islands(long, "t", 10 ** 4), "h").distinct().count() == 365 * 24


def test_far_stamp_leaves_1a_unchanged(spark):
    base = [(at(0), 0.0, 20.0), (at(1), 5.0, 20.0), (at(4), 12.0, 20.0)]
    far = base + [(dt.datetime(9999, 12, 31, 23), 0.0, 20.0)]
    rental = spark.createDataFrame([("S", at(0, 10)), ("S", at(1, 10)), ("S", at(3, 10))], "rental_station_id string, rental_time timestamp_ntz")
    table = lambda rows: FakeTables(weather=spark.createDataFrame(rows, "obs_datetime timestamp_ntz, precipitation double, feel_temp double"), rental=rental)
    one = {r.band: r for r in rentals.q1a(spark, table(base)).collect()}
    two = {r.band: r for r in rentals.q1a(spark, table(far)).collect()}
    assert {b: r for b, r in one.items() if b != "none"} == {b: r for b, r in two.items() if b != "none"}
    assert two["none"].n_hours == one["none"].n_hours + 1                  # the stamp's own hour, no more
    assert rentals.weather_islands(table(far).weather).count() == 2
