"""A4 with censoring (product-limit waits) and dated masters (T3 + J3 over time)."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tests.conftest import SF01, FakeTables
from tidemark.operators.dated import join_in_force, versions
from tidemark.operators.survival import product_limit, wait_summary
from tidemark.plans import prices
from tidemark.sources.testdata import Tables

D0 = dt.date(2026, 5, 4)      # a Monday
COUNTS = "brand string, wait_days int, n_responded long, n_censored long"


def d(i):
    return D0 + dt.timedelta(days=i)


def tables(spark, oil, gas, brands):
    """oil: {day: price}; gas: {station: {day: price}}; brands: {station: {day: brand}}."""
    return FakeTables(
        oil_price=spark.createDataFrame([(d(i), p, p, p) for i, p in oil.items()],
                                        "price_date date, dubai double, brent double, wti double"),
        gas_price=spark.createDataFrame([(s, d(i), p) for s, m in gas.items() for i, p in m.items()],
                                        "station_id string, price_date date, price double"),
        gas_station=spark.createDataFrame([(s, m[max(m)]) for s, m in brands.items()], "station_id string, brand string"),
        brand_days=spark.createDataFrame([(s, d(i), b) for s, m in brands.items() for i, b in m.items()],
                                         "station_id string, price_date date, brand string"))


def test_curve_by_hand(spark):
    # 10 pairs: 2 of 10 at day 1, one lost at 1, 3 of 7 at day 3, 4 lost at day 5.
    c = spark.createDataFrame([("P", 1, 2, 1), ("P", 3, 3, 0), ("P", 5, 0, 4)], COUNTS)
    rows = product_limit(c, ["brand"]).orderBy("wait_days").collect()
    assert [(r.wait_days, r.n_at_risk) for r in rows] == [(1, 10), (3, 7), (5, 4)]
    assert [round(r.survival, 9) for r in rows] == [0.8, round(0.8 * 4 / 7, 9), round(0.8 * 4 / 7, 9)]
    assert rows[0].std_error == pytest.approx(0.8 * (2 / (10 * 8)) ** 0.5)
    s = wait_summary(product_limit(c, ["brand"]), ["brand"]).first()
    assert (s.n_pairs, s.n_responded, s.n_censored, s.longest_days, s.median_days) == (10, 5, 5, 5, 3)
    assert s.mean_days == pytest.approx(1 + 2 * 0.8 + 2 * 0.8 * 4 / 7)


def test_curve_all_censored_none_censored_and_empty(spark):
    c = spark.createDataFrame([("none", 2, 0, 3), ("all", 1, 1, 0), ("all", 4, 1, 0)], COUNTS)
    got = {r.brand: r for r in wait_summary(product_limit(c, ["brand"]), ["brand"]).collect()}
    assert (got["none"].mean_days, got["none"].median_days) == (2.0, None)
    assert (got["all"].mean_days, got["all"].median_days) == (2.5, 1)
    last = product_limit(c, ["brand"]).where("brand = 'all' AND wait_days = 4").first()
    assert (last.survival, last.std_error) == (0.0, None)
    assert wait_summary(product_limit(c.limit(0), ["brand"]), ["brand"]).count() == 0


def test_waits_by_hand(spark):
    # Rises on days 1 and 3. X answers the first on day 3 and is watched until day 5 after the second.
    t = tables(spark, {0: 70.0, 1: 71.0, 2: 71.0, 3: 72.0, 4: 71.0},
               {"X": dict(enumerate([1.0, 1.0, 1.0, 2.0, 2.0, 2.0])), "Y": {0: 5.0, 1: 5.0}},
               {"X": {0: "P"}, "Y": {0: "Q"}})
    got = [tuple(r) for r in prices.wait_curve(spark, t).collect()]
    # Y's last price day is the first rise: it is never watched, so Q has no row.
    assert [r[:5] for r in got] == [("P", 2, 2, 1, 1)]
    assert got[0][5] == 0.5
    one = prices.q2a_waits(spark, t, horizon_days=1).first()
    assert (one.n_pairs, one.n_responded, one.n_censored, one.longest_days, one.mean_days) == (2, 0, 2, 1, 1.0)
    with pytest.raises(ValueError):
        prices.q2a_waits(spark, t, horizon_days=0)


def test_waits_equal_the_plain_mean_where_nothing_is_censored(spark):
    # Every station rises on its last day, after the last oil rise.
    rng = random.Random(5)
    gas = {f"s{i}": {k: float(rng.randint(1, 3)) for k in range(12)} | {12: 9.0} for i in range(20)}
    brands = {s: {0: "PQR"[i % 3]} for i, s in enumerate(gas)}
    t = tables(spark, {k: float(rng.randint(1, 9)) for k in range(11)}, gas, brands)
    plain = {r.brand: r for r in prices.q2a(spark, t).collect()}
    for r in prices.q2a_waits(spark, t).collect():
        assert r.n_censored == 0 and r.n_pairs == plain[r.brand].n_events
        assert r.mean_days == pytest.approx(plain[r.brand].avg_days, rel=1e-12)


@pytest.mark.parametrize("horizon", [None, 1, 3])
def test_waits_against_pairs(spark, horizon):
    """The counts against every pair, built one by one."""
    rng = random.Random(9)
    gas = {f"s{i}": {k: float(rng.randint(1, 4)) for k in range(15) if rng.random() < 0.6} for i in range(12)}
    gas = {s: m for s, m in gas.items() if m}
    brands = {s: {0: "PQ"[i % 2]} for i, s in enumerate(gas)}
    oil = {k: float(rng.randint(1, 5)) for k in range(15) if k % 7 < 5}
    t = tables(spark, oil, gas, brands)
    days = sorted(oil)
    lo, hi = min(min(m) for m in gas.values()), max(max(m) for m in gas.values())
    events = [k for j, k in zip(days, days[1:]) if oil[k] > oil[j] and lo <= k <= hi]
    want = {}
    for s, m in gas.items():
        ks = sorted(m)
        rises = [k for j, k in zip(ks, ks[1:]) if m[k] > m[j]]
        for e in events:
            r = min((k for k in rises if k > e), default=None)
            wait = (r if r is not None else ks[-1]) - e
            if wait <= 0:
                continue
            told = r is not None and (horizon is None or wait <= horizon)
            key = (brands[s][0], wait if horizon is None else min(wait, horizon))
            n = want.setdefault(key, [0, 0])
            n[0 if told else 1] += 1
    got = {(r.brand, r.wait_days): [r.n_responded, r.n_censored] for r in
           prices.wait_curve(spark, t, horizon_days=horizon).collect()}
    assert got == want


def test_versions_by_hand(spark):
    rows = [("A", d(0), "P"), ("A", d(1), "P"), ("A", d(4), "Q"), ("A", d(4), None), ("A", d(5), None),
            ("A", d(6), "Q"), ("A", d(9), "P"), ("B", d(3), "P"), ("B", d(3), "R"), (None, d(1), "P"),
            ("C", None, "P"), ("D", d(2), None)]
    f = spark.createDataFrame(rows, "station_id string, day date, brand string")
    got = sorted(tuple(r) for r in versions(f, "station_id", "day", ["brand"], open_start=False).collect())
    assert got == [("A", "P", d(0), d(4)), ("A", "P", d(9), None), ("A", "Q", d(4), d(9)), ("B", "R", d(3), None)]
    opened = versions(f, "station_id", "day", ["brand"]).where("valid_from IS NULL").collect()
    assert sorted((r.station_id, r.brand, r.valid_to) for r in opened) == [("A", "P", d(4)), ("B", "R", None)]
    assert versions(f.limit(0), "station_id", "day", ["brand"]).count() == 0


def test_versions_of_two_attributes(spark):
    rows = [("A", d(0), "P", None), ("A", d(1), "P", "x"), ("A", d(2), "P", "x"), ("A", d(3), None, "x")]
    f = spark.createDataFrame(rows, "station_id string, day date, brand string, self_service string")
    got = versions(f, "station_id", "day", ["brand", "self_service"], open_start=False).orderBy("valid_from").collect()
    assert [(r.brand, r.self_service, r.valid_from) for r in got] == [("P", None, d(0)), ("P", "x", d(1)), (None, "x", d(3))]


def test_join_in_force(spark):
    dim = versions(spark.createDataFrame([("A", d(2), "P"), ("A", d(5), "Q")], "station_id string, day date, brand string"),
                   "station_id", "day", ["brand"], open_start=False)
    # the fact has a column named as one of the version's own
    f = spark.createDataFrame([("A", d(i), i) for i in (1, 2, 4, 5, 90)] + [("Z", d(3), 7), ("A", None, 8)],
                              "station_id string, day date, valid_to int")
    left = {r.valid_to: r.brand for r in join_in_force(f, dim, "station_id", "day", ["brand"], how="left").collect()}
    assert left == {1: None, 2: "P", 4: "P", 5: "Q", 90: "Q", 7: None, 8: None}
    assert join_in_force(f, dim, "station_id", "day", ["brand"]).count() == 4


def test_a_change_of_brand_counts_for_both(spark):
    # Rises on days 1 and 3; X is P until day 2, then Q, and answers on days 2 and 5.
    t = tables(spark, {0: 70.0, 1: 71.0, 2: 71.0, 3: 72.0, 4: 71.0},
               {"X": dict(enumerate([1.0, 1.0, 2.0, 2.0, 2.0, 3.0]))}, {"X": {0: "P", 2: "Q"}})
    got = {r.brand: tuple(r)[1:] for r in prices.q2a_dated(spark, t).collect()}
    assert got == {"P": (1, 1, 1, 1.0), "Q": (1, 1, 1, 2.0)}
    near = {r.brand: tuple(r)[1:] for r in prices.q2a_dated(spark, t, horizon_days=1).collect()}
    assert near == {"P": (1, 1, 1, 1.0), "Q": (1, 1, 0, None)}


def test_dated_equals_plain_where_no_brand_changes(spark):
    t = Tables(spark, SF01)
    fixed = FakeTables(oil_price=t.oil_price, gas_price=t.gas_price, gas_station=t.gas_station,
                       brand_days=t.gas_price.join(t.gas_station, "station_id").select("station_id", "price_date", "brand"))
    for horizon in (None, 4):
        plain = sorted(tuple(r) for r in prices.q2a(spark, fixed, horizon_days=horizon).collect())
        dated = sorted(tuple(r) for r in prices.q2a_dated(spark, fixed, horizon_days=horizon).collect())
        assert dated == plain


def test_dated_pairs_add_up(spark):
    """Every (rise, station) pair counts for exactly one brand."""
    t = Tables(spark, SF01)
    whole = prices.q2a(spark, t).agg(F.sum("n_events"), F.sum("n_responded")).first()
    dated = prices.q2a_dated(spark, t).agg(F.sum("n_events"), F.sum("n_responded")).first()
    assert tuple(dated) == tuple(whole)


def test_no_panel_rows_are_multiplied(spark):
    """Waits and dated brands join no pair of event and station: no nested loop, no product."""
    t = Tables(spark, SF01)
    for df in (prices.q2a_waits(spark, t), prices.q2a_dated(spark, t), prices.station_with_dated_brand(t)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "CartesianProduct" not in plan
