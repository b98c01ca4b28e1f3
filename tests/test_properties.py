"""Property tests: the linear-time time joins against brute force on random inputs."""

import datetime as dt

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.operators.asof import asof_fill, next_event_pairs, next_event_stats

D0 = dt.date(2026, 5, 1)
SETTINGS = settings(max_examples=12, deadline=None,
                    suppress_health_check=[HealthCheck.function_scoped_fixture])

days = st.sets(st.integers(0, 25), max_size=8)
panels = st.dictionaries(st.sampled_from(["A", "B", "C"]),
                         st.dictionaries(st.integers(0, 30), st.booleans(), min_size=1, max_size=12),
                         min_size=1, max_size=3)


def brute_pairs(ev, panel, horizon):
    out = set()
    for key, rows in panel.items():
        rises = sorted(d for d, r in rows.items() if r)
        for e in ev:
            later = [r for r in rises if r > e]
            if later and (horizon is None or later[0] - e <= horizon):
                out.add((key, e, later[0]))
    return out


def _frames(spark, ev, panel):
    e = spark.createDataFrame([(D0 + dt.timedelta(days=d),) for d in sorted(ev)] or [],
                              "event_date date")
    rows = [(k, D0 + dt.timedelta(days=d), r) for k, v in panel.items() for d, r in v.items()]
    p = spark.createDataFrame(rows, "station_id string, price_date date, is_rise boolean")
    return e, p


@SETTINGS
@given(ev=days, panel=panels, horizon=st.one_of(st.none(), st.integers(1, 6)))
def test_next_event_matches_brute_force(spark, ev, panel, horizon):
    e, p = _frames(spark, ev, panel)
    want = brute_pairs(ev, panel, horizon)
    got_pairs = {(r.station_id, (r.event_date - D0).days, (r.response_date - D0).days)
                 for r in next_event_pairs(spark, e, "event_date", p, "station_id", "price_date",
                                           "is_rise", horizon).collect()}
    assert got_pairs == want
    stats = {r.station_id: r for r in next_event_stats(
        spark, e, "event_date", p, "station_id", "price_date", "is_rise", horizon).collect()}
    assert set(stats) == set(panel)
    for key in panel:
        mine = [(ee, r) for k, ee, r in want if k == key]
        assert stats[key].n_events == len(ev)
        assert stats[key].n_responded == len(mine)
        assert stats[key].sum_days == sum(r - ee for ee, r in mine)


@SETTINGS
@given(obs=st.dictionaries(st.integers(0, 20), st.floats(0, 100, allow_nan=False), min_size=1,
                           max_size=8),
       extra=st.integers(0, 5))
def test_asof_fill_matches_brute_force(spark, obs, extra):
    s = spark.createDataFrame([(D0 + dt.timedelta(days=d), v) for d, v in obs.items()],
                              "d date, v double")
    hi = max(obs) + extra
    got = {(r.cal_date - D0).days: (r.v, (r.asof_date - D0).days)
           for r in asof_fill(s, "d", ["v"], hi=F.lit(D0 + dt.timedelta(days=hi))).collect()}
    want = {}
    for day in range(min(obs), hi + 1):
        src = max(d for d in obs if d <= day)
        want[day] = (obs[src], src)
    assert got == want
