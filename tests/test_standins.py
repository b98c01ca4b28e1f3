"""The stand-in tables reproduce the figures measured in FIXTURES.md §3."""

import pytest

from tidemark.plans import rentals
from tidemark.sources.testdata import Tables

# Fixed values (FIXTURES.md §3): hours per band, hot hours, 1-A 'none' mean with the
# hour side kept, stations, stations without a hot-hour rental.
FACTS = {
    "0.001": ({"none": 326, "lt10": 138, "ge10": 67, "unobserved": 189}, 136, 0.3957, 15, 0),
    "0.01": ({"none": 474, "lt10": 161, "ge10": 85}, 199, 2.7890, 150, 3),
    "0.1": ({"none": 447, "lt10": 172, "ge10": 101}, 186, 27.5302, 1500, 53),
}


@pytest.mark.parametrize("sf", sorted(FACTS))
def test_fixture_facts(spark, sf):
    bands, hot, none_mean, n_st, no_hot = FACTS[sf]
    t = Tables(spark, f"/root/testdata/sf{sf}")
    a = {r.band: r for r in rentals.q1a(spark, t).collect()}
    assert {b: r.n_hours for b, r in a.items()} == bands
    assert round(a["none"].avg_rentals, 4) == none_mean
    assert t.weather.where("feel_temp >= 35").count() == hot
    c = rentals.station_heat_counts(t)
    assert c.count() == n_st
    assert c.where("hot_rentals = 0").count() == no_hot
