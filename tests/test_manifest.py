"""Loads that appear at once, rentals that keep their number, bounds from partition names."""

import pytest
from pyspark.sql import functions as F

from tests.test_files import _days, _period, _stored, _two_periods
from tidemark.plans import load as L
from tidemark.plans import prices
from tidemark.plans.runner import run
from tidemark.sources import manifest as M
from tidemark.sources.sinks import ParquetTables
from tidemark.sources.testdata import Tables
from tests.conftest import SF001


class Killed(Exception):
    pass


def test_a_dead_load_leaves_the_old_state(spark, tmp_path, monkeypatch):
    """The load dies after each of its steps; readers see the state before, all tables of it."""
    one, two, _ = _two_periods(tmp_path)
    out = str(tmp_path / "t")
    for after in range(7):
        t = ParquetTables(spark, out)
        before = _stored(t)
        calls = []

        def dying(f, n=after):
            def go(*a, **k):
                if len(calls) >= n:
                    raise Killed
                calls.append(f.__name__)
                return f(*a, **k)
            return go

        with monkeypatch.context() as m:
            for name in ("merge_table", "write_generation", "commit"):
                m.setattr(L, name, dying(getattr(L, name)))
            with pytest.raises(Killed):
                L.load(spark, *(one if after == 0 else two), out)
        assert _stored(t) == before and t.pinned().manifest == t.manifest, calls
        if after == 0:
            assert t.rental.count() == 0 and t.manifest is None        # nothing before the first load
            L.load(spark, *one, out)
    dead = [p for p in (tmp_path / "t").rglob("gen=*") if p.is_dir()]
    t, _ = L.load(spark, *two, out)
    assert t.gas_price.count() == 122 and t.rental.count() == 4 and t.manifest.number == 2
    # the next load sweeps what neither of the last two manifests names
    used = {p for n in ("000000000001.json", "000000000002.json") for table in L.schemas.STORED for p in M._read(spark, out, n).paths(out, table)}
    left = {str(p) for p in (tmp_path / "t").rglob("gen=*") if p.is_dir()}
    assert left == used and len(dead) > len(used) // 2 and not list((tmp_path / "t" / "_incoming").iterdir())


def test_pinned_tables_keep_one_state(spark, tmp_path):
    one, two, _ = _two_periods(tmp_path)
    t, _ = L.load(spark, *one, str(tmp_path / "t"))
    held = t.pinned()
    L.load(spark, *two, str(tmp_path / "t"))
    assert held.gas_price.count() == 62 and t.gas_price.count() == 122
    with pytest.raises(RuntimeError):                                  # a load that began from the same state
        M.commit(spark, t.root, M.Manifest(2, {}))
    assert t.manifest.number == 2 and not [n for n in M.names_in(spark, f"{t.root}/_manifest") if "draft" in n]


def test_equal_rentals_keep_their_number(spark, tmp_path):
    days = _days("2026-05-07", 3)
    twice = [",S1,2026-01-05 00:10:00,,"] * 2
    one = _period(tmp_path, "p1", days, days, ["2026-01-05"], twice)
    two = _period(tmp_path, "p2", days, days, ["2026-01-05"], twice[:1])
    rentals = tmp_path / "p2" / "rentals"
    for f in list(rentals.iterdir()) if rentals.exists() else []:
        f.rename(f.with_name("other.csv"))
    out = str(tmp_path / "t")
    t, _ = L.load(spark, *one, out)
    assert t.rental.count() == 2
    L.load(spark, *two, out)
    assert t.rental.count() == 3                                       # two of one file, one of another
    L.load(spark, *one, out)
    L.load(spark, *two, out)
    assert t.rental.count() == 3


def _text(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_bounds_come_from_two_partitions(spark, tmp_path):
    one, two, _ = _two_periods(tmp_path)
    L.load(spark, *one, str(tmp_path / "t"))
    t, _ = L.load(spark, *two, str(tmp_path / "t"))
    assert t.manifest.values("gas_price") == ["2026-05", "2026-06", "2026-07"]
    want = t.gas_price.agg(F.min("price_date"), F.max("price_date")).first()
    assert tuple(t.period("gas_price", "price_date").first()) == tuple(want)
    plan = t.period("gas_price", "price_date")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [price_month" in plan and "2026-06" not in plan
    oil = t.oil_price.where("dubai IS NOT NULL").agg(F.min("price_date").alias("lo"), F.max("price_date").alias("hi")).first()
    assert tuple(prices.common_period(t).first()) == (max(oil.lo, want[0]), min(oil.hi, want[1]))
    empty = ParquetTables(spark, str(tmp_path / "none"))
    assert tuple(empty.period("gas_price", "price_date").first()) == (None, None)


def test_no_aggregate_over_the_panel_for_bounds(spark):
    """Neither T5 nor the bounds of 2-A's events group by station and day."""
    t = Tables(spark, SF001)
    stations = lambda df: [line for line in _text(df).splitlines() if "cast(user_id" in line]
    assert stations(t.gas_price) and not stations(prices.common_period(t))
    assert not stations(prices.rise_events(t)) and not stations(prices.crude_rise_events(t))
    assert tuple(t.period("gas_price", "price_date").first()) == tuple(t.gas_price.agg(F.min("price_date"), F.max("price_date")).first())


def test_a_named_query_reads_one_load(spark, tmp_path):
    one, _, _ = _two_periods(tmp_path)
    t, _ = L.load(spark, *one, str(tmp_path / "t"))
    assert len(run(spark, "2-A", t).collect()) == len(run(spark, "2-A", t.pinned()).collect())
