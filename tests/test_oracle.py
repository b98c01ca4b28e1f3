"""Every registered query against its DuckDB oracle at sf0.01 (the driver's gate)."""

import math

import duckdb
import pytest

from tests.conftest import SF01

import __spark_entry__ as E
from tidemark.plans.catalog import QUERIES

TABLES = ["events", "customer"]


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    return v


def _canon(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(_norm(r[i]) for i in order) for r in rows]
    return sorted(out, key=lambda t: tuple((x is None, str(x)) for x in t))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF01}/{t}.parquet')")
    return con


def test_every_query_has_oracle():
    assert set(QUERIES) <= set(E.queries()) and set(QUERIES) <= set(E.oracle_sql())


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_matches_oracle(spark, duck, key):
    df = E.queries()[key](spark, SF01)
    srows = [tuple(r) for r in df.collect()]
    res = duck.execute(E.oracle_sql()[key])
    dcols = [d[0] for d in res.description]
    drows = res.fetchall()
    assert sorted(df.columns) == sorted(dcols)
    assert _canon(srows, df.columns) == _canon(drows, dcols)


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert df.columns == ["band", "n_hours", "rentals", "avg_rentals"]
    # sf0.001 has hours with no event: four bands including 'unobserved'.
    assert {r.band for r in rows} == {"none", "lt10", "ge10", "unobserved"}
    assert sum(r.n_hours for r in rows) == 720


def test_trading_day_pairs_brute_force(spark, duck):
    from tidemark.plans import prices
    from tidemark.plans.oracle import _with
    from tidemark.sources.testdata import Tables
    sql = _with(["pairs", "oil"], """
SELECT p.station_id, p.event_date, p.response_date,
       CAST((SELECT count(*) FROM oil o WHERE o.price_date > p.event_date
                                        AND o.price_date <= p.response_date) AS INTEGER) AS response_days
FROM pairs p WHERE p.response_date IS NOT NULL""")
    want = sorted(duck.execute(sql).fetchall())
    t = Tables(spark, SF01)
    got = sorted(tuple(r) for r in prices.response_pairs(spark, t, unit="trading").collect())
    assert got == want
    by_brand = {}
    brands = dict(duck.execute("SELECT CAST(c_custkey AS VARCHAR), c_mktsegment FROM customer").fetchall())
    for s, _, _, dd in want:
        n, tot = by_brand.get(brands[s], (0, 0))
        by_brand[brands[s]] = (n + 1, tot + dd)
    agg = {r.brand: r for r in prices.q2a(spark, t, unit="trading").collect()}
    for b, (n, tot) in by_brand.items():
        assert agg[b].n_responded == n
        assert agg[b].avg_days == tot / n
