"""raw files (S1–S4, T1, T3, T4, S6, S7) and the load round trip."""

import datetime as dt
import zipfile

from pyspark.sql import functions as F

from tidemark.operators.ingest import hourly_weather
from tidemark.plans import load as L
from tidemark.plans.runner import run
from tidemark.sources import files

HEADER_W = "지점,일시,기온(°C),강수량(mm),습도(%),체감온도(°C)"


def _minutes(day, hours, skip=()):
    out = []
    for hh in range(hours):
        for mm in range(60):
            if (hh, mm) in skip:
                continue
            p = "" if (hh, mm) == (0, 30) else ("0.1" if hh == 1 else "0")
            out.append(f"133,{day} {hh:02d}:{mm:02d},1.5,{p},50,{30 + hh * 5}")
    return out


def _write_zip(path, members):
    with zipfile.ZipFile(path, "w") as z:
        for name, lines in members.items():
            z.writestr(name, ("﻿" + "\n".join([HEADER_W] + lines) + "\n").encode("utf-8"))


def _raw(tmp_path):
    wdir = tmp_path / "weather"
    wdir.mkdir()
    _write_zip(wdir / "2026-01.zip", {"a.csv": _minutes("2026-01-05", 2, skip={(0, 7)}),
                                      "b.csv": _minutes("2026-01-06", 2)})
    rdir = tmp_path / "rentals"
    rdir.mkdir()
    rows = ["대여번호,대여대여소,대여일시,반납대여소,반납일시"]
    for i in range(6):
        rows.append(f"{i},ST{i % 2},2026-01-05 0{i % 2}:1{i}:00,ST0,2026-01-05 02:00:00")
    (rdir / "m1.csv").write_bytes(("﻿" + "\n".join(rows) + "\n").encode("utf-8"))
    oil = ["기준일,두바이,브렌트,WTI", "2026-01-05,70,71,69", "2026-01-06,71,72,70",
           "2026-01-07,,73,71", "2026-01-08,72,74,72"]
    (tmp_path / "oil.csv").write_text("\n".join(oil) + "\n", encoding="utf-8")
    gas = ["주유소,상표,일자,가격"]
    for i, p in enumerate([1600, 1600, 1610, 1610]):
        gas.append(f"G1,SK에너지,2026-01-0{5 + i},{p}")
    (tmp_path / "gas.csv").write_bytes(("\n".join(gas) + "\n").encode("cp949"))
    return wdir, rdir


def test_zip_two_members_bom_empty_cell(spark, tmp_path):
    wdir, _ = _raw(tmp_path)
    m = files.read_weather(spark, str(wdir))
    assert m.count() == 2 * 120 - 1               # one minute missing
    assert set(x.member for x in files.read_zip_lines(spark, str(wdir)).select("member")
               .distinct().collect()) == {"a.csv", "b.csv"}
    first = m.orderBy("obs_datetime").first()
    assert first.station_id == "133" and first.obs_datetime == dt.datetime(2026, 1, 5, 0, 0)
    empty = m.where(F.col("obs_datetime") == dt.datetime(2026, 1, 5, 0, 30)).first()
    assert empty.precipitation is None            # empty cell -> NULL, not 0
    hw = {r.obs_datetime: r for r in hourly_weather(m, "obs_datetime").collect()}
    h1 = hw[dt.datetime(2026, 1, 5, 1)]
    assert abs(h1.precipitation - 6.0) < 1e-9 and h1.feel_temp == 35.0 and h1.n_obs == 60
    assert hw[dt.datetime(2026, 1, 5, 0)].n_obs == 59


def test_cumulative_precipitation(spark):
    rows = [(dt.datetime(2026, 1, 5, 0, m), v) for m, v in [(0, 0.0), (59, 1.0)]] + \
           [(dt.datetime(2026, 1, 5, 1, m), v) for m, v in [(0, 1.5), (59, 3.0)]] + \
           [(dt.datetime(2026, 1, 6, 0, 10), 0.5)]
    df = spark.createDataFrame([(t, v, 20.0) for t, v in rows],
                               "obs_datetime timestamp_ntz, precipitation double, feel_temp double")
    got = {r.obs_datetime: r.precipitation
           for r in hourly_weather(df, precip_mode="cumulative").collect()}
    assert got == {dt.datetime(2026, 1, 5, 0): 1.0, dt.datetime(2026, 1, 5, 1): 2.0,
                   dt.datetime(2026, 1, 6, 0): 0.5}


def test_cp949_csv(spark, tmp_path):
    _raw(tmp_path)
    g = files.read_gas(spark, str(tmp_path / "gas.csv"), encoding="MS949")
    rows = g.orderBy("price_date").collect()
    assert rows[0].brand == "SK에너지" and rows[0].price == 1600.0
    assert rows[0].price_date == dt.date(2026, 1, 5)


def test_load_round_trip(spark, tmp_path):
    wdir, rdir = _raw(tmp_path)
    out = tmp_path / "tables"
    t, checks = L.load(spark, str(rdir), str(wdir), str(tmp_path / "oil.csv"),
                       str(tmp_path / "gas.csv"), str(out), encodings={"gas": "MS949"})
    assert t.rental.count() == 6
    assert t.oil_price.where("dubai IS NULL").count() == 1
    assert (out / "rental" / "rental_date=2026-01-05").exists()
    pk = {r.table_name: r.n_dup_keys for r in checks["pk"].collect()}
    assert set(pk.values()) == {0}
    fk = {r.relation: r.n_orphans for r in checks["fk"].collect()}
    assert set(fk.values()) == {0}
    audit = {r.table_name: (r.n_rows, r.matches) for r in checks["audit"].collect()}
    assert audit["weather_minute"] == (239, None)
    _, checks2 = L.load(spark, str(rdir), str(wdir), str(tmp_path / "oil.csv"),
                        str(tmp_path / "gas.csv"), str(tmp_path / "tables2"),
                        expected={"rental": 6, "weather_minute": 240},
                        encodings={"gas": "MS949"})
    audit2 = {r.table_name: r.matches for r in checks2["audit"].collect()}
    assert audit2["rental"] is True and audit2["weather_minute"] is False
    q = run(spark, "1-A", t)
    bands = {r.band: r.rentals for r in q.collect()}
    assert sum(bands.values()) == 6
    plan = q._jdf.queryExecution().executedPlan().toString()
    import re
    # Days outside the weather period are pruned from the scan.
    assert re.search(r"PartitionFilters: \[[^\]]*rental_date", plan), plan
    a = run(spark, "2-A", t).collect()
    assert [(x.brand, x.n_events) for x in a] == [("SK에너지", 2)]


def test_command_line(tmp_path):
    """python -m tidemark load / run in a separate process (its own session)."""
    import os
    import subprocess
    import sys
    wdir, rdir = _raw(tmp_path)
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = dict(os.environ, PYTHONPATH=root)
    base = [sys.executable, "-m", "tidemark", "--master", "local[2]"]
    out = tmp_path / "tables"
    subprocess.run(base + ["load", "--rentals", str(rdir), "--weather", str(wdir),
                           "--oil", str(tmp_path / "oil.csv"), "--gas", str(tmp_path / "gas.csv"),
                           "--out", str(out), "--gas-encoding", "MS949",
                           "--oil-columns", "price_date,dubai,brent,wti"],
                   check=True, env=env, cwd=root, capture_output=True, timeout=600)
    res = subprocess.run(base + ["run", "--tables", str(out), "1-A", "2-A",
                                 "--set", "crude=brent", "--out", str(tmp_path / "results")],
                         check=True, env=env, cwd=root, capture_output=True, text=True, timeout=600)
    assert "== 1-A" in res.stdout and "== 2-A" in res.stdout
    assert (tmp_path / "results" / "2-A").exists()
    res = subprocess.run(base + ["sql", "--tables", str(out), "SELECT count(*) AS n FROM rental r "
                                 "JOIN rental_station s ON s.station_id = r.rental_station_id"],
                         check=True, env=env, cwd=root, capture_output=True, text=True, timeout=600)
    assert res.stdout.split()[-2:] == ["n", "6"]


def test_zip_member_in_cp949(spark, tmp_path):
    wdir = tmp_path / "w949"
    wdir.mkdir()
    body = "\n".join([HEADER_W, "133,2026-01-05 00:00,1.5,0.5,50,30",
                      "133,2026-01-05 00:01,1.5,,50,31"]) + "\n"
    with zipfile.ZipFile(wdir / "m.zip", "w") as z:
        z.writestr("minutes.csv", body.encode("cp949"))
    m = files.read_weather(spark, str(wdir), encoding="MS949").orderBy("obs_datetime").collect()
    assert [(r.precipitation, r.feel_temp) for r in m] == [(0.5, 30.0), (None, 31.0)]
    names = [r.member for r in files.read_zip_lines(spark, str(wdir), encoding="MS949").collect()]
    assert len(names) == 2


def _period(tmp_path, name, gas_days, oil_days, weather_days, rental_rows, station="133"):
    """Raw files of one period; returns the arguments of the load."""
    d = tmp_path / name
    (d / "weather").mkdir(parents=True)
    (d / "rentals").mkdir()
    _write_zip(d / "weather" / "w.zip", {"m.csv": [ln.replace("133,", f"{station},", 1)
                                                   for day in weather_days for ln in _minutes(day, 2)]})
    (d / "rentals" / "r.csv").write_text("\n".join(["a,b,c,d,e"] + rental_rows) + "\n", encoding="utf-8")
    (d / "oil.csv").write_text("\n".join(["d,x,y,z"] + [f"{x},{70 + i},71,69" for i, x in enumerate(oil_days)])
                               + "\n", encoding="utf-8")
    (d / "gas.csv").write_text("\n".join(["s,b,d,p"] + [f"G{g},{b},{x},{1600 + i}" for g, b in ((1, "A"), (2, "B"))
                                                        for i, x in enumerate(gas_days)]) + "\n", encoding="utf-8")
    return str(d / "rentals"), str(d / "weather"), str(d / "oil.csv"), str(d / "gas.csv")


def _days(lo, n):
    return [str(dt.date.fromisoformat(lo) + dt.timedelta(days=i)) for i in range(n)]


def _stored(t):
    from tidemark import schemas
    return {n: sorted(map(str, t.stored(n).collect())) for n in schemas.STORED}


def _two_periods(tmp_path):
    r1 = ["1,S1,2026-01-05 00:10:00,,", "2,S2,2026-01-31 01:10:00,,"]
    r2 = ["3,S1,2026-02-01 00:10:00,,", "4,S3,2026-01-31 01:20:00,,"]       # a late row of January
    g1, g2 = _days("2026-05-07", 31), _days("2026-06-07", 30)
    w1, w2 = ["2026-01-05", "2026-01-31"], ["2026-02-01"]
    one = _period(tmp_path, "p1", g1, g1, w1, r1)
    two = _period(tmp_path, "p2", g2, g2, w2, r2)
    return one, two, (g1, g2, w1, w2, r1, r2)


def test_further_period_keeps_what_is_stored(spark, tmp_path):
    one, two, (g1, g2, w1, w2, r1, r2) = _two_periods(tmp_path)
    out = str(tmp_path / "t")
    t, _ = L.load(spark, *one, out)
    assert t.gas_price.count() == 62 and t.rental.count() == 2
    L.load(spark, *two, out)
    assert t.gas_price.count() == 122 and t.rental.count() == 4            # the same object sees them
    assert {r.station_id for r in t.rental_station.collect()} == {"S1", "S2", "S3"}
    assert not list((tmp_path / "t" / "_incoming").iterdir())
    both = _stored(t)
    results = {q: sorted(map(str, run(spark, q, t).collect())) for q in ("1-A", "1-B", "2-A", "2-B")}
    L.load(spark, *two, out)                                              # a repeat changes nothing
    L.load(spark, *one, out)
    assert _stored(t) == both
    # one load of everything, prices as the two files gave them
    d = tmp_path / "all"
    d.mkdir()
    for kind in ("rentals", "weather"):
        (d / kind).mkdir()
    for i, p in enumerate((one, two)):
        for k, kind in ((0, "rentals"), (1, "weather")):
            for f in __import__("pathlib").Path(p[k]).iterdir():
                (d / kind / f"{i}{f.name}").write_bytes(f.read_bytes())
    for k, name in ((2, "oil"), (3, "gas")):
        (d / name).mkdir()
        for i, p in enumerate((one, two)):
            (d / name / f"{i}.csv").write_bytes(open(p[k], "rb").read())
    a, _ = L.load(spark, *[str(d / x) for x in ("rentals", "weather", "oil", "gas")], str(tmp_path / "t2"))
    assert _stored(a) == both
    assert {q: sorted(map(str, run(spark, q, a).collect())) for q in results} == results


def test_formats_and_lost_cells(spark, tmp_path):
    g = [x.replace("-", "") for x in _days("2026-05-07", 3)]
    o = [x.replace("-", ".") for x in _days("2026-05-07", 3)]
    p = _period(tmp_path, "p", g, o, ["2026-01-05"], ["1,S1,2026-01-05 00:10:00,,", "2,S1,05/01/2026,,"])
    t, c = L.load(spark, *p, str(tmp_path / "t"))
    assert t.gas_price.where("price_date IS NULL").count() == 0
    assert t.oil_price.orderBy("price_date").first().price_date == dt.date(2026, 5, 7)
    audit = {r.table_name: r for r in c["audit"].collect()}
    assert audit["rental"].n_lost == 1 and audit["rental"].matches is False
    assert audit["gas_price"].n_lost == 0 and audit["gas_price"].matches is None
    t, c = L.load(spark, *p, str(tmp_path / "t2"), expected={"gas_price": 6},
                  formats={"gas": "dd.MM.yyyy", "oil": "yyyy.MM.dd"})
    audit = {r.table_name: r for r in c["audit"].collect()}
    assert audit["gas_price"].matches is False and audit["gas_price"].n_lost == 6
    assert {(r.table_name, r.column_name, r.n_lost) for r in c["parse"].collect()} == {
        ("gas_price", "price_date", 6), ("rental", "rental_time", 1)}


def test_weather_of_two_stations(spark, tmp_path):
    import pytest
    from tidemark.sources.sinks import ParquetTables
    days, rent = _days("2026-05-07", 2), ["1,S1,2026-01-05 00:10:00,,"]
    L.load(spark, *_period(tmp_path, "a", days, days, ["2026-01-05"], rent), str(tmp_path / "t"))
    one = run(spark, "1-A", ParquetTables(spark, str(tmp_path / "t"))).collect()
    t, c = L.load(spark, *_period(tmp_path, "b", days, days, ["2026-01-05"], rent, station="108"),
                  str(tmp_path / "t"))
    assert t.stored("weather").count() == 4
    assert {r.table_name: r.n_dup_keys for r in c["pk"].collect()}["weather"] == 0
    with pytest.raises(ValueError, match="several stations"):
        run(spark, "1-A", t)
    named = ParquetTables(spark, str(tmp_path / "t"), weather_station="133")
    assert sorted(map(str, run(spark, "1-A", named).collect())) == sorted(map(str, one))


def test_waits_and_dated_brands_of_loaded_tables(spark, tmp_path):
    one, two, _ = _two_periods(tmp_path)
    out = str(tmp_path / "t")
    L.load(spark, *one, out)
    t, _ = L.load(spark, *two, out)
    assert t.brand_days.columns == ["station_id", "price_date", "brand"]
    assert t.brand_days.count() == t.gas_price.count()
    waits = run(spark, "2-A-waits", t).collect()
    plain, dated = run(spark, "2-A", t).collect(), run(spark, "2-A-dated", t).collect()
    assert sum(r.n_events for r in dated) == sum(r.n_events for r in plain)
    assert sum(r.n_responded for r in dated) == sum(r.n_responded for r in plain)
    assert sum(r.n_responded for r in waits) == sum(r.n_responded for r in plain)


def test_raw_files_are_read_once(spark, tmp_path, monkeypatch):
    """Each source is written to the incoming folder in one job; all else reads that."""
    one, _, _ = _two_periods(tmp_path)
    seen = []
    write = L.write_table
    monkeypatch.setattr(L, "write_table", lambda df, path, *a: (seen.append(
        (path, any(f.startswith(f"file:{x}") or f.startswith(f"file://{x}") for f in df.inputFiles()
                   for x in one))), write(df, path, *a))[1])
    L.load(spark, *one, str(tmp_path / "t"))
    # the weather's own data source names no input files: three of the four writes tell theirs
    assert sum(raw for _, raw in seen) == 3 and all("_incoming" in p for p, raw in seen if raw)
    assert sorted(p.rsplit("/", 1)[1] for p, _ in seen if "_incoming" in p) == ["gas_price", "oil_price", "rental", "weather_minute"]
