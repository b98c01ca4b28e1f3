"""The hourly stream gives the batch roll-up's rows."""

import datetime as dt
import uuid

from pyspark.sql import functions as F

from tests.conftest import SF01
from tidemark.plans import rentals
from tidemark.sources.testdata import Tables, rental
from tidemark.streaming.hourly import hourly_rentals_stream, rental_stream, start_hourly


def test_stream_equals_batch(spark, tmp_path):
    # Land the click events as rental files, then stream them.
    src = tmp_path / "rentals"
    rental(spark, SF01).repartition(4).write.parquet(str(src))
    s = rental_stream(spark, str(src), max_files_per_trigger=2)
    q = (hourly_rentals_stream(s).writeStream.outputMode("complete").format("memory")
         .queryName("hourly_test").start())
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    got = {tuple(r) for r in spark.sql("SELECT obs_datetime, n_rentals FROM hourly_test").collect()}
    want = {tuple(r) for r in rentals.hourly_rentals(Tables(spark, SF01).rental).collect()}
    assert got == want


def test_append_sink_with_checkpoint(spark, tmp_path):
    src = tmp_path / "rentals"
    rental(spark, SF01).write.parquet(str(src))
    out = tmp_path / "out"
    name = f"t_append_{uuid.uuid4().hex}"   # a fresh stream, not a resumed one
    q = start_hourly(spark, rental_stream(spark, str(src)), str(out), name=name, once=True)
    q.awaitTermination(120)
    rows = spark.read.parquet(str(out))
    # append mode emits hours the watermark has passed: all but the last ones
    n = rows.count()
    total = rentals.hourly_rentals(Tables(spark, SF01).rental).count()
    assert 0 < n <= total
    assert rows.agg(F.max("obs_datetime")).first()[0] is not None


def test_csv_stream(spark, tmp_path):
    src = tmp_path / "csv"
    src.mkdir()
    for m in range(2):
        lines = ["id,station,time,return_station,return_time"]
        lines += [f"{m * 10 + i},S{i % 2},2026-01-05 0{m}:{10 + i}:00,S0,2026-01-05 03:00:00"
                  for i in range(5)]
        (src / f"m{m}.csv").write_text("\n".join(lines) + "\n")
    s = rental_stream(spark, str(src), fmt="csv")
    q = (hourly_rentals_stream(s, by=["rental_station_id"]).writeStream.outputMode("complete")
         .format("memory").queryName("csv_hourly").start())
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    got = sorted(tuple(r) for r in spark.sql("SELECT * FROM csv_hourly").collect())
    h0, h1 = dt.datetime(2026, 1, 5, 0), dt.datetime(2026, 1, 5, 1)
    assert got == [(h0, "S0", 3), (h0, "S1", 2), (h1, "S0", 3), (h1, "S1", 2)]


def test_weather_zip_stream_equals_batch(spark, tmp_path):
    from tests.test_files import _raw
    from tidemark.operators.ingest import hourly_weather
    from tidemark.sources.files import read_weather
    from tidemark.streaming.hourly import hourly_weather_stream, weather_stream
    wdir, _ = _raw(tmp_path)
    q = (hourly_weather_stream(weather_stream(spark, str(wdir))).writeStream
         .outputMode("complete").format("memory").queryName("wx_hourly").start())
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    got = {tuple(r) for r in spark.sql("SELECT * FROM wx_hourly").collect()}
    want = {(r.obs_datetime, r.precipitation, r.feel_temp, r.n_obs)
            for r in hourly_weather(read_weather(spark, str(wdir))).collect()}
    assert got == want and len(got) == 4
