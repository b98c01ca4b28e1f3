"""The load job: raw files -> typed, checked, partitioned Parquet tables.

read and type (S1–S4, T4) once into an incoming folder -> merge into the stored facts
(S6) -> roll the touched months of weather up to hours (T1) -> derive the station
masters from all stored facts (T3) -> key, count and parse checks (Q1–Q3).

A load may be repeated or run again after a failure, and a further period adds to what
is stored: facts are merged by key, and everything derived comes from stored facts. All
tables change at once, when the load's manifest is put in force as its last step.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.operators import quality
from tidemark.operators.ingest import hourly_weather, station_master
from tidemark.sources import files
from tidemark.sources.manifest import Manifest, commit, remove_path, sweep
from tidemark.sources.sinks import ParquetTables, merge_table, write_generation, write_table

SOURCES = ("rentals", "weather", "oil", "gas")
LOST = "_lost"          # names of the cells of a row that held text but no value


def read_raw(spark: SparkSession, rentals: str, weather: str, oil: str, gas: str,
             encoding: str = "UTF-8", timestamp_format: str | None = None,
             encodings: dict[str, str] | None = None,
             columns: dict[str, list[str]] | None = None,
             formats: dict[str, str] | None = None,
             weather_station: str | None = None) -> dict[str, DataFrame]:
    """The four facts from the raw files, lazily, each with its partition column and
    ``_lost``. ``encodings``, ``columns`` (names in file order) and ``formats`` (of the
    timestamp of rentals and weather, of the date of oil and gas) are given per source:
    keys rentals, weather, oil, gas."""
    enc = dict.fromkeys(SOURCES, encoding) | (encodings or {})
    cols = {"rentals": files.RENTAL_COLUMNS, "weather": files.WEATHER_COLUMNS,
            "oil": files.OIL_COLUMNS, "gas": files.GAS_COLUMNS} | (columns or {})
    fmt = {"rentals": timestamp_format, "weather": timestamp_format} | (formats or {})
    rental = files.read_rentals(spark, rentals, cols["rentals"], enc["rentals"],
                                fmt.get("rentals"), lost=LOST)
    minute = files.read_weather(spark, weather, cols["weather"], enc["weather"],
                                fmt.get("weather"), lost=LOST)
    if weather_station is not None:
        minute = minute.where(F.col("station_id") == weather_station)
    oil_price = files.read_oil(spark, oil, cols["oil"], enc["oil"], fmt.get("oil"), lost=LOST)
    gas_price = files.read_gas(spark, gas, cols["gas"], enc["gas"], fmt.get("gas"), lost=LOST)
    return {
        "rental": rental.withColumn("rental_date", F.to_date("rental_time")),
        "weather_minute": minute.withColumn("obs_month", F.date_format("obs_datetime", "yyyy-MM")),
        "oil_price": oil_price.withColumn("price_year", F.date_format("price_date", "yyyy")),
        "gas_price": gas_price.withColumn("price_month", F.date_format("price_date", "yyyy-MM")),
    }


def masters(t: ParquetTables) -> dict[str, DataFrame]:
    """No station file exists, so each master comes from its stored fact; the latest
    brand of a station wins."""
    rental = station_master(t.stored("rental"), "rental_station_id", "rental_time")
    # One row per station and brand first: the string maximum then runs on few rows.
    g = t.stored("gas_price").groupBy("station_id", "brand").agg(F.max("price_date").alias("d"))
    return {
        "rental_station": rental.select("station_id",
                                        F.lit(None).cast("string").alias("station_name")),
        "gas_station": g.groupBy("station_id").agg(
            F.max(F.struct("d", "brand"))["brand"].alias("brand")),
    }


def check_tables(t, expected: dict[str, int] | None = None,
                 lost: dict[str, int] | None = None) -> dict[str, DataFrame]:
    """Q1–Q3 over loaded tables. ``lost``: cells per table lost in parsing; any fails
    that table's audit."""
    df = {n: t.stored(n) for n in schemas.STORED}
    time = {"rental": "rental_time", "weather": "obs_datetime", "oil_price": "price_date",
            "gas_price": "price_date", "weather_minute": "obs_datetime"}
    keys = schemas.PRIMARY_KEYS | {"weather": ["station_id", "obs_datetime"]}
    return {
        "pk": quality.pk_summary({n: (df[n], k) for n, k in keys.items()}),
        "fk": quality.fk_summary({f"{f}.{fk}->{d}.{pk}": (df[f], fk, df[d], pk)
                                  for f, fk, d, pk in schemas.FOREIGN_KEYS}),
        "audit": quality.count_audit({n: (df[n], c) for n, c in time.items()}, expected, lost or {}),
    }


def load(spark: SparkSession, rentals: str, weather: str, oil: str, gas: str, out_root: str,
         expected: dict[str, int] | None = None, precip_mode: str = "increment",
         feel: str = "max", **kw) -> tuple[ParquetTables, dict[str, DataFrame]]:
    """Run the whole load and return the written tables with their check reports (pk, fk,
    audit, and parse: cells with text that became NULL, by table and column).
    ``expected``: row counts to reconcile with (e.g. ``schemas.PUBLISHED_COUNTS``).
    Further arguments: see ``read_raw``."""
    root, gen = out_root.rstrip("/"), uuid.uuid4().hex
    sweep(spark, root, schemas.STORED)                     # what a load that died has left
    t = ParquetTables(spark, root, kw.get("weather_station"))
    before = t.pinned()
    incoming = f"{root}/_incoming/{gen}"
    report: list[tuple[str, str, int]] = []
    new: dict[str, DataFrame] = {}
    for name, df in read_raw(spark, rentals, weather, oil, gas, **kw).items():
        path, part = f"{incoming}/{name}", schemas.PARTITIONS[name]
        write_table(df, path, [part])                  # the only parse of the raw files
        got = spark.read.schema(df.schema).parquet(path)
        report += [(name, r[0], r[1]) for r in
                   got.select(F.explode(LOST).alias("c")).groupBy("c").count().collect()]
        new[name] = got.select(*schemas.written(name).fieldNames())
    months = [r[0] for r in new["weather_minute"].select("obs_month").distinct().collect()]
    old = before.manifest or Manifest()
    parts = dict(old.parts)
    for name, df in new.items():
        parts[name] = merge_table(spark, df, before, name, gen)
    after = ParquetTables(spark, root, manifest=Manifest(old.number + 1, parts))       # not yet in force
    minute = after.stored("weather_minute").where(F.col("obs_month").isin([m for m in months if m]))
    hourly = hourly_weather(minute, "obs_datetime", precip_mode, by=["station_id"], feel=feel)
    hourly = hourly.withColumn("obs_month", F.date_format("obs_datetime", "yyyy-MM"))
    parts["weather"] = parts.get("weather", {}) | write_generation(
        spark, hourly.select(*schemas.STORED["weather"].fieldNames()), root, "weather", gen, schemas.PARTITIONS["weather"])
    for name, df in masters(after).items():
        parts[name] = write_generation(spark, df, root, name, gen)
    commit(spark, root, after.manifest)
    remove_path(spark, incoming)
    lost: dict[str, int] = {}
    for name, _, n in report:
        lost[name] = lost.get(name, 0) + n
    checks = check_tables(t, expected, lost)
    checks["parse"] = spark.createDataFrame(sorted(report),
                                            "table_name string, column_name string, n_lost long")
    return t, checks
