"""Sinks (S6) and table access over written tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.sources.manifest import NULL_PARTITION, Manifest, latest


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None,
                mode: str = "overwrite") -> None:
    """Parquet, partitioned by a date column. Overwrite is dynamic: only the
    partitions present in ``df`` are replaced. Rows are rebalanced on the partition
    column, so a day is written by few tasks and AQE splits a large one. Task retries
    and lost executors are covered by Spark's commit protocol (nothing is visible
    until the job commits)."""
    if partition_by:
        df = df.hint("rebalance", *partition_by)
    w = df.write.mode(mode).option("partitionOverwriteMode", "dynamic")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def write_generation(spark: SparkSession, df: DataFrame, root: str, table: str, gen: str,
                     partition: str | None = None, values: list | None = None) -> dict[str, str]:
    """Write rows as a new generation of a table; its partition folders with that generation.
    ``values``: of the partition column, if known (days, months and years: names need no escape)."""
    df = df.withColumn("gen", F.lit(gen))
    if not partition:
        write_table(df, f"{root}/{table}", ["gen"], "append")
        return {"": gen}
    write_table(df, f"{root}/{table}", [partition, "gen"], "append")
    values = [r[0] for r in df.select(partition).distinct().collect()] if values is None else values
    return {f"{partition}={NULL_PARTITION if v is None else v}": gen for v in values}


def merge_table(spark: SparkSession, new: DataFrame, tables: "ParquetTables", table: str, gen: str) -> dict[str, str]:
    """S6, repeatable: a stored row whose key is in ``new`` (NULL equals NULL) gives way
    to the new rows of that key; every other stored row stays. Loading the same rows
    again changes nothing. Only the partitions that ``new`` touches are read, and written
    as generation ``gen``; their names alone reach the driver. The generations of all
    partitions are returned; nothing is in force before a manifest names them.

    ``new`` is read twice: pass a written table, not a parse of raw files."""
    key, partition = schemas.MERGE_KEYS[table], schemas.PARTITIONS[table]
    names = [r[0] for r in new.select(partition).distinct().collect()]
    touched = F.col(partition).isin([n for n in names if n is not None])
    if None in names:
        touched = touched | F.col(partition).isNull()
    old = tables.stored(table, provenance=True).where(touched).alias("o")
    k = new.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(key)]).distinct()
    same = reduce(lambda a, b: a & b,
                  [F.col(f"o.{c}").eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(key)])
    rows = old.join(k, same, "left_anti").unionByName(new)
    before = tables.manifest.parts.get(table, {}) if tables.manifest else {}
    return before | write_generation(spark, rows, tables.root, table, gen, partition, names)


class ParquetTables:
    """The six tables as written by the load job under ``root`` (one folder each),
    read with their fixed schemas. Exposes the same attributes as
    ``sources.testdata.Tables``, so every query runs on either.

    The manifest in force is looked up at each use, and nothing derived is kept, so rows
    loaded later are seen; ``pinned`` holds one state for as long as a caller needs all
    tables of the same load. ``weather_station`` names the station whose weather the
    queries use; it is needed only where several are stored."""

    __slots__ = ("spark", "root", "weather_station", "_pinned")

    def __init__(self, spark: SparkSession, root: str, weather_station: str | None = None,
                 manifest: Manifest | None = None):
        self.spark, self.root = spark, root.rstrip("/")
        self.weather_station, self._pinned = weather_station, manifest

    @property
    def manifest(self) -> Manifest | None:
        return self._pinned or latest(self.spark, self.root)

    def pinned(self) -> "ParquetTables":
        """These tables as the manifest in force now names them, whatever is loaded later."""
        return ParquetTables(self.spark, self.root, self.weather_station, self.manifest)

    def stored(self, name: str, provenance: bool = False) -> DataFrame:
        """A table with every stored column, partition columns included; with ``provenance`` also
        those that only a further load reads. Before its first load a table has no rows."""
        schema, m = schemas.written(name) if provenance else schemas.STORED[name], self.manifest
        paths = m.paths(self.root, name) if m else []
        if not paths:
            return self.spark.createDataFrame([], schema)
        r = self.spark.read.schema(schema).option("basePath", f"{self.root}/{name}")
        return r.parquet(*paths).select(*schema.fieldNames())

    def period(self, name: str, time_col: str) -> DataFrame:
        """(lo, hi) of a time column as one row. The partition column orders as the time does, so the manifest's
        first and last value name the two partitions that hold the bounds; no other is read."""
        df, m, part = self.stored(name), self.manifest, schemas.PARTITIONS[name]
        values = m.values(name) if m else []
        if values:
            df = df.where(F.col(part).isin(sorted({values[0], values[-1]})))
        return df.agg(F.min(time_col).alias("lo"), F.max(time_col).alias("hi"))

    @property
    def brand_days(self) -> DataFrame:
        """The brand recorded beside each station price."""
        return self.stored("gas_price").select("station_id", "price_date", "brand")

    def _station_weather(self) -> DataFrame:
        w = self.stored("weather")
        if self.weather_station is not None:
            return w.where(F.col("station_id") == self.weather_station)
        some = [r[0] for r in w.select("station_id").distinct().limit(2).collect()]
        if len(some) > 1:
            raise ValueError(f"weather of several stations is stored ({some[0]}, {some[1]}, ...): "
                             "name one with weather_station")
        return w

    def __getattr__(self, name):
        if name.startswith("_") or name not in schemas.TABLES:
            raise AttributeError(name)
        df = self._station_weather() if name == "weather" else self.stored(name)
        # Partition columns stay visible so queries can prune on them.
        keep = [schemas.PARTITIONS[name]] if name in schemas.PARTITIONS else []
        return df.select(*schemas.TABLES[name].fieldNames(), *keep)

    def create_views(self) -> None:
        """Temporary views of the stored tables, for SQL."""
        for name in schemas.STORED:
            self.stored(name).createOrReplaceTempView(name)
