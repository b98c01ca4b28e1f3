"""T2 and T1 as streams: rentals per hour (per station if asked), and weather
minutes from newly arriving ZIP archives rolled up to hours.

The batch roll-up (``operators.ingest.hourly_counts``) and this stream give the
same rows once the watermark has passed an hour. ``withWatermark`` needs a zoned
``timestamp``, so the local time is cast with the session zone and cast back.
State per hour is kept until the watermark passes it, then dropped.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.operators.ingest import typed
from tidemark.schemas import RENTAL
from tidemark.session import checkpoint_dir
from tidemark.sources import files


def rental_stream(spark: SparkSession, folder: str, fmt: str = "parquet",
                  glob: str | None = None, max_files_per_trigger: int | None = None,
                  encoding: str = "UTF-8", timestamp_format: str | None = None) -> DataFrame:
    """New rental files in ``folder`` as a stream with the rental schema.
    Parquet files hold the rental table itself; raw CSV files are read like the
    batch source (positional text columns, then typed)."""
    r = spark.readStream
    if glob:
        r = r.option("pathGlobFilter", glob)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    if fmt == "parquet":
        return r.schema(RENTAL).parquet(folder)
    if fmt != "csv":
        raise ValueError(fmt)
    raw = (r.schema(files.text_schema(files.RENTAL_COLUMNS)).option("header", True)
           .option("encoding", encoding).csv(folder))
    return typed(raw, RENTAL, timestamp_format=timestamp_format)


def hourly_rentals_stream(rentals: DataFrame, time_col: str = "rental_time",
                          lateness: str = "2 hours", by: list[str] | None = None) -> DataFrame:
    """Tumbling one-hour windows of rentals; rows later than ``lateness`` behind the
    newest seen time are dropped by the watermark. Output: obs_datetime, n_rentals."""
    ts = F.col(time_col).cast("timestamp")
    s = rentals.withColumn("_ts", ts).withWatermark("_ts", lateness)
    g = s.groupBy(F.window("_ts", "1 hour"), *(by or [])).agg(F.count("*").alias("n_rentals"))
    return g.select(F.col("window.start").cast("timestamp_ntz").alias("obs_datetime"),
                    *(by or []), "n_rentals")


def start_hourly(spark: SparkSession, rentals: DataFrame, sink_path: str, name: str = "hourly",
                 trigger_seconds: int | None = None, once: bool = False) -> StreamingQuery:
    """Append finished hours to Parquet at ``sink_path``. The checkpoint goes under
    the shared ``spark.checkpoint.dir`` so a restarted driver resumes exactly once."""
    ckpt = os.path.join(checkpoint_dir(spark), "streams", name)
    w = (hourly_rentals_stream(rentals).writeStream.outputMode("append").format("parquet")
         .option("path", sink_path).option("checkpointLocation", ckpt))
    if once:
        w = w.trigger(availableNow=True)
    elif trigger_seconds:
        w = w.trigger(processingTime=f"{trigger_seconds} seconds")
    return w.start()


# The binaryFile source's fixed schema (a stream must state it).
BINARY_FILE = "path STRING, modificationTime TIMESTAMP, length BIGINT, content BINARY"


def weather_stream(spark: SparkSession, folder: str, encoding: str = "UTF-8",
                   glob: str = "*.zip", timestamp_format: str | None = None) -> DataFrame:
    """New weather ZIP archives in ``folder`` as a stream of weather minutes."""
    archives = (spark.readStream.format("binaryFile").schema(BINARY_FILE)
                .option("pathGlobFilter", glob).load(folder))
    return files.parse_weather_lines(files.zip_lines(archives, encoding),
                                     timestamp_format=timestamp_format)


def hourly_weather_stream(minutes: DataFrame, lateness: str = "2 hours") -> DataFrame:
    """T1 over a stream (precipitation as per-minute increments): obs_datetime,
    precipitation (sum), feel_temp (max), n_obs. A running daily total needs the
    previous hour's value, which a windowed streaming aggregate cannot see; that
    mode stays batch (``operators.ingest.hourly_weather``)."""
    s = (minutes.withColumn("_ts", F.col("obs_datetime").cast("timestamp"))
         .withWatermark("_ts", lateness))
    g = s.groupBy(F.window("_ts", "1 hour")).agg(
        F.sum("precipitation").alias("precipitation"), F.max("feel_temp").alias("feel_temp"),
        F.count("*").alias("n_obs"))
    return g.select(F.col("window.start").cast("timestamp_ntz").alias("obs_datetime"),
                    "precipitation", "feel_temp", "n_obs")
