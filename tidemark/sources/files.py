"""File scans of the raw inputs.

CSV files are read by Spark's CSV reader with an all-text schema mapped by
position (the headers of public-data files change wording and language), then
typed by ``operators.ingest.typed``: an empty or malformed cell becomes NULL.

ZIP archives (S2) have no codec in Spark. In batch, ``sources.zips`` is a data source that
reads each member of each archive in its own task, as a stream; for streams of new
archives ``binaryFile`` lists and reads them and a ``mapInPandas`` step unzips. Both give
text lines (in bounded batches), which the JVM's ``from_csv`` parses.
"""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tidemark import schemas
from tidemark.operators.ingest import typed
from tidemark.sources.zips import codec_of, reachable, register

# Column layouts of the raw files, in file order (positional; header row skipped).
RENTAL_COLUMNS = ["rental_id", "rental_station_id", "rental_time", "return_station_id",
                  "return_time"]
WEATHER_COLUMNS = ["station_id", "obs_datetime", "temperature", "precipitation", "humidity",
                   "feel_temp"]
OIL_COLUMNS = ["price_date", "dubai", "brent", "wti"]
GAS_COLUMNS = ["station_id", "brand", "price_date", "price"]

LINE_BATCH = 50_000


def text_schema(columns: list[str]) -> StructType:
    return StructType([StructField(c, StringType(), True) for c in columns])


def read_csv_text(spark: SparkSession, path: str, columns: list[str],
                  encoding: str = "UTF-8", header: bool = True, sep: str = ",") -> DataFrame:
    """All columns as text, by position. ``encoding``: UTF-8 (a byte-order mark is
    skipped) or MS949 / CP949 for Korean public data (needs
    ``spark.sql.legacy.javaCharsets=true``)."""
    return (spark.read.schema(text_schema(columns))
            .option("header", header).option("encoding", encoding).option("sep", sep)
            .option("mode", "PERMISSIVE").option("enforceSchema", True)
            .csv(path))


def read_rentals(spark: SparkSession, path: str, columns=RENTAL_COLUMNS, encoding="UTF-8",
                 timestamp_format: str | None = None, lost: str | None = None) -> DataFrame:
    """A folder (or glob) of rental CSV files -> rental with source_file, the name of
    the file a row stands in. ``lost``: see ``typed``."""
    raw = read_csv_text(spark, path, list(columns), encoding)
    raw = raw.select("*", F.col("_metadata.file_name").alias("source_file"))
    s = StructType(schemas.RENTAL.fields + [StructField("source_file", StringType())])
    return typed(raw, s, timestamp_format=timestamp_format, lost=lost)


def read_oil(spark: SparkSession, path: str, columns=OIL_COLUMNS, encoding="UTF-8",
             date_format: str | None = None, lost: str | None = None) -> DataFrame:
    """S3: the wide oil price CSV -> oil_price."""
    raw = read_csv_text(spark, path, list(columns), encoding)
    return typed(raw, schemas.OIL_PRICE, date_format=date_format, lost=lost)


def read_gas(spark: SparkSession, path: str, columns=GAS_COLUMNS, encoding="UTF-8",
             date_format: str | None = None, lost: str | None = None) -> DataFrame:
    """Station price CSV -> (station_id, brand, price_date, price).
    The brand is kept for the station master (T3)."""
    raw = read_csv_text(spark, path, list(columns), encoding)
    s = StructType(schemas.GAS_PRICE.fields[:1] + [StructField("brand", StringType())]
                   + schemas.GAS_PRICE.fields[1:])
    return typed(raw, s, date_format=date_format, lost=lost)


def _unzip_lines(encoding: str, header: bool):
    codec = codec_of(encoding)

    def run(batches):
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"]):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for member in z.infolist():
                        if member.is_dir():
                            continue
                        with z.open(member) as fh:
                            text = io.TextIOWrapper(fh, encoding=codec, newline="")
                            lines: list[str] = []
                            for i, line in enumerate(text):
                                if header and i == 0:
                                    continue
                                line = line.rstrip("\r\n")
                                if line:
                                    lines.append(line)
                                if len(lines) >= LINE_BATCH:
                                    yield pd.DataFrame({"path": path, "member": member.filename,
                                                        "line": lines})
                                    lines = []
                            if lines:
                                yield pd.DataFrame({"path": path, "member": member.filename,
                                                    "line": lines})
    return run


def zip_lines(archives: DataFrame, encoding: str = "UTF-8", header: bool = True) -> DataFrame:
    """(path, content) rows of ZIP archives -> (path, member, line). Works on a
    batch or a streaming ``binaryFile`` DataFrame; one archive is read by one task."""
    return archives.select("path", "content").mapInPandas(
        _unzip_lines(encoding, header), "path string, member string, line string")


def read_zip_lines(spark: SparkSession, path: str, encoding: str = "UTF-8",
                   header: bool = True, glob: str = "*.zip") -> DataFrame:
    """Every text line of every member of every ZIP under ``path``; a member is read by one task.
    In a store that only Spark reads, one task reads a whole archive."""
    if not reachable(path):
        return zip_lines(spark.read.format("binaryFile").option("pathGlobFilter", glob)
                         .option("recursiveFileLookup", True).load(path), encoding, header)
    register(spark)
    return (spark.read.format("zip_lines").option("encoding", encoding).option("header", str(header).lower())
            .option("glob", glob).load(path))


def parse_weather_lines(lines: DataFrame, columns=WEATHER_COLUMNS,
                        timestamp_format: str | None = None,
                        lost: str | None = None) -> DataFrame:
    """CSV text lines -> weather_minute (parsed in the JVM by ``from_csv``)."""
    parsed = lines.select(F.from_csv("line", text_schema(list(columns)).simpleString()).alias("r"))
    return typed(parsed.select("r.*"), schemas.WEATHER_MINUTE, timestamp_format=timestamp_format,
                 lost=lost)


def read_weather(spark: SparkSession, path: str, columns=WEATHER_COLUMNS, encoding="UTF-8",
                 timestamp_format: str | None = None, lost: str | None = None) -> DataFrame:
    """Per-minute weather from ZIP archives -> weather_minute. One task unzips a
    member; its lines are then spread over tasks of even size."""
    lines = read_zip_lines(spark, path, encoding).hint("rebalance")
    return parse_weather_lines(lines, columns, timestamp_format, lost)
