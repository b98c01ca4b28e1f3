"""One explicit schema per table. No schema inference anywhere."""

from pyspark.sql.types import (
    DateType, DoubleType, StringType, StructField, StructType, TimestampNTZType, LongType,
)


def _s(*fields) -> StructType:
    return StructType([StructField(n, t, True) for n, t in fields])


RENTAL_STATION = _s(("station_id", StringType()), ("station_name", StringType()))

# Hourly weather, the grain the queries use.
WEATHER = _s(("obs_datetime", TimestampNTZType()), ("precipitation", DoubleType()),
             ("feel_temp", DoubleType()))

# Per-minute weather as observed (before the T1 roll-up).
WEATHER_MINUTE = _s(("station_id", StringType()), ("obs_datetime", TimestampNTZType()),
                    ("temperature", DoubleType()), ("precipitation", DoubleType()),
                    ("humidity", DoubleType()), ("feel_temp", DoubleType()))

RENTAL = _s(("rental_id", LongType()), ("rental_station_id", StringType()),
            ("rental_time", TimestampNTZType()))

OIL_PRICE = _s(("price_date", DateType()), ("dubai", DoubleType()), ("brent", DoubleType()),
               ("wti", DoubleType()))

GAS_STATION = _s(("station_id", StringType()), ("brand", StringType()))

GAS_PRICE = _s(("station_id", StringType()), ("price_date", DateType()), ("price", DoubleType()))

CRUDES = ("dubai", "brent", "wti")

TABLES = {
    "rental_station": RENTAL_STATION,
    "weather": WEATHER,
    "rental": RENTAL,
    "oil_price": OIL_PRICE,
    "gas_station": GAS_STATION,
    "gas_price": GAS_PRICE,
}

# Partition column of each stored fact.
PARTITIONS = {"rental": "rental_date", "weather_minute": "obs_month", "weather": "obs_month",
              "oil_price": "price_year", "gas_price": "price_month"}

# Tables as stored: all columns of the weather per station, and the brand beside each
# station price (the station master is derived from it).
STORED = {
    "rental_station": RENTAL_STATION,
    "weather_minute": StructType(WEATHER_MINUTE.fields + [StructField("obs_month", StringType())]),
    "weather": _s(("station_id", StringType()), ("obs_datetime", TimestampNTZType()),
                  ("precipitation", DoubleType()), ("feel_temp", DoubleType()),
                  ("temperature", DoubleType()), ("humidity", DoubleType()),
                  ("n_obs", LongType()), ("obs_month", StringType())),
    "rental": StructType(RENTAL.fields + [StructField("rental_date", DateType())]),
    "oil_price": StructType(OIL_PRICE.fields + [StructField("price_year", StringType())]),
    "gas_station": GAS_STATION,
    "gas_price": StructType(GAS_PRICE.fields + [StructField("brand", StringType()),
                                                StructField("price_month", StringType())]),
}

# Columns that are written beside the stored ones and only read by a further load: the
# file a rental stands in.
PROVENANCE = {"rental": [StructField("source_file", StringType())]}


def written(name: str) -> StructType:
    """A stored table's columns as written, provenance included (partition column last)."""
    fields = STORED[name].fields
    return StructType(fields[:-1] + PROVENANCE.get(name, []) + fields[-1:])


# Keys by which a further load replaces stored rows. Rentals declare no key: a load
# replaces the equal rows of the same file, so equal rows of one or of several files all stay.
MERGE_KEYS = {
    "rental": [*RENTAL.fieldNames(), "source_file"],
    "weather_minute": ["station_id", "obs_datetime"],
    "oil_price": ["price_date"],
    "gas_price": ["station_id", "price_date"],
}

# Primary and foreign keys as declared by the reference's DDL (checked by Q1/Q2,
# never enforced by storage).
PRIMARY_KEYS = {
    "rental_station": ["station_id"],
    "weather": ["obs_datetime"],
    "oil_price": ["price_date"],
    "gas_station": ["station_id"],
    "gas_price": ["station_id", "price_date"],
}
FOREIGN_KEYS = [
    ("rental", "rental_station_id", "rental_station", "station_id"),
    ("gas_price", "station_id", "gas_station", "station_id"),
]

# Row counts the reference publishes for its data
# (rentals 2026-01..03, weather minutes at station 133 2026-01..03,
# oil prices 2023-01-03..2026-06-04, station prices 2026-05-07..2026-06-06).
PUBLISHED_COUNTS = {
    "rental": 1319762,
    "weather_minute": 129594,
    "oil_price": 883,
    "gas_price": 6101,
}
