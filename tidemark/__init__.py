"""tidemark: Spark-native analytics for events and prices tied to time and place.

Layout
------
- ``sources``   scans (CSV, zipped CSV, Parquet stand-ins) and sinks
- ``functions`` column expressions (time buckets, bands, predicates)
- ``operators`` DataFrame operators (roll-ups, spines, windows, as-of joins,
  conditional aggregates, lag correlation, data-quality checks)
- ``plans``     the composed queries and the registry used by ``__spark_entry__``
- ``streaming`` the hourly roll-up as a Structured Streaming job
"""

__version__ = "0.1.0"
