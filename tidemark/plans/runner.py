"""Run a named query over a set of tables and return its rows as a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.plans import prices, rentals

QUERIES = {
    "1-A": rentals.q1a,
    "1-B": rentals.q1b,
    "2-A": prices.q2a,
    "2-A-waits": prices.q2a_waits,
    "2-A-dated": prices.q2a_dated,
    "2-B": prices.q2b,
}


def run(spark: SparkSession, name: str, tables, **params) -> DataFrame:
    """``tables``: ``sources.testdata.Tables`` or ``sources.sinks.ParquetTables``.
    All stored tables are those of one load. The caller shows, collects or writes the result."""
    if hasattr(tables, "pinned"):
        tables = tables.pinned()
    return QUERIES[name](spark, tables, **params)
