"""Structured Streaming forms of the hourly roll-ups, for rental files that keep
arriving (one CSV or Parquet file per period dropped into a folder)."""
