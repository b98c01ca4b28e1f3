"""Wide crude columns to rows."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tidemark.schemas import CRUDES


def crudes_long(oil: DataFrame, date_col: str = "price_date",
                crudes=CRUDES) -> DataFrame:
    """(price_date, dubai, brent, wti) -> (price_date, crude, price); NULL prices dropped."""
    return (oil.unpivot([date_col], list(crudes), "crude", "price")
               .where("price IS NOT NULL"))
