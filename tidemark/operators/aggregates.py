"""Conditional and two-level aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.time import _c


def ratio(num, den):
    """num / den as double; NULL when den is 0 or NULL (never an ANSI error).
    Both arguments are column names or Columns."""
    return _c(num).cast("double") / F.nullif(_c(den).cast("double"), F.lit(0.0))


def split_counts(df: DataFrame, key: str, flag: str, yes: str, no: str,
                 weight: str | None = None) -> DataFrame:
    """A3: one pass, two counts per key: rows where ``flag`` is true / false (or the sums of
    their ``weight``, where rows stand for several).
    Rows with a NULL flag count in neither. Partial aggregation runs map-side, so a
    key holding a large share of the rows is combined before the shuffle."""
    if weight:
        return df.groupBy(key).agg(F.sum(F.when(F.col(flag), F.col(weight)).otherwise(0)).alias(yes),
                                   F.sum(F.when(~F.col(flag), F.col(weight)).otherwise(0)).alias(no))
    return df.groupBy(key).agg(F.count_if(F.col(flag)).alias(yes),
                               F.count_if(~F.col(flag)).alias(no))


def asymmetry(df: DataFrame, phase_col: str, change_col: str,
              up: str = "rising", down: str = "falling") -> DataFrame:
    """A5 + A6: mean change in rising and in falling phases and their ratio
    ``|mean up| / |mean down|`` (NULL when there is no falling change or its mean is 0).
    One row."""
    is_up, is_down = F.col(phase_col) == up, F.col(phase_col) == down
    g = df.agg(F.count_if(is_up).alias("n_rising"),
               F.avg(F.when(is_up, F.col(change_col))).alias("avg_change_rising"),
               F.count_if(is_down).alias("n_falling"),
               F.avg(F.when(is_down, F.col(change_col))).alias("avg_change_falling"))
    return g.withColumn("asymmetry",
                        F.abs("avg_change_rising") / F.nullif(F.abs("avg_change_falling"), F.lit(0.0)))


def by_phase(df: DataFrame, phase_col: str, change_col: str) -> DataFrame:
    """A5 per phase: n_changes, avg_change."""
    return df.groupBy(phase_col).agg(F.count(change_col).alias("n_changes"),
                                     F.avg(change_col).alias("avg_change"))
