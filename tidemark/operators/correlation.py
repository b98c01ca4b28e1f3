"""Correlation of two daily series at calendar lags 0..K."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F



def lag_correlation(x: DataFrame, x_date: str, x_val: str, y: DataFrame, y_date: str,
                    y_val: str, max_lag: int = 7) -> DataFrame:
    """For k in 0..max_lag: corr(x(d), y(d + k)) over the days where both exist.

    ``x`` is replicated K+1 times (it is a daily series, so K+1 times its span in
    rows) and equi-joined to ``y`` on the shifted day; no range or cross join.
    Returns lag_days, n_pairs, corr.
    """
    lags = F.explode(F.sequence(F.lit(0), F.lit(int(max_lag)))).alias("lag_days")
    xs = (x.select(F.col(x_date).alias("_xd"), F.col(x_val).alias("_x"), lags)
           .withColumn("_d", F.date_add(F.col("_xd"), F.col("lag_days"))))
    ys = y.select(F.col(y_date).alias("_d"), F.col(y_val).alias("_y"))
    j = ys.join(xs, "_d")
    return (j.groupBy("lag_days")
             .agg(F.count(F.when(F.col("_x").isNotNull() & F.col("_y").isNotNull(), 1))
                   .alias("n_pairs"),
                  F.corr("_x", "_y").alias("corr")))
