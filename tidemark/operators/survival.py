"""A4 with censoring: the product-limit estimate of a wait from its counts.

Waits that end without a response count as long as they were watched. The input is one
row per group and distinct wait (see ``asof.wait_counts``), so the windows here run over
as many rows as the waits have values, never over pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

HALF = 0.5 + 1e-9       # survival at or under a half; the margin absorbs the product's rounding


def product_limit(counts: DataFrame, by: list[str], wait: str = "wait_days") -> DataFrame:
    """by, wait, n_at_risk, n_responded, n_censored, survival, std_error.

    ``counts`` holds by, wait, n_responded, n_censored, each wait once. Those censored at a
    wait are still at risk there. ``std_error`` is Greenwood's; NULL once nobody is left."""
    w = Window.partitionBy(*by).orderBy(wait)
    ahead = w.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    so_far = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    n, d = F.col("n_at_risk").cast("double"), F.col("n_responded").cast("double")
    c = counts.withColumn("n_at_risk", F.sum(F.col("n_responded") + F.col("n_censored")).over(ahead).cast("long"))
    c = c.withColumns({"survival": F.product((n - d) / n).over(so_far),
                       "_var": F.sum(d / F.nullif(n * (n - d), F.lit(0.0))).over(so_far)})
    return c.select(*by, wait, "n_at_risk", "n_responded", "n_censored", "survival",
                    F.when(F.col("survival") > 0, F.col("survival") * F.sqrt("_var")).alias("std_error"))


def wait_summary(curve: DataFrame, by: list[str], wait: str = "wait_days") -> DataFrame:
    """by, n_pairs, n_responded, n_censored, longest_days, mean_days, median_days.

    ``mean_days`` is the area under the curve up to the longest wait seen: the plain mean
    where nothing is censored. ``median_days``: first wait with at most half still waiting;
    NULL if it never comes to that."""
    w = Window.partitionBy(*by).orderBy(wait)
    step = (F.col(wait) - F.lag(wait, 1, 0).over(w)) * F.lag("survival", 1, 1.0).over(w)
    return (curve.withColumn("_area", step).groupBy(*by).agg(
        F.sum(F.col("n_responded") + F.col("n_censored")).cast("long").alias("n_pairs"),
        F.sum("n_responded").cast("long").alias("n_responded"),
        F.sum("n_censored").cast("long").alias("n_censored"),
        F.max(wait).alias("longest_days"),
        F.sum("_area").alias("mean_days"),
        F.min(F.when(F.col("survival") <= HALF, F.col(wait))).alias("median_days")))
