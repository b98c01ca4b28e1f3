"""Scalar predicates and derived values of the four queries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.time import _c

# Fixed values of the queries.
# Precipitation bands: none (0 mm), under 10 mm, 10 mm and over.
BAND_NONE, BAND_LT10, BAND_GE10, BAND_UNOBSERVED = "none", "lt10", "ge10", "unobserved"
BAND_LIMIT_MM = 10.0
# Heat: sensible (feel) temperature of 35 °C and over.
HEAT_LIMIT_C = 35.0
# Oil phases by the moving average.
PHASE_RISING, PHASE_FALLING, PHASE_FLAT = "rising", "falling", "flat"


def precip_band(p, limit: float = BAND_LIMIT_MM) -> Column:
    """P1. A missing observation (NULL, not a number, or a negative error code) gets its
    own band, never ``none``."""
    p = _c(p)
    return (F.when(p.isNull() | F.isnan(p) | (p < 0), F.lit(BAND_UNOBSERVED))
            .when(p == 0, F.lit(BAND_NONE))
            .when(p < limit, F.lit(BAND_LT10))
            .otherwise(F.lit(BAND_GE10)))


def is_hot(t, limit: float = HEAT_LIMIT_C) -> Column:
    """P2. NULL (unobserved) stays NULL, and so does a value that is no number."""
    t = _c(t)
    return F.when(~F.isnan(t), t >= F.lit(float(limit)))


def phase(ma, prev_ma) -> Column:
    """P3. Direction of the moving average against its previous value."""
    ma, prev_ma = _c(ma), _c(prev_ma)
    return (F.when(ma.isNull() | prev_ma.isNull(), F.lit(None).cast("string"))
            .when(ma > prev_ma, F.lit(PHASE_RISING))
            .when(ma < prev_ma, F.lit(PHASE_FALLING))
            .otherwise(F.lit(PHASE_FLAT)))


def phase_vs_ma(price, ma) -> Column:
    """P3, alternative rule: the price against its own moving average."""
    price, ma = _c(price), _c(ma)
    return (F.when(price.isNull() | ma.isNull(), F.lit(None).cast("string"))
            .when(price > ma, F.lit(PHASE_RISING))
            .when(price < ma, F.lit(PHASE_FALLING))
            .otherwise(F.lit(PHASE_FLAT)))


def is_rise(p, prev_p, min_change: float = 0.0) -> Column:
    """P4. Strict rise over the previous recorded value."""
    return (_c(p) - _c(prev_p)) > F.lit(float(min_change))


def response_days(event_date, response_date) -> Column:
    """P5. Calendar days from an event to its response."""
    return F.datediff(_c(response_date), _c(event_date))


def delta(p, prev_p) -> Column:
    """P6. Absolute change."""
    return _c(p) - _c(prev_p)


def pct_delta(p, prev_p) -> Column:
    """P6. Percent change; NULL when the previous value is 0 or missing."""
    prev_p = _c(prev_p)
    return (_c(p) - prev_p) * 100.0 / F.nullif(prev_p, F.lit(0.0))
