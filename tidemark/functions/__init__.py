"""Column expressions. Everything here is a built-in Spark expression, so it stays
inside whole-stage codegen."""

from tidemark.functions.time import epoch_day, hour_of, day_of, is_weekday  # noqa: F401
from tidemark.functions.predicates import (  # noqa: F401
    precip_band, is_hot, phase, phase_vs_ma, is_rise, response_days, delta, pct_delta,
)
