"""Reuse of derived DataFrames per set of tables.

DataFrames are immutable logical plans, so a derived series (the oil series, the
panel with its lags, the hour classes) built once for a set of tables can be used
by every later query on the same tables. The cache lives on the tables object and
goes away with it.
"""

from __future__ import annotations

import functools


def per_tables(fn):
    """Cache ``fn(t, *args, **kwargs)`` on ``t`` (arguments must be hashable)."""

    @functools.wraps(fn)
    def wrapper(t, *args, **kwargs):
        cache = getattr(t, "_derived", None)
        if cache is None:
            cache = {}
            try:
                t._derived = cache
            except AttributeError:       # an object that takes no attributes
                return fn(t, *args, **kwargs)
        key = (fn.__name__, args, tuple(sorted(kwargs.items())))
        if key not in cache:
            cache[key] = fn(t, *args, **kwargs)
        return cache[key]

    return wrapper
