"""Joins on time rather than on a key: backward as-of fill (J7) and the
next-event join (J5).

Neither uses a non-equi join. Both reduce to equi joins against a calendar whose
length is the span in days plus windows partitioned by the panel key, so the work
grows linearly with the panel. No side is broadcast by hint: its estimated or, at run
time, its measured size decides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.time import epoch_day
from tidemark.operators.ingest import fill_gaps, spine


def calendar(spark: SparkSession, lo, hi, name: str = "cal_date") -> DataFrame:
    """Every day from ``lo`` to ``hi`` (Columns, usually scalar subqueries)."""
    return spine(spark, lo, hi, "1 day", name)


def asof_fill(series: DataFrame, date_col: str, values: list[str], hi=None,
              out_date: str = "cal_date") -> DataFrame:
    """For every calendar day from the series' first day to ``hi`` (default its
    last day), the last known values. ``asof_date`` tells which day they come from.
    Each observation is expanded to the days before the next one, so no calendar
    join and no bounds query is needed."""
    return fill_gaps(series, date_col, "1 day", values, until=hi, out=out_date,
                     source_col="asof_date")


def with_prev_response(panel: DataFrame, key: str, date_col: str, flag: str) -> DataFrame:
    """Adds ``prev_r``: the key's last response day strictly before this row.
    Same partitioning and order as the panel's lag window, so it adds no shuffle."""
    w = (Window.partitionBy(key).orderBy(date_col)
         .rowsBetween(Window.unboundedPreceding, -1))
    return panel.withColumn("prev_r", F.last(F.when(F.col(flag), F.col(date_col)),
                                            ignorenulls=True).over(w))


def event_span(events: DataFrame, event_date: str):
    """Distinct event days and one scalar subquery with their number and span."""
    ev = events.select(F.col(event_date).alias("d")).distinct()
    span = ev.select(F.struct(F.count("*").alias("n"), F.min("d").alias("lo"),
                              F.max("d").alias("hi"))).scalar()
    return ev, span["lo"], span["hi"], span["n"]


def response_intervals(events: DataFrame, event_date: str, panel: DataFrame, key: str,
                       date_col: str, flag: str, horizon_days: int | None = None):
    """Distinct event days ``d``, and per response of each key: key, response day ``r``
    and the first and last day (``_s``, ``_e``) whose events it answers."""
    ev, lo, hi, _ = event_span(events, event_date)
    iv = with_prev_response(panel, key, date_col, flag).where(F.col(flag))
    # greatest/least skip NULLs: a missing previous response leaves the events'
    # first day as the start. Each bound is computed once, as a column.
    lows = [F.col("prev_r"), lo]
    if horizon_days is not None:
        lows.append(F.date_sub(F.col(date_col), int(horizon_days)))
    bounds = iv.select(key, F.col(date_col).alias("r"), F.greatest(*lows).alias("_s"),
                       F.least(F.date_sub(F.col(date_col), 1), hi).alias("_e"))
    return ev, bounds.where(F.col("_s") <= F.col("_e"))


def next_event_counts(events: DataFrame, event_date: str, panel: DataFrame, key: str,
                      date_col: str, flag: str, horizon_days: int | None = None) -> DataFrame:
    """J5 counted: event_date, response_date and the number of keys (``n_keys``) that answer so.

    Equal intervals of different keys are counted first and only then expanded, so no
    pair of event and key is built: the expansion is bounded by the span, not by the keys."""
    ev, bounds = response_intervals(events, event_date, panel, key, date_col, flag, horizon_days)
    alike = bounds.groupBy("r", "_s", "_e").agg(F.count("*").alias("_n"))
    days = alike.select("r", "_n", F.explode(F.sequence("_s", "_e")).alias("d"))
    per = days.groupBy("d", "r").agg(F.sum("_n").alias("n_keys"))
    return per.join(ev, "d").select(F.col("d").alias("event_date"), F.col("r").alias("response_date"), "n_keys")


def response_spells(events: DataFrame, event_date: str, panel: DataFrame, key: str,
                    date_col: str, flag: str):
    """Distinct event days ``d``, and the spells in which events wait: key, the day ``r``
    that ends the spell, ``answered`` (a response ends it; else the key's last row does)
    and the first and last day (``_s``, ``_e``) whose events wait through it. Events on or
    after a key's last row are not watched there and stand in no spell. One shuffle."""
    ev, lo, hi, _ = event_span(events, event_date)
    last = F.lead(date_col).over(Window.partitionBy(key).orderBy(date_col)).isNull()
    rows = with_prev_response(panel, key, date_col, flag).withColumn("_last", last)
    rows = rows.where(F.col(flag) | F.col("_last"))
    spells = rows.select(key, F.col(date_col).alias("r"), F.col(flag).alias("answered"),
                         F.greatest("prev_r", lo).alias("_s"),
                         F.least(F.date_sub(F.col(date_col), 1), hi).alias("_e"))
    return ev, spells.where(F.col("_s") <= F.col("_e"))


def wait_counts(spells: DataFrame, ev: DataFrame, by: list[str],
                horizon_days: int | None = None, out: str = "wait_days") -> DataFrame:
    """by, the wait in days, n_responded, n_censored: events of ``ev`` by how long they wait.
    With ``horizon_days`` longer waits are censored at that many days. Equal spells are
    counted before they are expanded to days, so no pair of event and key is built."""
    alike = spells.groupBy(*by, "r", "answered", "_s", "_e").agg(F.count("*").alias("_n"))
    days = alike.select(*by, "r", "answered", "_n", F.explode(F.sequence("_s", "_e")).alias("d")).join(ev, "d")
    wait, told = F.datediff("r", "d"), F.col("answered")
    if horizon_days is not None:
        told = told & (wait <= int(horizon_days))
        wait = F.least(wait, F.lit(int(horizon_days)))
    days = days.select(*by, wait.alias(out), told.alias("_told"), "_n")
    return days.groupBy(*by, out).agg(
        F.sum(F.when(F.col("_told"), F.col("_n")).otherwise(0)).cast("long").alias("n_responded"),
        F.sum(F.when(F.col("_told"), 0).otherwise(F.col("_n"))).cast("long").alias("n_censored"))


def next_event_pairs(spark: SparkSession, events: DataFrame, event_date: str,
                     panel: DataFrame, key: str, date_col: str, flag: str,
                     horizon_days: int | None = None) -> DataFrame:
    """For each event day ``e`` and each key, the first response day ``r > e``.

    ``panel`` holds the key's rows with a boolean ``flag`` marking response days.
    Returns one row per (key, event) that has a response: key, event_date,
    response_date. Every event in ``[prev_r, r)`` answers to ``r``; each such
    interval, clipped to the events' span, is expanded to days and equi-joined to
    the event days. The expansion is at most the key's span in days,
    the grain of the daily panel itself. With ``horizon_days`` a response more
    than that many days after the event does not count (the pair is censored).
    """
    ev, bounds = response_intervals(events, event_date, panel, key, date_col, flag, horizon_days)
    days = bounds.select(key, "r", F.explode(F.sequence("_s", "_e")).alias("d"))
    return (days.join(ev, "d")
                .select(key, F.col("d").alias("event_date"), F.col("r").alias("response_date")))


def next_event_stats(spark: SparkSession, events: DataFrame, event_date: str,
                     panel: DataFrame, key: str, date_col: str, flag: str,
                     horizon_days: int | None = None,
                     day_index: DataFrame | None = None,
                     series: str | None = None, names: tuple[str, ...] = ()) -> DataFrame:
    """J5 aggregated per key without building pairs.

    With C(d) = events before d and S(d) = sum of their day numbers (prefix sums
    over the events' days), the events answered by response ``r`` after the
    previous response ``p`` number C(r) - C(p) and wait ``n * r - (S(r) - S(p))``
    days in total. C is 0 up to the first event and the total after the last. With
    ``horizon_days`` the lower end is ``max(p, r - horizon_days)``.

    ``day_index`` (columns ``d``, ``idx``; a bounded daily series) replaces the
    calendar day number, e.g. by a trading-day count, so waits are counted in its
    unit; the horizon stays in calendar days.

    ``series`` names a column of ``events`` that tells several event series apart;
    each of ``names`` is then answered in the same pass over the panel, and its name
    stands before the key. ``day_index`` serves a single series only.

    Returns key, n_events (all events, the same for every key), n_responded,
    sum_days for every key of ``panel``. Works in the
    panel's own window partitioning: one shuffle by key, then joins to the small
    prefix table and an aggregate that needs no further exchange.
    """
    by = [series] if series else []
    rows = with_prev_response(panel, key, date_col, flag)
    if series:
        ev = events.select(series, F.col(event_date).alias("d")).distinct()
        ends = ev.groupBy(series).agg(F.count("*").alias("_n"), F.date_add(F.max("d"), 1).alias("_end"))
        rows = rows.withColumn(series, F.explode(F.array(*map(F.lit, names)))).join(ends, series, "left")
    else:
        ev, _, hi, n_ev = event_span(events, event_date)
        rows = rows.withColumns({"_end": F.date_add(hi, 1), "_n": n_ev})
    # Prefix table from the event series itself: the i-th event (1-based) covers
    # the days after it up to the next event, where i events lie strictly before.
    # Days up to the first event are absent (a miss reads as 0); the last event
    # covers one day, and lookups beyond it are clamped to that day.
    w = Window.partitionBy(*by).orderBy("d")
    if day_index is not None:
        idx = day_index.select("d", F.col("idx").cast("long").alias("_dn"))
        ev_num = ev.join(idx, "d", "left")
    else:
        ev_num = ev.withColumn("_dn", epoch_day("d"))
    evs = ev_num.select(*[F.col(c).alias("_by") for c in by], "d", F.row_number().over(w).cast("long").alias("c"),
                        F.sum("_dn").over(w.rowsBetween(Window.unboundedPreceding, 0))
                        .cast("long").alias("s"),
                        F.lead("d").over(w).alias("nd"))
    first = F.date_add(F.col("d"), 1)
    prefix = evs.select(
        *["_by" for _ in by], F.explode(F.sequence(first, F.coalesce(F.col("nd"), first))).alias("d"), "c", "s")

    def clamp(c):
        # least() skips NULLs: a missing day must stay missing, not become `end`.
        return F.when(c.isNotNull(), F.least(c, F.col("_end")))

    # Events in [lower, r) answer to r. With a horizon, events more than
    # horizon_days before r are censored: the lower end moves up to r - horizon.
    lower = F.col("prev_r")
    if horizon_days is not None:
        lower = F.greatest(F.coalesce(lower, F.date_sub(F.col(date_col), int(horizon_days))),
                           F.date_sub(F.col(date_col), int(horizon_days)))
    rows = rows.select(
        *by, key, "_n", F.col(date_col).alias("r"), F.col(flag).alias("_is_r"),
        F.when(F.col(flag), clamp(F.col(date_col))).alias("_rk"),
        F.when(F.col(flag), clamp(lower)).alias("_pk"))
    # Both lookups probe the same prefix table (one build, reused).
    def at(day, p):
        same = F.col(day) == F.col(f"{p}.d")
        return same & (F.col(series) == F.col(f"{p}._by")) if series else same

    j = (rows.join(prefix.alias("pr"), at("_rk", "pr"), "left")
             .join(prefix.alias("pp"), at("_pk", "pp"), "left"))
    if day_index is not None:
        ri = idx.select(F.col("d").alias("_ri_d"), F.col("_dn").alias("_r_dn"))
        j = j.join(ri, F.col("r") == F.col("_ri_d"), "left")
        r_num = F.col("_r_dn")
    else:
        r_num = epoch_day("r")
    n = F.coalesce(F.col("pr.c"), F.lit(0)) - F.coalesce(F.col("pp.c"), F.lit(0))
    days = n * r_num - (F.coalesce(F.col("pr.s"), F.lit(0)) - F.coalesce(F.col("pp.s"), F.lit(0)))
    return (j.groupBy(*by, key)
             .agg(F.sum(F.when(F.col("_is_r"), n).otherwise(0)).cast("long").alias("n_responded"),
                  F.sum(F.when(F.col("_is_r"), days).otherwise(0)).cast("long").alias("sum_days"),
                  F.coalesce(F.max("_n"), F.lit(0)).cast("long").alias("n_events")))
