"""Early observation window: events joined to their index stay."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from staylens.functions import times

WINDOW_HOURS = 48


def in_window(
    t: Column, anchor: Column, hours: int = WINDOW_HOURS, mode: str = "clock_hour"
) -> Column:
    """Early-window predicate as a plain range over ``t``.

    ``clock_hour``: 0..hours clock-hour boundaries between anchor and event,
    which is the half-open range from the anchor's full hour to hours+1 later;
    it admits events up to 59 minutes before the anchor.
    ``elapsed``: 0 <= elapsed < hours.
    """
    if mode == "clock_hour":
        base = times.floor_hour(anchor)
        return (t >= base) & (t < times.plus_hours(base, hours + 1))
    if mode == "elapsed":
        return (t >= anchor) & (t < times.plus_hours(anchor, hours))
    raise ValueError(f"unknown mode {mode!r}")


def _between_anchors(index: DataFrame, anchor: str, t: Column, hours: int) -> Column:
    """Constant time bounds that hold for every window of the index."""
    low, high = index.agg(F.min(anchor), F.max(anchor)).first()
    if low is None:
        return F.lit(False)
    low = low.replace(minute=0, second=0, microsecond=0)
    high = high.replace(minute=0, second=0, microsecond=0) + timedelta(hours=hours + 1)
    first, end = (F.lit(v.isoformat(sep=" ")).cast("timestamp_ntz") for v in (low, high))
    return (t >= first) & (t < end)


def early_window(
    events: DataFrame,
    index: DataFrame,
    on: str = "stay_id",
    time: str = "t",
    anchor: str = "admit",
    hours: int = WINDOW_HOURS,
    mode: str = "clock_hour",
    carry: Sequence[str] = (),
    prune_scan: bool = False,
) -> DataFrame:
    """Events inside the window of their index stay; adds the anchor column.

    ``carry`` names further index columns to take along; they replace event
    columns of the same name.

    No broadcast hint: the index side grows with the data, so Spark picks the
    strategy from its statistics, and AQE splits a stay that holds a large
    share of the events.  ``prune_scan`` first reads the smallest and largest
    anchor and adds them as constant bounds on the event time, which reach the
    Parquet reader and skip row groups; it is meant for a settled index.
    """
    right = index.select(on, anchor, *carry)
    rows = events.drop(anchor, *carry).filter(F.col(time).isNotNull())
    if prune_scan:
        rows = rows.filter(_between_anchors(right, anchor, F.col(time), hours))
    joined = rows.join(right, on)
    return joined.filter(in_window(F.col(time), F.col(anchor), hours, mode))


def join_items(
    events: DataFrame, items: DataFrame, on: str = "item_id", how: str = "inner"
) -> DataFrame:
    """Attach the item dimension: inner drops unknown items, left keeps them."""
    if how not in ("inner", "left"):
        raise ValueError(f"unknown join {how!r}")
    return events.join(items, on, how)


def window_compliance(
    events: DataFrame,
    keys: Sequence[str] = ("modality",),
    time: str = "t",
    anchor: str = "admit",
    hours: int = WINDOW_HOURS,
) -> DataFrame:
    """Offset audit of sliced events: how many lie outside the elapsed window."""
    offset = times.hours_between(F.col(anchor), F.col(time))
    outside = (offset < 0) | (offset >= float(hours))
    return (
        events.withColumn("offset_hours", offset)
        .groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("n_events"),
            F.min("offset_hours").alias("min_offset_hours"),
            F.max("offset_hours").alias("max_offset_hours"),
            F.max(times.hour_boundaries(F.col(anchor), F.col(time))).alias("max_boundaries"),
            F.count_if(outside).alias("n_outside"),
            F.avg(outside.cast("double")).alias("violation_rate"),
        )
    )
