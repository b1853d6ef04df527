"""Rates over sliding windows: events are added up once, in panes, and panes are combined into windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PANE, WINDOW = "15 seconds", "5 minutes"


def panes(events: DataFrame, ts: str, by: list[str], kinds: dict[str, Column], pane: str = PANE, late: str = "1 minute") -> DataFrame:
    """(by, pane, total, a count for each kind) of events; the same plan runs on a stream or a table."""
    e = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    counts = [F.count_if(c).alias(k) for k, c in kinds.items()]
    return e.groupBy(F.window(ts, pane).alias("pane"), *by).agg(F.count("*").alias("total"), *counts)


def sliding(panes: DataFrame, by: list[str], window: str = WINDOW, pane: str = PANE) -> DataFrame:
    """(start, by, total, counts..., rate, share_...) of every window that has a pane.

    A window begins with every pane. Each pane, not each event, goes to the windows it lies in; rate is
    events a second, and the shares are those of each kind.
    """
    kinds = [c for c in panes.columns if c not in ("pane", "total", *by)]
    # On a stream this is the second aggregate of a chain: the time of a window carries the watermark on.
    w = panes.groupBy(F.window(F.window_time("pane"), window, pane).alias("w"), *by).agg(F.sum("total").alias("total"), *[F.sum(k).alias(k) for k in kinds])
    seconds = (F.unix_micros("w.end") - F.unix_micros("w.start")) / 1e6
    return w.select(F.col("w.start").alias("start"), *by, "total", *kinds, (F.col("total") / seconds).alias("rate"), *[(F.col(k) / F.col("total")).alias(f"share_{k}") for k in kinds])


def increases(samples: DataFrame, series: list[str], ts: str, value: str) -> DataFrame:
    """samples of counters with `increase`, by how much each went up since the one before it.

    A value below the one before is a counter that began anew, so all of it is increase; a series' first
    sample has none. A series is folded in order of time, and of value where times are equal.
    """
    before = F.lag(value).over(Window.partitionBy(*series).orderBy(ts, value))
    return samples.withColumn("increase", F.when(before.isNull(), 0.0).when(F.col(value) < before, F.col(value)).otherwise(F.col(value) - before))


def counter_rates(samples: DataFrame, series: list[str], by: list[str], ts: str, value: str, window: str = WINDOW, pane: str = PANE) -> DataFrame:
    """(start, by, increase, rate): how much all counters of a label went up in each window, and that a second."""
    up = increases(samples, series, ts, value).withColumn(ts, F.col(ts).cast("timestamp"))
    small = up.groupBy(F.window(ts, pane).alias("pane"), *by).agg(F.sum("increase").alias("increase"))
    w = small.groupBy(F.window(F.window_time("pane"), window, pane).alias("w"), *by).agg(F.sum("increase").alias("increase"))
    seconds = (F.unix_micros("w.end") - F.unix_micros("w.start")) / 1e6
    return w.select(F.col("w.start").alias("start"), *by, "increase", (F.col("increase") / seconds).alias("rate"))
