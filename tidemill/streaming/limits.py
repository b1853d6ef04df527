"""The rate limit and the cache as running services: state for each key, and timers that clear it."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidemill.streaming.events import LIMIT, SECONDS

#: What a session must have for these streams.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Recent(StatefulProcessor):
    """Keeps the times of a key's accepted calls, the last limit of them, until the youngest is too old."""

    def __init__(self, limit: int, seconds: float, by: str, order: str, accepts: str):
        self.limit, self.micros, self.by, self.order, self.accepts = limit, int(seconds * 1_000_000), by, order, accepts

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.times = handle.getListState("times", "t long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        calls = pd.concat(list(rows))  # what one key sends in a batch
        calls.columns = ["by", "order", "at", "t"]
        calls = calls.sort_values(["t", "order"], kind="stable")
        recent = [t for (t,) in self.times.get()]
        out = []
        for t in calls["t"].tolist():
            recent = [x for x in recent if t - x <= self.micros]
            out.append(len(recent) < self.limit)
            if out[-1]:
                recent.append(t)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.times.clear()
        if recent:
            self.times.put([(t,) for t in recent])
            self.handle.registerTimer((recent[-1] + self.micros) // 1000 + 1)
        plain = calls["order"].astype(object) if isinstance(calls["order"].dtype, pd.StringDtype) else calls["order"]
        yield pd.DataFrame({self.by: pd.Series([key[0]] * len(out), dtype=object, index=calls.index), self.order: plain, self.accepts: out})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.times.clear()
        yield from ()

    def close(self) -> None:
        pass


def limited(events: DataFrame, by: str, ts: str, order: str, limit: int = LIMIT, seconds: float = SECONDS, late: str = "10 seconds") -> DataFrame:
    """(by, order, accepted) of a stream of calls, which come in the order of their times but for a batch's own.

    Calls more than `late` behind the newest of an earlier batch are dropped. Accepts while fewer than
    limit accepted calls are at most `seconds` old. A key's state is at most
    limit times; a timer clears it when the watermark passes the youngest of them by `seconds`.
    """
    kinds = dict(events.dtypes)
    rows = events.select(by, order, F.col(ts).cast("timestamp").alias("_at")).withWatermark("_at", late).withColumn("_t", F.unix_micros("_at"))
    out = f"{by} {kinds[by]}, {order} {kinds[order]}, accepted boolean"
    return rows.groupBy(by).transformWithStateInPandas(_Recent(limit, seconds, by, order, "accepted"), out, "append", "eventtime")


def cached(events: DataFrame, by: str, ts: str, order: str, seconds: float = 300, late: str = "10 seconds") -> DataFrame:
    """(by, order, hit) of a stream of questions: whether a key's answer was still cached; one that wasn't is stored anew."""
    return limited(events, by, ts, order, 1, seconds, late).select(by, order, (~F.col("accepted")).alias("hit"))
