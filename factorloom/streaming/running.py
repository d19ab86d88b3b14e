"""Running figures and session bars of an event stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: transformWithState keeps its state in this provider.
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_OUT = "instrument string, ts timestamp, event_id long, mean double"


def session_bars(events: DataFrame, gap: str = "30 minutes", lateness: str = "1 day") -> DataFrame:
    """start, instrument, open, high, low, close, volume, amount of each session: a user's events that follow each other within `gap`. In a stream a session is given out once the watermark has passed it; later events for it are dropped."""
    events = events.withColumn("ts", F.col("ts").cast("timestamp"))
    seen = events.withWatermark("ts", lateness) if events.isStreaming else events
    at = F.struct("ts", "event_id")
    return (
        seen.groupBy(F.session_window("ts", gap).alias("session"), F.col("user_id").cast("string").alias("instrument"))
        .agg(F.min_by("value", at).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", at).alias("close"), F.count("*").alias("volume"), F.sum("value").alias("amount"))
        .select(F.col("session.start").alias("start"), "instrument", "open", "high", "low", "close", "volume", "amount")
    )


class RunningMean(StatefulProcessor):
    """Exponential means of each user's values in the order of (ts, event_id).

    Events wait in the state until the watermark has passed them, so the order in
    which they arrive doesn't matter; those that the watermark had passed before are
    dropped. A user without an event for `forget_ms` of event time is forgotten: its
    next event begins a new mean.
    """

    def __init__(self, alpha: float, forget_ms: int):
        self.alpha, self.forget_ms = alpha, forget_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.mean = handle.getValueState("mean", "mean double, last long")
        self.waiting = handle.getMapState("waiting", "ts_us long, event_id long", "value double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        for frame in rows:
            for ts, event, value in zip(frame["ts_us"], frame["event_id"], frame["value"], strict=True):
                if ts // 1000 > passed and not pd.isna(value):
                    self.waiting.updateValue((int(ts), int(event)), (float(value),))
                    self.handle.registerTimer(int(ts) // 1000)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        ready = sorted((k, v) for k, v in self.waiting.iterator() if k[0] // 1000 <= passed)
        mean, last = self.mean.get() if self.mean.exists() else (None, None)
        out = []
        for (ts, event), (value,) in ready:
            fresh = mean is None or ts // 1000 - last > self.forget_ms
            mean, last = value if fresh else (1 - self.alpha) * mean + self.alpha * value, ts // 1000
            out.append((key[0], pd.Timestamp(ts, unit="us"), event, mean))
            self.waiting.removeKey((ts, event))
        if ready:
            self.mean.update((mean, last))
            self.handle.registerTimer(last + self.forget_ms + 1)
        elif last is not None and passed > last + self.forget_ms and not any(True for _ in self.waiting.keys()):
            self.mean.clear()
        yield pd.DataFrame(out, columns=["instrument", "ts", "event_id", "mean"])

    def close(self) -> None:
        pass


def running_means(events: DataFrame, alpha: float = 0.2, lateness: str = "1 day", forget_days: float = 30.0) -> DataFrame:
    """instrument, ts, event_id, mean after each event: alpha of its value and the rest of the last mean, which begins anew after `forget_days` without one.

    Of a stream (a session with ROCKSDB as its state store) and of a table the same
    rows come, but for a stream's events that come after the watermark has passed
    them. Events without user, time, id or value are left out; an event repeated in
    user, ts and event_id counts once.
    """
    forget_ms = int(forget_days * 86_400_000)
    known = events.select(F.col("user_id").cast("string").alias("instrument"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").cast("long").alias("event_id"), F.col("value").cast("double").alias("value")).filter("instrument is not null and ts is not null and event_id is not null and value is not null")
    if events.isStreaming:
        timed = known.withWatermark("ts", lateness).withColumn("ts_us", F.unix_micros("ts"))
        return timed.groupBy("instrument").transformWithStateInPandas(RunningMean(alpha, forget_ms), _OUT, "append", "EventTime")
    by = Window.partitionBy("instrument").orderBy("ts", "event_id")
    before = F.lag(F.unix_millis("ts")).over(by)
    cells = known.dropDuplicates(["instrument", "ts", "event_id"]).withColumn("new", F.coalesce((F.unix_millis("ts") - before > forget_ms).cast("int"), F.lit(1)))
    runs = cells.withColumn("run", F.sum("new").over(by))

    def fold(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["ts", "event_id"])
        return frame.assign(mean=frame["value"].ewm(alpha=alpha, adjust=False).mean())[["instrument", "ts", "event_id", "mean"]]

    return runs.groupBy("instrument", "run").applyInPandas(fold, _OUT)
