"""X4 live: a timer for each series says when its readings stop.

A cycle of ``refresh`` judges the series that have new rows; one that falls silent
has none. ``watch`` keeps one value for each series, its newest reading, and a
timer ``stale_minutes`` after it (``transformWithState``). A new reading moves the
timer; a timer that expires raises the series' ``stale_data`` alert, once for each
silence. State is one row a series, spread by series over the state stores.

``ProcessingTime`` measures against the wall clock, as live runs need;
``EventTime`` against the stream's watermark, which follows the readings of all
series, so replays and tests give the same alerts each time.

Late readings never move a timer back; a null time is no reading.
"""
from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

from ..operators import alerts as al
from ..session import ship_package

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class SilenceTimer(StatefulProcessor):
    def __init__(self, series_cols: Sequence[str], stale_ms: int, event_time: bool):
        self.series_cols, self.stale_ms, self.event_time = list(series_cols), stale_ms, event_time

    def init(self, handle) -> None:
        self.handle = handle
        self.newest = handle.getValueState("newest", "ms long")

    def _out(self, rows: list[tuple]) -> Iterator[pd.DataFrame]:
        if rows:
            yield pd.DataFrame(rows, columns=[*self.series_cols, "last_ms", "now_ms"])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        seen = [int(m) for m in (b["reading_ms"].max() for b in rows) if pd.notna(m)]
        before = self.newest.get()
        if seen and (before is None or max(seen) > before[0]):
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            self.newest.update((max(seen),))
            self.handle.registerTimer(max(seen) + self.stale_ms + 1)
        return self._out([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() if self.event_time else timerValues.getCurrentProcessingTimeInMs()
        return self._out([(*key, self.newest.get()[0], max(int(now), expiredTimerInfo.getExpiryTimeInMs()))])

    def close(self) -> None:
        pass


def watch(readings: DataFrame, *, series_cols: Sequence[str] = ("series_id",), thresholds: dict | None = None,
          event_time: bool = False, delay: str = "0 seconds") -> DataFrame:
    """Stream of ``stale_data`` alerts (series..., timestamp, alert columns) over a stream of readings."""
    s, spark = list(series_cols), readings.sparkSession
    ship_package(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    stale = {**al.DEFAULT_THRESHOLDS, **(thresholds or {})}["stale_minutes"]
    if event_time:
        readings = readings.withWatermark("timestamp", delay)
    d = readings.select(*s, "timestamp", F.unix_millis("timestamp").alias("reading_ms"))
    schema = T.StructType([*[d.schema[c] for c in s], T.StructField("last_ms", T.LongType()), T.StructField("now_ms", T.LongType())])
    silent = d.groupBy(*s).transformWithStateInPandas(
        SilenceTimer(s, int(stale * 60_000), event_time), schema, outputMode="Update", timeMode="EventTime" if event_time else "ProcessingTime")
    none = F.lit(None).cast("double")
    rows = silent.select(*s, F.timestamp_millis("last_ms").alias("current_timestamp"), F.timestamp_millis("now_ms").alias("timestamp"),
                         none.alias("current_glucose"), none.alias("prediction_30m"))
    return al.detect(rows, keep_cols=[*s, "timestamp"], now="timestamp", thresholds=thresholds)
