"""Settlement of forecasts in a stream, by event-time timers.

A forecast waits under its series and the month of its target session for that
session's close, however late; a timer gives it up once the watermark is
`patience` past the target.  Every forecast is emitted once: with its outcome,
or with a null one when it expires.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

OUTCOME = T.StructType([
    T.StructField("series_id", T.StringType()), T.StructField("signal_at", T.TimestampType()), T.StructField("target_at", T.TimestampType()), T.StructField("predicted_label", T.IntegerType()),
    T.StructField("actual_return", T.DoubleType()), T.StructField("correct", T.BooleanType()),
])
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Settlement(StatefulProcessor):
    """State of a (series, month of target): forecasts that wait, and closes that may still be asked for."""

    def __init__(self, patience_ms: int):
        self.patience_ms = patience_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "signal_ms long", "target_ms long, base_close double, label int")
        self.closes = handle.getMapState("closes", "close_ms long", "close double")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        part = pd.concat(list(rows))
        new = {int(ms): float(c) for ms, c in zip(*(part.loc[part["close"].notna(), c] for c in ("at_ms", "close")))}
        asked = part[part["base_close"].notna()]
        known = {(ms,): None for ms in asked["target_ms"].astype("int64")} if len(asked) else {}
        closes = dict(new)
        for (ms,) in known:
            if ms not in closes and self.closes.containsKey((ms,)):
                closes[ms] = self.closes.getValue((ms,))[0]
        done = []
        for signal, target, base, label in zip(asked["at_ms"], asked["target_ms"], asked["base_close"], asked["label"]):
            signal, target, label = int(signal), int(target), int(label)
            if target in closes:
                done.append((signal, target, float(base), label, closes[target]))
            else:
                self.waiting.updateValue((signal,), (target, float(base), label))
                self.handle.registerTimer(target + self.patience_ms)
        if new:
            settled = []
            for (signal,), (target, base, label) in self.waiting.iterator():
                if target in new:
                    settled.append(signal)
                    done.append((signal, target, base, label, new[target]))
            for signal in settled:
                self.waiting.removeKey((signal,))
            for ms, close in new.items():
                self.closes.updateValue((ms,), (close,))
                self.handle.registerTimer(ms + self.patience_ms)
        yield self._outcomes(key, done)

    def handleExpiredTimer(self, key: Any, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        until = expiredTimerInfo.getExpiryTimeInMs() - self.patience_ms
        expired = [(signal, *row, None) for (signal,), row in self.waiting.iterator() if row[0] <= until]
        for signal, *_ in expired:
            self.waiting.removeKey((signal,))
        for (ms,) in [k for k, _ in self.closes.iterator() if k[0] <= until]:
            self.closes.removeKey((ms,))
        yield self._outcomes(key, expired)

    def close(self) -> None:
        pass

    @staticmethod
    def _outcomes(key: Any, done: list) -> pd.DataFrame:
        rows = []
        for signal, target, base, label, close in done:
            r = None if close is None else close / base - 1
            rows.append((key[0], pd.Timestamp(signal, unit="ms"), pd.Timestamp(target, unit="ms"), label, r, None if r is None else label == int(r > 0)))
        return pd.DataFrame(rows, columns=OUTCOME.fieldNames()).astype({"predicted_label": "int32", "actual_return": "float64", "correct": object})


def settle_stream(forecasts: DataFrame, closes: DataFrame, delay: str = "14 days", patience_days: int = 90) -> DataFrame:
    """Forecasts with the outcome of their target session, or a null outcome once that is `patience_days` overdue.

    forecasts: series_id, signal_at, target_at, base_close, predicted_label.
    closes: series_id, close_at, close.  Rows may come late by `delay`.  The
    session's state store must be RocksDB (`spark.sql.streaming.stateStore.providerClass`).
    """
    none = F.lit(None)
    ms = lambda c: F.unix_millis(F.col(c))
    asked = forecasts.select("series_id", F.col("signal_at").alias("at"), F.date_format("target_at", "yyyy-MM").alias("month"), ms("signal_at").alias("at_ms"), ms("target_at").alias("target_ms"),
                             "base_close", F.col("predicted_label").cast("int").alias("label"), none.cast("double").alias("close"))
    told = closes.select("series_id", F.col("close_at").alias("at"), F.date_format("close_at", "yyyy-MM").alias("month"), ms("close_at").alias("at_ms"), none.cast("bigint").alias("target_ms"),
                         none.cast("double").alias("base_close"), none.cast("int").alias("label"), "close")
    both = asked.unionByName(told).withWatermark("at", delay)
    return both.groupBy("series_id", "month").transformWithStateInPandas(Settlement(patience_days * 86_400_000), OUTCOME, "Append", "eventTime")
