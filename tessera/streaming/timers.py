"""Keyed streams with event-time timers: windows that close at an event, and throttling that does not swallow the last event.

Both use ``transformWithState``, which needs the RocksDB state store (``spark.sql.streaming.stateStore.providerClass``). A trigger's events of a key are
taken in order of time. Events that come later than the watermark allows are left out by Spark; within it, one older than the key's
last run changes nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _in_order(rows: Iterator[pd.DataFrame]) -> Iterator[tuple[float, str]]:
    batch = pd.concat(list(rows))
    return batch.sort_values("t", kind="stable")[["t", "value"]].itertuples(index=False, name=None)


class _Throttle(StatefulProcessor):
    """State: the last run's time; the event held back since, if any, whose timer is due a width after the run."""

    def __init__(self, key: str, width: float):
        self.key, self.width = key, width

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "t double")
        self.held = handle.getValueState("held", "t double, value string")

    def _frame(self, key: tuple, rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame([(key[0], *r) for r in rows], columns=[self.key, "t", "value", "held"])

    def _due(self) -> int:
        return int(self.last.get()[0] + self.width)

    def _release(self, out: list[tuple]) -> None:
        t, value = self.held.get()
        out.append((t, value, True))
        self.handle.deleteTimer(self._due())
        self.last.update((float(self._due()),))
        self.held.clear()

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        out: list[tuple] = []
        for t, value in _in_order(rows):
            if self.held.exists() and t >= self._due():
                self._release(out)
            if not self.last.exists() or t >= self.last.get()[0] + self.width:
                out.append((t, value, False))
                self.last.update((float(t),))
            elif t >= self.last.get()[0] and (not self.held.exists() or t >= self.held.get()[0]):
                if not self.held.exists():
                    self.handle.registerTimer(self._due())
                self.held.update((float(t), value))
        yield self._frame(key, out)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        out: list[tuple] = []
        if self.held.exists():
            self._release(out)
        yield self._frame(key, out)

    def close(self) -> None:
        pass


class _Windows(StatefulProcessor):
    """State: when the key's window opened, and its events so far."""

    def __init__(self, key: str, width: float):
        self.key, self.width = key, width

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.window = handle.getValueState("window", "opened double, n long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        out = []
        opened, n = self.window.get() if self.window.exists() else (None, 0)
        for t, _ in _in_order(rows):
            if opened is None:
                opened = t
                continue
            n += 1
            if t - opened >= self.width:
                out.append((key[0], opened, t, n, int(n * 1000 / (t - opened) + 0.5)))
                opened, n = t, 0
        self.window.update((float(opened), int(n)))
        yield pd.DataFrame(out, columns=[self.key, "opened", "closed", "n", "rate"])

    def close(self) -> None:
        pass


def throttle_stream(events: DataFrame, width: int = 150, key: str = "key", late: str = "1 second") -> DataFrame:
    """Stream of (key, t, value string), t in whole milliseconds -> (key, t, value, held).

    A key's first event runs at once. Of those within ``width`` ms of a run the last is held back and runs when the width is over, even if the key falls
    idle, as soon as the watermark says so; the next width counts from then.
    """
    stamped = events.select(key, F.col("t").cast("double").alias("t"), "value", F.timestamp_millis(F.col("t").cast("long")).alias("at")).withWatermark("at", late)
    return stamped.groupBy(key).transformWithStateInPandas(_Throttle(key, width), f"{key} string, t double, value string, held boolean", "append", "eventTime")


def closing_windows_stream(events: DataFrame, width: float = 500.0, key: str = "key") -> DataFrame:
    """Stream of (key, t) -> (key, opened, closed, n, rate), as ``telemetry.closing_windows`` has it."""
    timed = events.select(key, F.col("t").cast("double").alias("t"), F.lit("").alias("value"))
    return timed.groupBy(key).transformWithStateInPandas(_Windows(key, width), f"{key} string, opened double, closed double, n long, rate long", "append", "none")
