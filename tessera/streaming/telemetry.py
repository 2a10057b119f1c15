"""Event-time forms of telemetry behaviour. Those marked Batch work on a batch only, the others on a batch or a stream, ``flick_speeds`` on a stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.window import Window

from ..operators.segments import changes_only as changes_only
from ..operators.segments import last_before, spaced_runs


def tumbling_rate(events: DataFrame, ts: str, width: str, keys: tuple[str, ...] = (), watermark: str | None = None) -> DataFrame:
    """window start, keys, n and rate per second."""
    e = events.withWatermark(ts, watermark) if watermark else events
    out = e.groupBy(F.window(ts, width).alias("w"), *keys).agg(F.count("*").alias("n"))
    seconds = F.timestamp_diff("SECOND", F.col("w.start"), F.col("w.end"))
    return out.select(F.col("w.start").alias("start"), *keys, "n", (F.col("n") / seconds).alias("rate"))


def every_nth(events: DataFrame, ordinal: Column, n: int = 6) -> DataFrame:
    return events.where(F.pmod(ordinal, F.lit(n)) == 0)


def latest(events: DataFrame, key: str, order: list[str], values: list[str]) -> DataFrame:
    """The last row of values by key (update mode on streams)."""
    return events.groupBy(key).agg(F.max(F.struct(*(F.col(o).alias(f"o{i}") for i, o in enumerate(order)), *(F.col(v).alias(f"v{i}") for i, v in enumerate(values)))).alias("m")).select(key, *(F.col(f"m.v{i}").alias(v) for i, v in enumerate(values)))


def held_keys(events: DataFrame, session: str, order: list[str]) -> DataFrame:
    """Batch: (session, key) still held at the end: last down after the last up of the key and the last blur."""
    last = events.where("kind <> 'blur'").groupBy(session, "key").agg(F.max(F.struct(*order, "kind")).alias("m"))
    blur = events.where("kind = 'blur'").groupBy(session).agg(F.max(F.struct(*order)).alias("b"))
    return last.join(blur, session, "left").where("m.kind = 'down'").where(F.col("b").isNull() | (F.struct(*(f"m.{o}" for o in order)) > F.col("b"))).select(session, "key")


def click_or_drag(events: DataFrame, pointer: str, threshold: float) -> DataFrame:
    """Batch: each up with the last down before it, and whether it moved less than the threshold."""
    up = last_before(events, pointer, ["t"], F.when(F.col("kind") == "down", F.struct("x", "y")), "d").where("kind = 'up' and d is not null")
    moved = F.sqrt(F.pow(F.col("x") - F.col("d.x"), F.lit(2.0)) + F.pow(F.col("y") - F.col("d.y"), F.lit(2.0)))
    return up.select(pointer, "t", (moved < threshold).alias("click"))


def closing_windows(events: DataFrame, key: str, time: str, width: float = 500.0) -> DataFrame:
    """Batch: (key, opened, closed, n, rate): windows that close at the first event ``width`` ms or more after they opened.

    A key's first event opens its first window and is not counted; the event that closes a window is, and opens the next. The rate is a
    second's, rounded half up. A window that no event closes has no row. ``time``: milliseconds as a double.
    """
    closed = spaced_runs(events.select(key, time), key, time, width).where("since is not null")
    rate = F.floor(F.col("rows_since") * 1000 / (F.col(time) - F.col("since")) + 0.5).cast("long")
    return closed.select(key, F.col("since").alias("opened"), F.col(time).alias("closed"), F.col("rows_since").alias("n"), rate.alias("rate"))


def throttled(events: DataFrame, key: str, time: str, width: float = 150.0, order: list[str] | None = None) -> DataFrame:
    """Batch: the events that run: a key's first at once, then none until ``width`` ms have passed."""
    return spaced_runs(events, key, time, width, order).drop("since", "rows_since")


#: Weight of the old velocity, speed that counts as a flick, its scale and bounds.
KEEP, FLICK, SCALE, SLOWEST, FASTEST = 0.6, 0.35, 2.4, 0.3, 1.8


def _step(state: tuple, kind: str, t: float, x: float) -> tuple[tuple, float | None]:
    dragging, last_t, last_x, v = state
    if kind == "down":
        return (True, t, x, 0.0), None
    if kind == "move" and dragging:
        if t > last_t:
            v = KEEP * v + (1 - KEEP) * (x - last_x) / (t - last_t)
        return (True, t, x, v), None
    if kind == "up" and dragging:
        speed = min(FASTEST, max(SLOWEST, abs(v) * SCALE)) if abs(v) > FLICK else 0.0
        return (False, t, x, v), speed if v >= 0 else -speed
    return state, None


def flick_speeds(events: DataFrame, pointer: str = "pointer") -> DataFrame:
    """Stream of (pointer, t, kind, x) -> (pointer, t, speed) at each release, with state per pointer."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        state, out = (held.get if held.exists else (False, 0.0, 0.0, 0.0)), []
        rows = pd.concat([frame[["t", "kind", "x"]] for frame in frames])  # a pointer's events of one batch, which may span frames
        for t, kind, x in rows.sort_values("t", kind="stable").itertuples(index=False):
            state, speed = _step(state, kind, t, x)
            if speed is not None:
                out.append((key[0], t, speed))
        held.update(state)
        yield pd.DataFrame(out, columns=[pointer, "t", "speed"])

    return events.groupBy(pointer).applyInPandasWithState(run, f"{pointer} string, t double, speed double", "dragging boolean, t double, x double, v double", "append", GroupStateTimeout.NoTimeout)


def _keyed(events: DataFrame, key: str, columns: list[str], step, start: tuple, state: str, out: str) -> DataFrame:
    """A stream of one row per emitted step: ``step(state, *columns)`` gives the next state and the row or None. Events of a batch are taken by ``t``."""

    def run(name: tuple, frames: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        now, rows = (held.get if held.exists else start), []
        batch = pd.concat([frame[["t", *columns]] for frame in frames])  # a key's events of one batch, which may span frames
        for event in batch.sort_values("t", kind="stable").itertuples(index=False):
            now, row = step(now, *event)
            if row is not None:
                rows.append((name[0], *row))
        held.update(now)
        yield pd.DataFrame(rows, columns=[f.split()[0] for f in out.split(", ")])

    return events.groupBy(key).applyInPandasWithState(run, out, state, "append", GroupStateTimeout.NoTimeout)


def changes_stream(events: DataFrame, key: str = "key") -> DataFrame:
    """Stream of (key, t, value string) -> (key, t, value) where the value differs from the key's last one; the first counts."""

    def step(state: tuple, t: float, value: str):
        seen, last = state
        return (True, value), None if seen and value == last else (t, value)

    return _keyed(events, key, ["value"], step, (False, None), "seen boolean, last string", f"{key} string, t double, value string")


def held_keys_stream(events: DataFrame, session: str = "session") -> DataFrame:
    """Stream of (session, t, kind, key) -> (session, t, held) after every event that changes the held keys; ``held`` is sorted and comma-joined."""

    def step(state: tuple, t: float, kind: str, key: str):
        held = set(state[0].split(",")) - {""}
        after = set() if kind == "blur" else held | {key} if kind == "down" else held - {key}
        written = ",".join(sorted(after))
        return (written,), None if after == held else (t, written)

    return _keyed(events, session, ["kind", "key"], step, ("",), "held string", f"{session} string, t double, held string")


def clicks_stream(events: DataFrame, threshold: float, pointer: str = "pointer") -> DataFrame:
    """Stream of (pointer, t, kind, x, y) -> (pointer, t, click) at each up after a down; a click moved less than the threshold."""

    def step(state: tuple, t: float, kind: str, x: float, y: float):
        down, x0, y0 = state
        if kind == "down":
            return (True, x, y), None
        if kind == "up" and down:
            return state, (t, bool(((x - x0) ** 2 + (y - y0) ** 2) ** 0.5 < threshold))
        return state, None

    return _keyed(events, pointer, ["kind", "x", "y"], step, (False, 0.0, 0.0), "down boolean, x double, y double", f"{pointer} string, t double, click boolean")


def command_log(events: DataFrame, session: str, order: list[str]) -> DataFrame:
    """Batch: every command with its number in the session, so that the same one given again is a new row."""
    return events.withColumn("seq", F.row_number().over(Window.partitionBy(session).orderBy(*order)).cast("long"))
