"""Scans along a key's order that no task makes alone.

Rows are dealt by ranges of (key, order) and written once, each range sorted. A key may fill many ranges, and only the first key of a range can have begun
in an earlier one, so what is carried between ranges is one row per range at most and is broadcast. Each range then goes on from what it was given.
Order columns should tell rows apart; rows alike in key and order stay in one range.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .steps import written

PARTS = 64


def dealt(rows: DataFrame, key: str, order: list[str], parts: int = PARTS) -> DataFrame:
    """The rows with the range they are in (``__part``), written; a range's rows are sorted by key and order."""
    return written(rows.repartitionByRange(parts, key, *order).sortWithinPartitions(key, *order).withColumn("__part", F.spark_partition_id()))


def _given(ranges: DataFrame, carry: DataFrame, key: str) -> DataFrame:
    """The rows with the columns of ``carry``(__key, __in, ...), which has a row per range at most."""
    joined = ranges.join(F.broadcast(carry), F.col(key).eqNullSafe(F.col("__key")) & (F.col("__part") == F.col("__in")), "left")
    return joined.drop("__key", "__in")


def _carried(ranges: DataFrame, key: str, value: Column, carry: Column) -> DataFrame:
    """``value`` aggregated by key and range, then ``carry`` of the key's earlier ranges."""
    earlier = Window.partitionBy("__key").orderBy("__in").rowsBetween(Window.unboundedPreceding, -1)
    by_range = ranges.groupBy(F.col(key).alias("__key"), F.col("__part").alias("__in")).agg(value.alias("__value"))
    before = by_range.withColumns({"__carry": carry.over(earlier), "__begun": F.count("*").over(earlier)})
    return before.where("__begun > 0").select("__key", "__in", "__carry")


def running_sum(rows: DataFrame, key: str, order: list[str], value: Column, parts: int = PARTS) -> DataFrame:
    """The rows with ``running``: the sum of a key's values up to each row."""
    ranges = dealt(rows.withColumn("__now", value), key, order, parts)
    given = _given(ranges, _carried(ranges, key, F.sum("__now"), F.sum("__value")), key)
    inside = F.sum("__now").over(Window.partitionBy("__part", key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    both = F.when(inside.isNull(), F.col("__carry")).when(F.col("__carry").isNull(), inside).otherwise(inside + F.col("__carry"))
    return given.withColumn("running", both).drop("__now", "__part", "__carry")


def changes_only(rows: DataFrame, key: str, order: list[str], value: Column, parts: int = PARTS) -> DataFrame:
    """Rows whose value differs from that of the key's row before; first rows included."""
    ranges = dealt(rows.withColumn("__now", value), key, order, parts)
    last = F.max_by(F.struct("__now"), F.struct(*order))
    given = _given(ranges, _carried(ranges, key, last, F.last("__value")), key)
    w = Window.partitionBy("__part", key).orderBy(*order)
    marked = given.withColumn("__before", F.coalesce(F.lag(F.struct("__now")).over(w), F.col("__carry")))
    changed = marked.where(F.col("__before").isNull() | ~F.col("__now").eqNullSafe(F.col("__before.__now")))
    return changed.drop("__now", "__part", "__carry", "__before")


def last_before(rows: DataFrame, key: str, order: list[str], value: Column, name: str, parts: int = PARTS) -> DataFrame:
    """The rows with ``name``: the key's last value before each row that is not null."""
    ranges = dealt(rows.withColumn("__now", value), key, order, parts)
    last = F.max_by("__now", F.when(F.col("__now").isNotNull(), F.struct(*order)))
    given = _given(ranges, _carried(ranges, key, last, F.last("__value", ignorenulls=True)), key)
    w = Window.partitionBy("__part", key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return given.withColumn(name, F.coalesce(F.last("__now", ignorenulls=True).over(w), F.col("__carry"))).drop("__now", "__part", "__carry")


def places(rows: DataFrame, key: str, order: list[str], parts: int = PARTS) -> DataFrame:
    """The rows with ``position`` (from 1) in their key's order and ``first_row``: the order columns of the key's first row."""
    ranges = dealt(rows, key, order, parts)
    by_range = ranges.groupBy(F.col(key).alias("__key"), F.col("__part").alias("__in")).agg(F.count("*").alias("__n"), F.min(F.struct(*order)).alias("__least"))
    earlier = Window.partitionBy("__key").orderBy("__in").rowsBetween(Window.unboundedPreceding, -1)
    carry = by_range.select("__key", "__in", F.sum("__n").over(earlier).alias("__before"), F.first("__least").over(earlier).alias("__first")).where("__before is not null")
    here = Window.partitionBy("__part", key)
    placed = _given(ranges, carry, key).withColumns({"position": F.row_number().over(here.orderBy(*order)) + F.coalesce("__before", F.lit(0)), "first_row": F.coalesce("__first", F.min(F.struct(*order)).over(here))})
    return placed.drop("__part", "__before", "__first")


_ENTRIES = "__key {key}, __in int, n long, times array<double>, opens array<double>, left array<long>"


def _exits(times: np.ndarray, starts: np.ndarray, width: float) -> np.ndarray:
    """For each start (a place in ``times``) the last place of the chain of runs that begins there."""
    at = starts.copy()
    while True:
        after = np.searchsorted(times, times[at] + width)
        on = after < len(times)
        if not on.any():
            return at
        at = np.where(on, np.minimum(after, len(times) - 1), at)


def _runs_of_keys(batch: pa.RecordBatch, key: str) -> Iterator[tuple[object, int, int]]:
    """(key, from, to) of the neighbouring rows with one key."""
    codes = batch.column(key).dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
    edges = [0, *(np.flatnonzero(np.diff(codes)) + 1).tolist(), len(codes)]
    for a, b in zip(edges, edges[1:], strict=False):
        if b > a:
            yield batch.column(key)[a].as_py(), a, b


def _entries(ranges: DataFrame, key: str, time: str, width: float) -> DataFrame:
    """For a range's first and last key: the times at which a run of an earlier range can hand over, the run that then is the last one here, and the rows after it.

    A run before the range ends less than ``width`` after the range's begin, so only so many times can be first.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first: tuple | None = None
        now: tuple | None = None
        part = None
        for batch in batches:
            times = batch.column(time).to_numpy(zero_copy_only=False)
            for k, a, b in _runs_of_keys(batch, key):
                part = batch.column("__part")[a].as_py()
                if now and now[0] == k:
                    now[1].append(times[a:b])
                else:
                    first, now = first or now, (k, [times[a:b]])
        out = []
        for k, pieces in [x for x in (first, now) if x]:
            t = np.concatenate(pieces)
            some = np.arange(min(len(t), np.searchsorted(t, t[0] + width) + 1))
            last = _exits(t, some, width)
            kept = np.flatnonzero(np.append(last[1:] != last[:-1], True))  # of times with one exit, the latest
            out.append({"__key": k, "__in": part, "n": len(t), "times": t[kept].tolist(), "opens": t[last[kept]].tolist(), "left": (len(t) - 1 - last[kept]).tolist()})
        if out:
            yield pa.RecordBatch.from_pylist(out, pa.schema([("__key", batch.schema.field(key).type), ("__in", pa.int32()), ("n", pa.int64()), ("times", pa.list_(pa.float64())), ("opens", pa.list_(pa.float64())), ("left", pa.list_(pa.int64()))]))

    return ranges.select(key, time, "__part").mapInArrow(run, _ENTRIES.format(key=ranges.schema[key].dataType.simpleString()))


def _handed_over(entries: DataFrame, width: float) -> DataFrame:
    """(__key, __in, __open, __count): the run that is open when a range begins and the rows since; a row per range after a key's first."""

    def fold(rows: pa.Table) -> pa.Table:
        out, opened, count = [], None, 0
        for r in sorted(rows.to_pylist(), key=lambda r: r["__in"]):
            if opened is None:
                at = 0  # the key begins here; its first row is a run
            else:
                out.append({"__key": r["__key"], "__in": r["__in"], "__open": opened, "__count": count})
                at = bisect_left(r["times"], opened + width)
            if at < len(r["times"]):
                opened, count = r["opens"][at], r["left"][at]
            else:
                count += r["n"]
        return pa.Table.from_pylist(out, pa.schema([rows.schema.field("__key"), ("__in", pa.int32()), ("__open", pa.float64()), ("__count", pa.int64())]))

    kind = entries.schema["__key"].dataType.simpleString()
    return entries.groupBy("__key").applyInArrow(fold, f"__key {kind}, __in int, __open double, __count long")


def spaced_runs(events: DataFrame, key: str, time: str, width: float, order: list[str] | None = None, parts: int = PARTS) -> DataFrame:
    """The events that run: a key's first, then each first event ``width`` or more after the last that ran.

    Adds ``since`` (the run before, null for the first) and ``rows_since`` (events after it, this one included). ``time`` is a double without nulls.
    """
    ranges = dealt(events, key, [time, *(order or [])], parts)
    given = _given(ranges, _handed_over(_entries(ranges, key, time, width), width), key)
    columns = events.columns
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in events.schema.fields) + ", since double, rows_since long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, opened, count = object(), None, 0
        for batch in batches:
            times, kept, since, rows = batch.column(time).to_numpy(zero_copy_only=False), [], [], []
            for k, a, b in _runs_of_keys(batch, key):
                if not (k == last):
                    last, opened, count = k, batch.column("__open")[a].as_py(), batch.column("__count")[a].as_py() or 0
                at = a
                while at < b:
                    to = at if opened is None else a + int(np.searchsorted(times[a:b], opened + width))
                    to = max(to, at)
                    if to >= b:
                        count += b - at
                        break
                    kept.append(to)
                    since.append(opened)
                    rows.append(count + to - at + 1 if opened is not None else None)
                    opened, count, at = float(times[to]), 0, to + 1
            chosen = batch.select(columns).take(pa.array(kept, pa.int64()))
            yield pa.RecordBatch.from_arrays([*chosen.columns, pa.array(since, pa.float64()), pa.array(rows, pa.int64())], [*columns, "since", "rows_since"])

    return given.mapInArrow(run, ddl)


def numbered(rows: DataFrame, order: list[str], name: str, parts: int = PARTS) -> DataFrame:
    """The rows with a number from 0 in the order of the columns."""
    first, *rest = order
    ranges = dealt(rows, first, rest, parts)
    sizes = ranges.groupBy(F.col("__part").alias("__in")).agg(F.count("*").alias("__n"))  # a row per range
    starts = sizes.select("__in", F.coalesce(F.sum("__n").over(Window.orderBy("__in").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__start"))
    placed = ranges.withColumn("__at", F.row_number().over(Window.partitionBy("__part").orderBy(*order)))
    return placed.join(F.broadcast(starts), F.col("__part") == F.col("__in")).withColumn(name, F.col("__start") + F.col("__at") - 1).drop("__part", "__in", "__at", "__start")
