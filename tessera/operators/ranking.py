"""Rankings, searches and steps from entity to entity."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import match_tier
from . import segments
from .nearest import nearest_places
from .steps import written

BEARINGS = {"north": 0.0, "east": math.pi / 2, "south": math.pi, "west": -math.pi / 2}


def sort_state(current: tuple[str, bool], clicked: str) -> tuple[str, bool]:
    """(key, descending) after a click: the same key turns round; a new one starts descending, a name ascending."""
    return (clicked, not current[1]) if current[0] == clicked else (clicked, clicked != "name")


def sort_keys(key: str, descending: bool, score: str = "score", name: str = "name") -> list[Column]:
    """Component nulls come last either way; missing scores count as -1; ties by name, in the order of a reader's alphabet."""
    letters = F.collate(F.col(name), "UNICODE")
    if key == name:
        return [letters.desc() if descending else letters.asc()]
    by = F.coalesce(F.col(score), F.lit(-1.0)) if key == score else F.col(key)
    return [by.desc_nulls_last() if descending else by.asc_nulls_last(), letters.asc()]


def ranked(df: DataFrame, key: str, descending: bool = True, score: str = "score", name: str = "name", within: list[str] | None = None, tie: list[str] | None = None, parts: int = 64) -> DataFrame:
    """Adds ``position`` within groups, or in the whole table.

    A whole table is dealt by ranges of the order (``parts`` of them) and written; a range counts on from the rows before it, so
    no task sorts all rows.
    """
    keys = [*sort_keys(key, descending, score, name), *(F.col(t).asc() for t in tie or [])]
    if within:
        return df.withColumn("position", F.row_number().over(Window.partitionBy(*within).orderBy(*keys)).cast("long"))
    dealt = written(df.repartitionByRange(parts, *keys).withColumn("__part", F.spark_partition_id()))
    sizes = dealt.groupBy("__part").agg(F.count("*").alias("__n"))  # at most ``parts`` rows
    starts = sizes.select("__part", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__start"))
    placed = dealt.withColumn("__at", F.row_number().over(Window.partitionBy("__part").orderBy(*keys)))
    return placed.join(F.broadcast(starts), "__part").withColumn("position", F.col("__start") + F.col("__at")).drop("__part", "__at", "__start")


def tiered_search(sources: list[DataFrame], query: str, k: int = 8) -> DataFrame:
    """First k of the sources' (ord, name) rows: equal names, then starts, then contained; then source, then ord."""
    rows = None
    for i, s in enumerate(sources):
        part = s.select(F.lit(i).alias("source"), "ord", "name")
        rows = part if rows is None else rows.union(part)
    return rows.withColumn("tier", match_tier(F.col("name"), F.lit(query))).where("tier is not null").orderBy("tier", "source", "ord").limit(k)


def nearest_in_direction(origins: DataFrame, places: DataFrame, direction: str) -> DataFrame:
    """(origin id, id, distance): the closest place whose bearing is under 90 degrees off; (ord) breaks ties. See ``nearest_places``."""
    return nearest_places(origins.withColumn("target", F.lit(BEARINGS[direction])), places)


def next_category(order: list[str], current: str | None, step: int) -> str:
    """Wraps round; without a selection a step forward gives the first, a step back counts from -1."""
    at = order.index(current) if current in order else -1
    return order[(at + step) % len(order)]


def first_by_name(df: DataFrame, category: str) -> DataFrame:
    return df.where(F.col("category") == category).orderBy(F.collate("name", "UNICODE"), "id").limit(1)


def grouped_lists(df: DataFrame, key: str, order: str, item: str) -> DataFrame:
    """Lists in order, groups by their first row (``first_ord``); a group's list is one row. See ``grouped_rows`` for groups of any size."""
    return df.groupBy(key).agg(F.min(order).alias("first_ord"), F.transform(F.sort_array(F.collect_list(F.struct(order, item))), lambda x: x[item]).alias("items"))


def grouped_rows(df: DataFrame, key: str, order: str) -> DataFrame:
    """The rows with ``first_ord`` of their group and their ``position`` in it: sorted by both they read as ``grouped_lists`` does. No task holds a group."""
    placed = segments.places(df, key, [order])
    return placed.withColumn("first_ord", F.col(f"first_row.{order}")).drop("first_row")
