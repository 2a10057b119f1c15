"""Borders as segments, with running distances, one row per segment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.arrays import running_sum as running_sum_of
from .segments import running_sum as running_sum
from .steps import written


def _pairs(ring: Column) -> Column:
    n = F.greatest(F.size(ring) - 1, F.lit(0))
    return F.zip_with(F.slice(ring, 1, n), F.slice(ring, 2, n), lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def segments(lines: DataFrame, key: str, rings: str) -> DataFrame:
    """(key, ring, at, a, b): n - 1 segments of each ring or line; lines are not closed. See ``line_rings`` for mixed features."""
    each = lines.select(key, F.posexplode(rings).alias("ring", "r"))
    return each.select(key, "ring", F.posexplode(_pairs(F.col("r"))).alias("at", "s")).select(key, "ring", "at", "s.a", "s.b")


def line_rings(features: DataFrame, rings: str = "rings", kind: str = "type") -> DataFrame:
    """Features whose lines count as rings: those of LineString and MultiLineString; all others have none."""
    return features.withColumn(rings, F.when(F.col(kind).isin("LineString", "MultiLineString"), F.col(rings)).otherwise(F.filter(rings, lambda r: F.lit(False))))


def running_share(lines: DataFrame, key: str, rings: str, distance) -> DataFrame:
    """segments with ``from_share`` and ``to_share`` of the ring's length; a ring without length divides by 1."""
    each = lines.select(key, F.posexplode(rings).alias("ring", "r")).withColumn("s", F.transform(_pairs(F.col("r")), lambda s: F.struct(s["a"].alias("a"), s["b"].alias("b"), distance(s["a"], s["b"]).alias("d"))))
    whole = F.aggregate("s", F.lit(0.0), lambda so, x: so + x["d"])
    each = each.withColumns({"whole": F.when(whole > 0, whole).otherwise(1.0), "sums": running_sum_of(F.transform("s", lambda x: x["d"]))})
    out = each.select(key, "ring", "whole", "sums", F.posexplode("s").alias("at", "s"))
    return out.select(key, "ring", "at", "s.a", "s.b", (F.col("sums")[F.col("at")] / F.col("whole")).alias("from_share"), ((F.col("sums")[F.col("at")] + F.col("s.d")) / F.col("whole")).alias("to_share"))


def distinct_edges(segment: DataFrame) -> DataFrame:
    """Every border once, whichever way its sides run."""
    return segment.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def buffer_offsets(rows: DataFrame, group: str | None, order: str, vertices: str, faces: str, parts: int = 64) -> DataFrame:
    """Start of each row's vertices and faces in its group's joined buffer; without a group, in one buffer of all rows.

    One buffer is summed by ranges of the order (``parts`` of them, written once), which count on from the ranges before.
    """
    names = (vertices, faces)
    if group is None:
        dealt = written(rows.repartitionByRange(parts, order).withColumn("__part", F.spark_partition_id()))
        totals = dealt.groupBy("__part").agg(*(F.sum(n).alias(f"__{n}") for n in names))  # at most ``parts`` rows
        ahead = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
        starts = totals.select("__part", *(F.coalesce(F.sum(f"__{n}").over(ahead), F.lit(0)).alias(f"__{n}_ahead") for n in names))
        placed = buffer_offsets(dealt, "__part", order, vertices, faces).join(F.broadcast(starts), "__part")
        return placed.withColumns({f"{n}_start": F.col(f"{n}_start") + F.col(f"__{n}_ahead") for n in names}).drop("__part", *(f"__{n}_ahead" for n in names))
    before = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumns({f"{n}_start": F.coalesce(F.sum(n).over(before), F.lit(0)) for n in names})


def rebased(rows: DataFrame, indices: str = "indices") -> DataFrame:
    """Rows of ``buffer_offsets`` with their vertex indices moved to the joined buffer."""
    return rows.withColumn(indices, F.transform(indices, lambda i: i + F.col("vertices_start")))
