"""Topologies: shared arcs in delta-coded whole numbers, decoded to features, simplified and quantized."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.arrays import bound, running

_SCHEMA = "arcs array<array<array<double>>>, transform struct<scale:array<double>,translate:array<double>>, objects struct<`{name}`:struct<geometries:array<struct<type:string,id:string,arcs:string,properties:struct<{properties}>>>>>"


def read_arcs(spark: SparkSession, path: str) -> DataFrame:
    """(arc, points): the arcs of a topology file with their places; whole numbers are differences to be scaled, others stand as they are."""
    rows = spark.read.schema(_SCHEMA.format(name="none", properties="x:string")).option("multiLine", True).json(path)
    each = rows.select("transform", F.posexplode("arcs").alias("arc", "p"))

    def coordinate(i: int):
        steps = F.transform("p", lambda q: q[i])
        summed = bound(steps, lambda v: F.zip_with(running(v, lambda x, y: x + y, F.lit(0.0)), v, lambda before, x: before + x))
        return F.when(F.col("transform").isNull(), steps).otherwise(F.transform(summed, lambda x: x * F.col("transform.scale")[i] + F.col("transform.translate")[i]))

    return each.select("arc", F.zip_with(coordinate(0), coordinate(1), lambda x, y: F.struct(x.alias("lng"), y.alias("lat"))).alias("points"))


def read_features(spark: SparkSession, path: str, name: str, properties: str) -> DataFrame:
    """(id, ordinal, type, polygons, properties...) of one object: arcs joined to rings; a negative number is an arc turned round."""
    rows = spark.read.schema(_SCHEMA.format(name=name, properties=properties)).option("multiLine", True).json(path)
    each = rows.select(F.posexplode(f"objects.`{name}`.geometries").alias("ordinal", "g")).select("ordinal", F.coalesce("g.id", F.concat(F.lit("feature-"), F.col("ordinal").cast("string"))).alias("id"), "g.type", F.when(F.col("g.type") == "Polygon", F.concat(F.lit("["), F.col("g.arcs"), F.lit("]"))).otherwise(F.col("g.arcs")).alias("arcs"), "g.properties.*")
    parsed = each.withColumn("arcs", F.when(F.col("type").isin("Polygon", "MultiPolygon"), F.from_json("arcs", "array<array<array<int>>>")))
    placed = parsed.select("ordinal", F.posexplode("arcs").alias("polygon", "rings")).select("ordinal", "polygon", F.posexplode("rings").alias("ring", "parts")).select("ordinal", "polygon", "ring", F.posexplode("parts").alias("at", "n"))
    arcs = read_arcs(spark, path).select(F.col("arc").alias("n"), "points")
    arcs = arcs.union(arcs.select(-1 - F.col("n"), F.reverse("points")))
    # an arc begins where the one before it ended, so only the first of a ring keeps its first point
    rings = placed.join(arcs, "n").withColumn("points", F.when(F.col("at") == 0, F.col("points")).otherwise(F.slice("points", 2, F.greatest(F.size("points") - 1, F.lit(0)))))

    def in_order(df: DataFrame, keys: list[str], by: str, item: str, out: str) -> DataFrame:
        return df.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct(by, item))), lambda x: x[item]).alias(out))

    lines = in_order(rings, ["ordinal", "polygon", "ring"], "at", "points", "points").withColumn("points", F.flatten("points"))
    polygons = in_order(in_order(lines, ["ordinal", "polygon"], "ring", "points", "rings"), ["ordinal"], "polygon", "rings", "polygons")
    return parsed.drop("arcs").join(polygons, "ordinal", "left")


def _triangles(points: np.ndarray) -> np.ndarray:
    """By Visvalingam's rule, the area on the unit sphere at which each inner point goes; ends never go (infinity)."""
    lng, lat = np.radians(points[:, 0]), np.radians(points[:, 1])
    at = np.stack([np.cos(lat) * np.cos(lng), np.cos(lat) * np.sin(lng), np.sin(lat)], axis=1)
    left, right = list(range(-1, len(at) - 1)), list(range(1, len(at) + 1))
    out = np.full(len(at), np.inf)

    def area(i: int) -> float:
        a, b, c = at[left[i]], at[i], at[right[i]]
        return abs(2 * np.arctan2(np.dot(a, np.cross(b, c)), 1 + a @ b + b @ c + c @ a))

    from heapq import heapify, heappop, heappush

    now = {i: area(i) for i in range(1, len(at) - 1)}
    heap = [(v, i) for i, v in now.items()]
    heapify(heap)
    most = 0.0
    while heap:
        v, i = heappop(heap)
        if now.get(i) != v:
            continue
        most = out[i] = max(most, v)
        del now[i]
        a, b = left[i], right[i]
        right[a], left[b] = b, a
        for j in (a, b):
            if j in now:
                now[j] = area(j)
                heappush(heap, (now[j], j))
    return out


def simplified(arcs: DataFrame, quantile: float = 0.35, steps: float = 1e5) -> DataFrame:
    """arcs(arc, points) without the inner points whose triangle lies under the quantile of all, then moved to a grid of ``steps``.

    An arc is shared by its neighbours, so both lose the same points. The quantile is exact, over all inner points.
    """

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            areas = [_triangles(np.array([(p["lng"], p["lat"]) for p in points], float).reshape(-1, 2)) for points in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(areas, pa.list_(pa.float64()))], ["arc", "points", "areas"])

    weighed = arcs.select(F.col("arc").cast("long").alias("arc"), "points").mapInArrow(weigh, "arc long, points array<struct<lng:double,lat:double>>, areas array<double>")
    inner = weighed.select(F.explode("areas").alias("a")).where("a < double('infinity')")
    bounds = weighed.select(F.explode("points").alias("p")).agg(F.min("p.lng").alias("x0"), F.max("p.lng").alias("x1"), F.min("p.lat").alias("y0"), F.max("p.lat").alias("y1"))
    one = inner.agg(F.percentile("a", F.lit(quantile)).alias("least")).join(bounds)  # one row each
    kept = weighed.join(F.broadcast(one)).withColumn("points", F.filter("points", lambda p, i: (F.col("areas")[i] >= F.coalesce("least", F.lit(0.0)))))

    def on_grid(x, low: str, high: str):
        step = (F.col(high) - F.col(low)) / (steps - 1)
        return F.when(step > 0, F.round((x - F.col(low)) / F.nullif(step, F.lit(0.0))) * step + F.col(low)).otherwise(x)

    return kept.select("arc", F.transform("points", lambda p: F.struct(on_grid(p["lng"], "x0", "x1").alias("lng"), on_grid(p["lat"], "y0", "y1").alias("lat"))).alias("points"))
