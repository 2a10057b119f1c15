"""Polygons on the sphere as triangles whose flat sides stay close to it.

Each polygon (an outer ring and its holes, in degrees, longitudes unwrapped) is cut into triangles in the plane of its degrees: holes are joined to the outer ring
by a bridge to a vertex they can see, then ears are cut off. A triangle that sags too far under the sphere is halved at its
longest side, again and again. Vertices are kept as degrees, so areas add up to the polygon's.

Null polygons, rings of fewer than three different vertices and polygons without area give no triangles; holes are taken the other way round than their outer
ring, whichever way they are given; a ring that crosses itself gives the triangles found until no ear is left. One feature is cut in one row, no more.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .geo import unwrap_ring

#: Share of the radius that a triangle may sag, and halvings of one triangle at most.
MOST_SAG, MOST_DEPTH = 0.0015, 14
#: Inward corners that are tested one by one, and triangles that are halved together.
FEW, TOGETHER = 32, 512

Point = tuple[float, float]


def _twice_area(a: Point, b: Point, c: Point) -> float:
    return (b[0] - a[0]) * (c[1] - a[1]) - (c[0] - a[0]) * (b[1] - a[1])


def _ring_area(ring: list[Point]) -> float:
    return sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(ring, ring[1:] + ring[:1], strict=True)) / 2


def _cleaned(ring: list[Point], left: bool) -> list[Point]:
    """Different neighbours only, not closed, running to the left (counter-clockwise) or to the right."""
    out = [p for p, q in zip(ring, ring[1:] + ring[:1], strict=True) if p != q]
    return out if (_ring_area(out) > 0) == left else out[::-1]


def _bridged(outer: list[Point], hole: list[Point]) -> list[Point]:
    """The outer ring with the hole joined in: from the hole's rightmost vertex to the vertex of the outer ring that it sees on its right."""
    at = max(range(len(hole)), key=lambda i: hole[i])
    x, y = hole[at]
    best, reach = None, math.inf
    for i, (p, q) in enumerate(zip(outer, outer[1:] + outer[:1], strict=True)):
        if p[1] == q[1] or not min(p[1], q[1]) <= y <= max(p[1], q[1]):
            continue
        hit = p[0] + (y - p[1]) / (q[1] - p[1]) * (q[0] - p[0])
        if x <= hit < reach:
            reach, best = hit, i if p[0] > q[0] else (i + 1) % len(outer)
            best = i if (hit, y) == p else (i + 1) % len(outer) if (hit, y) == q else best
    if best is None:
        return outer
    corner = outer[best]
    if corner != (reach, y):  # a vertex within the triangle of hole, side and corner hides the corner; the one at the smallest angle is seen
        a, b = ((x, y), (reach, y)) if corner[1] > y else ((reach, y), (x, y))
        hiding = [i for i, p in enumerate(outer) if p != corner and _inside(p, a, b, corner) and _opens(outer, i, (x, y))]
        if hiding:
            best = min(hiding, key=lambda i: (abs(outer[i][1] - y) / (outer[i][0] - x) if outer[i][0] > x else math.inf, outer[i][0]))
    if not _opens(outer, best, (x, y)):  # bridges before this one gave the vertex several places; take the one that faces the hole
        best = next((i for i, p in enumerate(outer) if p == outer[best] and _opens(outer, i, (x, y))), best)
    return outer[: best + 1] + hole[at:] + hole[: at + 1] + outer[best:]


def _opens(ring: list[Point], i: int, to: Point) -> bool:
    """Whether the ring's inside at its i-th vertex looks towards a point."""
    a, b, c = ring[i - 1], ring[i], ring[(i + 1) % len(ring)]
    if _twice_area(a, b, c) >= 0:
        return _twice_area(a, b, to) >= 0 and _twice_area(b, c, to) >= 0
    return _twice_area(a, b, to) >= 0 or _twice_area(b, c, to) >= 0


def _inside(p: Point, a: Point, b: Point, c: Point) -> bool:
    return _twice_area(a, b, p) >= 0 and _twice_area(b, c, p) >= 0 and _twice_area(c, a, p) >= 0


def ears(rings: list[list[Point]]) -> list[tuple[Point, Point, Point]]:
    """Triangles of a polygon. For an ear, only inward corners can lie in the way."""
    rings = [r for r in rings if r]
    if not rings or len(set(rings[0])) < 3:
        return []
    ring = _cleaned(rings[0], True)
    for hole in sorted((_cleaned(h, False) for h in rings[1:] if len(set(h)) > 2), key=lambda h: -max(h)[0]):
        ring = _bridged(ring, hole)
    ring = [(float(x), float(y)) for x, y in ring]
    n, xy = len(ring), np.array(ring)
    before, after = [n - 1, *range(n - 1)], [*range(1, n), 0]
    out, left, at, missed = [], n, 0, 0

    def turn(i: int) -> float:
        return _twice_area(ring[before[i]], ring[i], ring[after[i]])

    inward = np.array([turn(i) <= 0 for i in range(n)])  # of the vertices not yet cut off
    while left > 3 and missed <= left:
        a, c = before[at], after[at]
        t = turn(at)
        if t == 0 or (t > 0 and not _blocked(ring, xy, inward, a, at, c)):
            if t > 0:
                out.append((ring[a], ring[at], ring[c]))
            inward[at] = False
            after[a], before[c], left, missed = c, a, left - 1, 0
            for i in (a, c):
                inward[i] = turn(i) <= 0
            at = c
        else:
            at, missed = c, missed + 1
    if left == 3 and turn(at) > 0:
        out.append((ring[before[at]], ring[at], ring[after[at]]))
    return out


def _blocked(ring: list[Point], xy: np.ndarray, others: np.ndarray, a: int, b: int, c: int) -> bool:
    """Whether one of the vertices lies in the triangle; those at its corners do not count. Few are looked at one by one, many as arrays."""
    at, corners = np.flatnonzero(others), (ring[a], ring[b], ring[c])
    (least_x, least_y), (most_x, most_y) = map(min, zip(*corners)), map(max, zip(*corners))
    if len(at) <= FEW:
        return any(least_x <= p[0] <= most_x and least_y <= p[1] <= most_y and p not in corners and _inside(p, *corners) for p in map(ring.__getitem__, at.tolist()))
    p = xy[at]
    p = p[(p[:, 0] >= least_x) & (p[:, 0] <= most_x) & (p[:, 1] >= least_y) & (p[:, 1] <= most_y)]
    if not len(p):
        return False

    def side(u: int, v: int) -> np.ndarray:
        return (xy[v, 0] - xy[u, 0]) * (p[:, 1] - xy[u, 1]) - (p[:, 0] - xy[u, 0]) * (xy[v, 1] - xy[u, 1]) >= 0

    corner = (p == xy[a]).all(axis=1) | (p == xy[b]).all(axis=1) | (p == xy[c]).all(axis=1)
    return bool((side(a, b) & side(b, c) & side(c, a) & ~corner).any())


def _sags(triangles: np.ndarray) -> np.ndarray:
    """How far each flat triangle (n x corner x degrees) lies under a unit sphere, at the middles of its sides and its own."""
    lng, lat = np.radians(np.ascontiguousarray(triangles.transpose(2, 1, 0)))  # each corner x n
    near = np.cos(lat)
    sides, whole = 0.0, 0.0
    for v in (near * np.cos(lng), near * np.sin(lng), np.sin(lat)):
        sides = sides + ((v + v[[1, 2, 0]]) / 2) ** 2
        whole = whole + ((v[0] + v[1] + v[2]) / 3) ** 2
    return 1 - np.sqrt(np.minimum(sides.min(axis=0), whole))


def sag(triangle: tuple[Point, Point, Point]) -> float:
    return float(_sags(np.array([triangle], float))[0])


def halved(triangles: np.ndarray, most_sag: float = MOST_SAG, most_depth: int = MOST_DEPTH) -> tuple[np.ndarray, np.ndarray]:
    """The parts of many triangles, in their order, and the place of the triangle that each is of. All that sag too far are halved together, round by round."""
    parts, of = triangles, np.arange(len(triangles))
    new = of  # the parts not looked at yet
    for _ in range(most_depth):
        wide = new[~(_sags(parts[new]) <= most_sag)]
        if not len(wide):
            break
        t, row = parts[wide], np.arange(len(wide))
        across, up = (t - t[:, [1, 2, 0]]).transpose(2, 0, 1)
        k = (across**2 + up**2).argmax(axis=1)
        p, q, r = (t[row, (k + i) % 3] for i in range(3))
        times = np.ones(len(parts), int)
        times[wide] = 2
        parts, of = parts.repeat(times, axis=0), of.repeat(times)
        first = wide + row  # each one before has become two
        parts[first], parts[first + 1] = np.stack([p, (p + q) / 2, r], axis=1), np.stack([(p + q) / 2, q, r], axis=1)
        new = np.stack([first, first + 1], axis=1).ravel()
    return parts, of


def refined(triangle: tuple[Point, Point, Point], most_sag: float = MOST_SAG, most_depth: int = MOST_DEPTH) -> Iterator[tuple[Point, Point, Point]]:
    return (tuple(map(tuple, t)) for t in halved(np.array([triangle], float), most_sag, most_depth)[0].tolist())


_PLACE = "struct<lng:double,lat:double>"


def triangulated(features: DataFrame, id_col: str = "id", polygons: str = "polygons", most_sag: float = MOST_SAG, most_depth: int = MOST_DEPTH) -> DataFrame:
    """(id, polygon, at, a, b, c): the triangles of each feature, numbered within its polygon. Cutting costs far more than reading: polygons are dealt to all tasks, however few files they come from."""
    each = features.select(F.col(id_col).alias("id"), F.posexplode(polygons).alias("polygon", "rings")).where("size(rings) > 0")
    first = unwrap_ring(F.col("rings")[0])
    flat = F.transform("rings", lambda r, i: F.when(i == 0, first).otherwise(unwrap_ring(r, F.get(first, F.lit(0))["lng"])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rings = ([[(p["lng"], p["lat"]) for p in ring or []] for ring in polygon.as_py()] for polygon in batch.column(2))
            found = ((row, t) for row, polygon in enumerate(rings) for t in ears(polygon))
            last, n = -1, 0  # the row that the triangles so far end in, and its parts
            while some := list(islice(found, TOGETHER)):
                parts, of = halved(np.array([t for _, t in some]), most_sag, most_depth)
                rows = np.array([row for row, _ in some])[of]
                at = np.arange(len(rows)) - np.searchsorted(rows, rows) + np.where(rows == last, n, 0)
                last, n = rows[-1], at[-1] + 1
                same = pa.array(rows)
                corners = [pa.StructArray.from_arrays([pa.array(parts[:, k, d]) for d in (0, 1)], ["lng", "lat"]) for k in range(3)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(same), batch.column(1).take(same), pa.array(at.astype(np.int32)), *corners], ["id", "polygon", "at", "a", "b", "c"])

    kind = each.schema["id"].dataType.simpleString()
    spark = features.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return each.repartition(tasks).select("id", "polygon", flat.alias("rings")).mapInArrow(run, f"id {kind}, polygon int, at int, a {_PLACE}, b {_PLACE}, c {_PLACE}")
