"""The nearest place in a direction, for any number of origins.

Places lie in cells of a cube grid around the unit sphere. In a round with cells of side h an origin looks at its own cell and the 26 around it, which
hold every place within a chord of h. So the best place found is final once its chord is h or less (stop rule); other origins go on
to cells four times as wide. The last cells are so wide that all places are seen. The first cells are the widest that hold at most ``CROWD`` places each.

"Under 90 degrees off the direction" is a half-space through the sphere's centre. Cells are kept with the box of their places; an origin skips
boxes that lie wholly outside its half-space before any place is compared. Places at one spot are one place, that of the least ``ord``, and origins are
asked once per spot and direction, so crowds at a spot cost nothing more.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import angular_distance, bearing, normalize_angle
from .steps import written

#: Sides of the cells, the widest first: two of these cells span the sphere.
SIDES = [2.0 / 4**k for k in range(11)]
CROWD = 32
#: Rounding allowance of the half-space and stop tests; both only decide what is compared exactly.
SLACK = 1e-9


def _vector(lat: Column, lng: Column) -> list[Column]:
    a, b = F.radians(lat), F.radians(lng)
    return [F.cos(a) * F.cos(b), F.cos(a) * F.sin(b), F.sin(a)]


def _cells(side: float) -> list[Column]:
    return [F.floor(F.col(c) / side).cast("int") for c in ("x", "y", "z")]


def _first_side(places: DataFrame) -> int:
    """The place in ``SIDES`` of the widest cells that hold at most ``CROWD`` places, or of the narrowest."""
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), *(c.alias(n) for c, n in zip(_cells(s), "abc", strict=True))) for k, s in enumerate(SIDES))))
    most = places.select(each.alias("c")).select("c.*").groupBy("k", "a", "b", "c").count().groupBy("k").agg(F.max("count").alias("most")).where(F.col("most") <= CROWD)
    found = most.agg(F.min("k")).first()[0]
    return len(SIDES) - 1 if found is None else found


def _round(asking: DataFrame, places: DataFrame, side: float) -> DataFrame:
    """asking with ``m``(distance, ord, id), the best place in the 27 cells around, or null."""
    around = [F.explode(F.array(*(F.lit(i) for i in (-1, 0, 1)))).alias(n) for n in ("da", "db", "dc")]
    here = asking.select("o_lat", "o_lng", "target", "x", "y", "z", "tx", "ty", "tz")
    for d in around:
        here = here.select("*", d)
    here = here.select("o_lat", "o_lng", "target", "tx", "ty", "tz", *((c + F.col(d)).alias(n) for c, d, n in zip(_cells(side), ("da", "db", "dc"), "abc", strict=True)))
    held = places.select("*", *(c.alias(n) for c, n in zip(_cells(side), "abc", strict=True)))
    boxes = held.groupBy("a", "b", "c").agg(*(f(v).alias(f"{v}{w}") for v in ("x", "y", "z") for f, w in ((F.min, 0), (F.max, 1))))
    ahead = sum((F.greatest(F.col(f"{v}0") * F.col(f"t{v}"), F.col(f"{v}1") * F.col(f"t{v}")) for v in ("x", "y", "z")), F.lit(0.0)) > -SLACK
    seen = here.join(boxes, ["a", "b", "c"]).where(ahead).select("o_lat", "o_lng", "target", "a", "b", "c")
    pairs = seen.join(held.select("lat", "lng", "ord", "id", "a", "b", "c"), ["a", "b", "c"])
    off = F.abs(normalize_angle(bearing(F.col("o_lat"), F.col("o_lng"), F.col("lat"), F.col("lng")) - F.col("target")))
    apart = ~((F.col("lat") == F.col("o_lat")) & (F.col("lng") == F.col("o_lng")))
    best = F.min(F.struct(angular_distance(F.col("o_lat"), F.col("o_lng"), F.col("lat"), F.col("lng")).alias("distance"), "ord", "id"))
    found = pairs.where(apart & (off < math.pi / 2)).groupBy("o_lat", "o_lng", "target").agg(best.alias("m"))
    return asking.join(found, ["o_lat", "o_lng", "target"], "left")


def nearest_places(origins: DataFrame, places: DataFrame) -> DataFrame:
    """origins(id, lat, lng, target) -> (origin, id, distance): the closest place whose bearing is under 90 degrees off ``target`` (radians from north).

    Places are places(id, lat, lng, ord); those at the origin's spot do not count; ``ord`` breaks ties. Null places are left out; origins without an
    answer have no row.
    """
    spots = places.where("lat is not null and lng is not null").groupBy("lat", "lng").agg(F.min(F.struct("ord", "id")).alias("first"))
    x, y, z = _vector(F.col("lat"), F.col("lng"))
    spots = written(spots.select("lat", "lng", "first.ord", "first.id", x.alias("x"), y.alias("y"), z.alias("z")))
    asked = origins.where("lat is not null and lng is not null").select(F.col("id").alias("origin"), F.col("lat").alias("o_lat"), F.col("lng").alias("o_lng"), F.col("target").cast("double").alias("target"))
    x, y, z = _vector(F.col("o_lat"), F.col("o_lng"))
    a, b, t = F.radians("o_lat"), F.radians("o_lng"), F.col("target")
    north, east = [-F.sin(a) * F.cos(b), -F.sin(a) * F.sin(b), F.cos(a)], [-F.sin(b), F.cos(b), F.lit(0.0)]
    ahead = [F.cos(t) * n + F.sin(t) * e for n, e in zip(north, east, strict=True)]
    asking = asked.select("o_lat", "o_lng", "target").distinct().select("*", x.alias("x"), y.alias("y"), z.alias("z"), *(c.alias(n) for c, n in zip(ahead, ("tx", "ty", "tz"), strict=True)))
    answers = None
    for k in range(_first_side(spots), -1, -1):
        met = written(_round(asking, spots, SIDES[k]))
        final = F.lit(True) if k == 0 else F.col("m.distance") <= 2 * math.asin(SIDES[k] / 2) - SLACK
        done = met.where(F.col("m").isNotNull() & final).select("o_lat", "o_lng", "target", "m")
        answers = done if answers is None else answers.unionByName(done)
        asking = met.where(F.coalesce(~final, F.lit(True))).drop("m")
        if k and not asking.take(1):
            break
    return asked.join(answers, ["o_lat", "o_lng", "target"]).select("origin", "m.id", "m.distance")
