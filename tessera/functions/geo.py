"""Places on a sphere (degrees in, radians for angles) and rings as ``array<struct<lng,lat>>``."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .arrays import bound, running_sum

TURN = 2 * math.pi


def to_vector(lat: Column, lng: Column, radius: float = 1.0) -> Column:
    phi, theta = F.radians(90 - lat), F.radians(lng + 180)
    return F.struct((-radius * F.sin(phi) * F.cos(theta)).alias("x"), (radius * F.cos(phi)).alias("y"), (radius * F.sin(phi) * F.sin(theta)).alias("z"))


def from_vector(v: Column) -> Column:
    """``struct<lat,lng>``; longitudes from -180 to 180."""
    r = F.sqrt(v["x"] * v["x"] + v["y"] * v["y"] + v["z"] * v["z"])
    lat = 90 - F.degrees(F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), v["y"] / r))))
    return F.struct(lat.alias("lat"), wrap_longitude(F.degrees(F.atan2(v["z"], -v["x"])) - 180).alias("lng"))


def wrap_longitude(lng: Column) -> Column:
    return F.when(lng.between(-180, 180), lng).otherwise(F.pmod(lng + 180, F.lit(360.0)) - 180)


def bearing(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Initial bearing in radians, clockwise from north."""
    a, b, d = F.radians(lat1), F.radians(lat2), F.radians(lng2 - lng1)
    return F.atan2(F.sin(d) * F.cos(b), F.cos(a) * F.sin(b) - F.sin(a) * F.cos(b) * F.cos(d))


def angular_distance(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Haversine, in radians."""
    h = F.pow(F.sin(F.radians(lat2 - lat1) / 2), F.lit(2.0)) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lng2 - lng1) / 2), F.lit(2.0))
    return 2 * F.atan2(F.sqrt(h), F.sqrt(F.greatest(F.lit(0.0), 1 - h)))


def normalize_angle(x: Column) -> Column:
    """To [-pi, pi]; both ends stay as they are."""
    rest = x % TURN
    return F.when(rest > math.pi, rest - TURN).when(rest < -math.pi, rest + TURN).otherwise(rest)


def _point(lng: Column, lat: Column) -> Column:
    return F.struct(lng.cast("double").alias("lng"), lat.cast("double").alias("lat"))


def _near(lng: Column, to: Column) -> Column:
    """``lng`` moved by full turns to at most half a turn from ``to``."""
    gap = lng - to
    return F.when(gap > 180, lng - 360 * F.ceil((gap - 180) / 360)).when(gap < -180, lng + 360 * F.ceil((-180 - gap) / 360)).otherwise(lng)


def unwrap_ring(ring: Column, anchor: Column | None = None) -> Column:
    """Longitudes without jumps over the date line; the first one near ``anchor`` where given.

    A point's whole turns are those of the steps before it, added up (see ``running``): linear in the points.
    """

    def unwrapped(r: Column) -> Column:
        first = r[0]["lng"] if anchor is None else _near(r[0]["lng"], anchor)
        before = F.concat(F.slice(r, 1, 1), F.slice(r, 1, F.greatest(F.size(r) - 1, F.lit(0))))
        turns = F.zip_with(r, before, lambda p, q: _near(p["lng"], q["lng"]) - p["lng"])
        shifts = F.zip_with(running_sum(turns), turns, lambda so_far, turn: so_far + turn + (first - r[0]["lng"]))
        return F.zip_with(r, shifts, lambda p, shift: _point(p["lng"] + shift, p["lat"]))

    return bound(ring, lambda r: F.when(F.size(r) > 0, unwrapped(r)).otherwise(F.transform(r, lambda p: _point(p["lng"], p["lat"]))))


def unwrap_polygon(rings: Column) -> Column:
    """The exterior, then holes that start near the exterior's first point."""
    outer = unwrap_ring(rings[0])
    holes = F.transform(F.slice(rings, 2, F.greatest(F.size(rings) - 1, F.lit(0))), lambda h: unwrap_ring(h, rings[0][0]["lng"]))
    return F.when(F.size(rings) > 0, F.concat(F.array(outer), holes)).otherwise(rings)


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda so, x: so + x)


def largest_exterior(polygons: Column) -> Column:
    """The exterior ring with the most points, the first of equals; null without any."""

    def largest(rings: Column) -> Column:
        return bound(F.array_max(F.transform(rings, lambda r: F.size(r))), lambda most: F.try_element_at(F.filter(rings, lambda r: F.size(r) == most), F.lit(1)))

    return bound(F.filter(F.transform(polygons, lambda rings: F.try_element_at(rings, F.lit(1))), lambda r: F.size(r) > 0), largest)


def mean_point(ring: Column) -> Column:
    return _point(total(F.transform(ring, lambda p: p["lng"])) / F.size(ring), total(F.transform(ring, lambda p: p["lat"])) / F.size(ring))


def centroid(polygons: Column) -> Column:
    """Mean of the points of the largest exterior, closing point included; (0, 0) without any."""
    mean = bound(unwrap_ring(largest_exterior(polygons)), lambda r: F.when(F.size(r) > 0, mean_point(r)))
    return F.coalesce(bound(mean, lambda m: F.when(m.isNotNull(), _point(wrap_longitude(m["lng"]), m["lat"]))), _point(F.lit(0), F.lit(0)))


def first_ring_centroid(polygons: Column) -> Column:
    """Mean of the first exterior's points as they stand."""
    return mean_point(polygons[0][0])


def area_centroid(polygons: Column) -> Column:
    """Area-weighted centre of the largest exterior; the mean of points if it has no area; (0, 0) under four points."""

    def centre(ring: Column) -> Column:
        n = F.greatest(F.size(ring) - 1, F.lit(0))
        sides = F.zip_with(F.slice(ring, 1, n), F.slice(ring, 2, n), lambda a, b: F.struct((a["lng"] * b["lat"] - b["lng"] * a["lat"]).alias("c"), (a["lng"] + b["lng"]).alias("x"), (a["lat"] + b["lat"]).alias("y")))

        def weighed(s: Column) -> Column:
            area = total(F.transform(s, lambda x: x["c"])) / 2
            return bound(area, lambda area: F.when(F.abs(area) < 1e-10, mean_point(ring)).otherwise(_point(F.try_divide(total(F.transform(s, lambda x: x["x"] * x["c"])), 6 * area), F.try_divide(total(F.transform(s, lambda x: x["y"] * x["c"])), 6 * area))))

        return F.when(F.coalesce(F.size(ring), F.lit(0)) < 4, _point(F.lit(0), F.lit(0))).otherwise(bound(sides, weighed))

    return bound(largest_exterior(polygons), centre)


def angular_extent(polygons: Column) -> Column:
    """Largest span of an exterior in degrees; rings around a pole count their latitudes only."""

    def extent(ring: Column) -> Column:
        def span(name: str) -> Column:
            return bound(F.transform(ring, lambda p: p[name]), lambda values: F.array_max(values) - F.array_min(values))

        round_pole = F.abs(F.element_at(ring, -1)["lng"] - ring[0]["lng"]) > 180
        return F.when(round_pole, span("lat")).otherwise(F.greatest(span("lat"), span("lng")))

    rings = F.filter(F.transform(polygons, lambda rings: F.try_element_at(rings, F.lit(1))), lambda r: F.size(r) > 0)
    return F.coalesce(F.array_max(F.transform(F.transform(rings, lambda r: unwrap_ring(r)), extent)), F.lit(0.0))
