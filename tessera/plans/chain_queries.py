"""Queries of shared arcs, nearest places, closing windows, throttling and generations, each with DuckDB SQL for the same rows."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo, triangles
from ..operators import nearest
from ..sources import shared_arcs
from ..streaming import generations, telemetry
from .driver_queries import _floor, _t, query


def _square(x: Column, y: Column) -> Column:
    return F.array(F.array(F.array(*(F.struct((x + a).cast("double").alias("lng"), (y + b).cast("double").alias("lat")) for a, b in ((0, 0), (1, 0), (1, 1), (0, 1), (0, 0))))))


@query("""WITH s AS (SELECT c_custkey AS k, c_custkey % 40 AS x, c_custkey // 40 + c_custkey // 200 AS y FROM customer),
r AS (SELECT k, [{'lng': x, 'lat': y}, {'lng': x + 1, 'lat': y}, {'lng': x + 1, 'lat': y + 1}, {'lng': x, 'lat': y + 1}] AS ring FROM s),
v AS (SELECT k, i, ring, ring[i + 1] AS p, list_sort([ring[(i + 3) % 4 + 1], ring[(i + 1) % 4 + 1]]) AS pair FROM r, range(4) t(i)),
j AS (SELECT p FROM v GROUP BY p HAVING count(DISTINCT pair) > 1),
starts AS (SELECT v.k, i, ring, count(j.p) OVER (PARTITION BY k) AS n, j.p IS NOT NULL AS cut, p = min(v.p) OVER (PARTITION BY k) AS least FROM v LEFT JOIN j USING (p)),
a AS (SELECT k, ring, i, coalesce(lead(i) OVER w, first_value(i) OVER w + 4) AS e FROM starts WHERE cut OR (n = 0 AND least) WINDOW w AS (PARTITION BY k ORDER BY i)),
l AS (SELECT list_transform(range(i, e + 1), lambda q: ring[q % 4 + 1]) AS line FROM a),
c AS (SELECT CASE WHEN line <= list_reverse(line) THEN line ELSE list_reverse(line) END AS points FROM l)
SELECT row_number() OVER (ORDER BY points) - 1 AS arc, array_to_string(list_transform(points, lambda q: q.lng || ' ' || q.lat), ',') AS line, count(*) AS users FROM c GROUP BY points""")
def arcs_of_squares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A square for each customer, in blocks of five rows; borders between neighbours are one arc."""
    k = F.col("c_custkey")
    squares = _t(spark, sf_dir, "customer").select(k.alias("id"), _square(k % 40, F.floor(k / 40) + F.floor(k / 200)).alias("polygons"))
    arcs, _ = shared_arcs.shared_arcs(squares)
    places = F.transform("points", lambda p: F.concat_ws(" ", p["lng"].cast("long").cast("string"), p["lat"].cast("long").cast("string")))
    return arcs.select("arc", F.array_join(places, ",").alias("line"), "users")


_D = "2 * atan2(sqrt(h), sqrt(greatest(0.0, 1 - h)))"


@query(f"""WITH p AS (SELECT c_custkey AS id, (c_custkey * 7919) % 17011 / 100.0::DOUBLE - 85 AS lat, (c_custkey * 104729) % 35999 / 100.0::DOUBLE - 180 AS lng FROM customer),
j AS (SELECT o.id AS origin, p.id, atan2(sin(radians(p.lng - o.lng)) * cos(radians(p.lat)), cos(radians(o.lat)) * sin(radians(p.lat)) - sin(radians(o.lat)) * cos(radians(p.lat)) * cos(radians(p.lng - o.lng))) - o.id % 4 * pi() / 2 AS off,
 sin(radians(p.lat - o.lat) / 2) ** 2 + cos(radians(o.lat)) * cos(radians(p.lat)) * sin(radians(p.lng - o.lng) / 2) ** 2 AS h FROM p, p o WHERE NOT (p.lat = o.lat AND p.lng = o.lng)),
k AS (SELECT *, {_D} AS d FROM j WHERE cos(off) > 1e-12)
SELECT origin, arg_min(id, d) AS id, floor(min(d) * 1e6 + 0.5) / 1e6 AS distance FROM k GROUP BY 1""")
def nearest_to_each(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer asks for the closest of all customers north, east, south or west, by its key."""
    k = F.col("c_custkey")
    places = _t(spark, sf_dir, "customer").select(k.alias("id"), k.alias("ord"), ((k * 7919) % 17011 / 100.0 - 85).alias("lat"), ((k * 104729) % 35999 / 100.0 - 180).alias("lng"))
    found = nearest.nearest_places(places.withColumn("target", F.col("id") % 4 * (math.pi / 2)), places)
    return found.select("origin", "id", _floor(F.col("distance"), 6).alias("distance"))


#: Runs of a key in order of time: each next one is the first ``width`` or more later.
_CHAIN = """WITH RECURSIVE e AS (SELECT {key} AS k, event_id, floor(epoch_us(ts) / {unit})::BIGINT AS t FROM events),
o AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY t, event_id) AS i FROM e),
n AS (SELECT *, min(i) OVER (PARTITION BY k ORDER BY t RANGE BETWEEN {width} FOLLOWING AND UNBOUNDED FOLLOWING) AS after FROM o),
c AS (SELECT k, event_id, t, i, after, NULL::BIGINT AS opened, NULL::BIGINT AS n FROM n WHERE i = 1
 UNION ALL SELECT n.k, n.event_id, n.t, n.i, n.after, c.t, n.i - c.i FROM c JOIN n ON n.k = c.k AND n.i = c.after)"""


def _time(unit: int) -> Column:
    return F.floor(F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01', ts)") / unit).cast("double")


@query(_CHAIN.format(key="event_type", unit=3_600_000, width=500) + " SELECT k AS event_type, opened::DOUBLE AS opened, t::DOUBLE AS closed, n, floor(n * 1000.0::DOUBLE / (t - opened) + 0.5)::BIGINT AS rate FROM c WHERE opened IS NOT NULL")
def window_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates of five hot keys, in windows that close at the first event half an hour or more after they opened (an hour counts as a thousand ms)."""
    events = _t(spark, sf_dir, "events").select("event_type", _time(3_600_000).alias("t"))
    return telemetry.closing_windows(events, "event_type", "t")


@query(_CHAIN.format(key="user_id", unit=600_000_000, width=150) + " SELECT k AS user_id, event_id FROM c")
def throttled_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's first event, then none until a day and an hour have passed."""
    events = _t(spark, sf_dir, "events").select("user_id", "event_id", _time(600_000_000).alias("t"))
    return telemetry.throttled(events, "user_id", "t", order=["event_id"]).select("user_id", "event_id")


@query("""SELECT o_custkey, o_orderkey FROM (SELECT *, max(year(o_orderdate)) OVER (PARTITION BY o_custkey) AS newest FROM orders) WHERE year(o_orderdate) = newest""")
def newest_generation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that stay where a year's orders of a customer replace those of the years before."""
    orders = _t(spark, sf_dir, "orders").withColumn("generation", F.year("o_orderdate").cast("long"))
    return generations.current(orders, "o_custkey").select("o_custkey", "o_orderkey")


def _box(x: Column, y: Column, w: Column, h: Column) -> Column:
    return F.array(*(F.struct((x + a).cast("double").alias("lng"), (y + b).cast("double").alias("lat")) for a, b in ((F.lit(0), F.lit(0)), (w, F.lit(0)), (w, h), (F.lit(0), h), (F.lit(0), F.lit(0)))))


@query("""SELECT c_custkey AS id, (4 + c_custkey % 37) * (3 + c_custkey % 23) - 2.0::DOUBLE AS area, true AS flat FROM customer""")
def triangle_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A box with a hole for each customer, some over the date line, cut into triangles: their area in square degrees, and that none sags too far."""
    k = F.col("c_custkey")
    x, y, w, h = k % 360 - 180, k % 50 - 40, 4 + k % 37, 3 + k % 23
    boxes = _t(spark, sf_dir, "customer").select(k.alias("id"), F.array(F.array(_box(x, y, w, h), _box(x + 1, y + 1, F.lit(2), F.lit(1)))).alias("polygons"))
    found = triangles.triangulated(boxes)
    twice = (F.col("b.lng") - F.col("a.lng")) * (F.col("c.lat") - F.col("a.lat")) - (F.col("c.lng") - F.col("a.lng")) * (F.col("b.lat") - F.col("a.lat"))

    def middle(*corners: str) -> Column:
        vectors = [geo.to_vector(F.col(f"{p}.lat"), F.col(f"{p}.lng")) for p in corners]
        return F.sqrt(sum((F.pow(sum((v[d] for v in vectors), F.lit(0.0)) / len(vectors), F.lit(2.0)) for d in "xyz"), F.lit(0.0)))

    least = F.least(middle("a", "b"), middle("b", "c"), middle("c", "a"), middle("a", "b", "c"))
    return found.groupBy("id").agg(_floor(F.sum(twice) / 2, 6).alias("area"), (F.min(least) >= 1 - triangles.MOST_SAG - 1e-9).alias("flat"))
