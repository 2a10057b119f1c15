"""Queries of chained lookups, claim neighbours, types, points, centroids, borders, commands and hot groups, each with DuckDB SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo, text
from ..operators import lookups, ranking, relations, rings
from ..streaming import telemetry
from .driver_queries import _entities, _floor, _t, query


@query("""WITH n AS (SELECT n_nationkey, n_regionkey FROM nation WHERE n_nationkey % 6 <> 0), r AS (SELECT r_regionkey, r_name FROM region WHERE r_regionkey <> 2)
SELECT c_custkey, n_regionkey, r_name, CASE WHEN n_regionkey IS NULL THEN 1 WHEN r_name IS NULL THEN 2 END AS missed
FROM (SELECT c_custkey, CASE WHEN c_custkey % 9 <> 0 THEN c_nationkey END AS code FROM customer) LEFT JOIN n ON n_nationkey = code LEFT JOIN r ON r_regionkey = n_regionkey""")
def chained_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From a customer's nation to the region's code to its name, with gaps on each hop; each nation is listed twice."""
    c = _t(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_custkey") % 9 != 0, F.col("c_nationkey")).alias("code"))
    n = _t(spark, sf_dir, "nation").where("n_nationkey % 6 <> 0")
    r = _t(spark, sf_dir, "region").where("r_regionkey <> 2")
    return lookups.chained(c, "code", [(n.union(n), "n_nationkey", "n_regionkey"), (r, "r_regionkey", "r_name")]).drop("code")


@query("""WITH n AS (SELECT c_custkey AS k, c_custkey // 2 AS other, 'claimant' AS role FROM customer WHERE c_custkey % 5 <> 0 UNION ALL SELECT c_custkey, c_custkey + 1, 'claims' FROM customer WHERE c_custkey % 4 = 0)
SELECT k::VARCHAR AS id, other::VARCHAR AS other, list_sort(list(DISTINCT role)) AS roles FROM n GROUP BY 1, 2""")
def claim_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every entity those that claim it and those it claims."""
    return relations.claim_neighbours(relations.edges(_entities(spark, sf_dir)))


@query("""SELECT coalesce(CASE WHEN c_custkey % 5 <> 0 THEN c_custkey || ' ' || c_name END, '') AS name, c_custkey % 11 AS rank FROM customer WHERE c_custkey % 3 = 0""")
def pruned_divisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities of one type, cut down to name and rank; every fifth lacks its name."""
    k = F.col("id").cast("long")
    some = lookups.of_type(_entities(spark, sf_dir), "administrative-division").select(F.when(k % 5 != 0, F.concat_ws(" ", "id", "name")).alias("name"), (k % 11).alias("rank"))
    return lookups.pruned(some, "name", "rank")


@query("""SELECT page_id FROM pages WHERE page_id % 3 = 1""")
def point_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features that are points, among points in several parts, polygons and features without a geometry."""
    kind = F.element_at(F.array(F.lit("MultiPoint"), F.lit("Point"), F.lit(None)), (F.col("page_id") % 3 + 1).cast("int"))
    return lookups.points_only(_t(spark, sf_dir, "pages").select("page_id", kind.alias("type"))).select("page_id")


def _ring(*points: tuple[Column, Column]) -> Column:
    return F.array(*(F.struct(x.cast("double").alias("lng"), y.cast("double").alias("lat")) for x, y in points))


@query("""WITH s AS (SELECT c_custkey AS k, c_custkey % 100 - 50 AS x, c_custkey % 60 - 30 AS y, 2 + c_custkey % 9 AS w, 2 + c_custkey % 7 AS h FROM customer)
SELECT k AS id, floor(CASE k % 4 WHEN 0 THEN 0 WHEN 1 THEN x + w / 2.0::DOUBLE WHEN 2 THEN x + (w * h * w / 2.0::DOUBLE - (w - 1) * (h - 1) * (w + 1) / 2.0::DOUBLE) / (w * h - (w - 1) * (h - 1)) ELSE x + w * 2 / 5.0::DOUBLE END * 1e6 + 0.5) / 1e6 AS lng,
 floor(CASE k % 4 WHEN 0 THEN 0 WHEN 1 THEN y + h / 2.0::DOUBLE WHEN 2 THEN y + (w * h * h / 2.0::DOUBLE - (w - 1) * (h - 1) * (h + 1) / 2.0::DOUBLE) / (w * h - (w - 1) * (h - 1)) ELSE y::DOUBLE END * 1e6 + 0.5) / 1e6 AS lat FROM s""")
def area_centres(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Centres by area of boxes, of boxes that lack a corner, of lines without area (mean of points) and of what has too few points."""
    k = F.col("c_custkey")
    x, y, w, h = k % 100 - 50, k % 60 - 30, 2 + k % 9, 2 + k % 7
    box = _ring((x, y), (x + w, y), (x + w, y + h), (x, y + h), (x, y))
    notched = _ring((x, y), (x + w, y), (x + w, y + 1), (x + 1, y + 1), (x + 1, y + h), (x, y + h), (x, y))
    flat = _ring((x, y), (x + w, y), (x + w, y), (x, y), (x, y))
    ring = F.when(k % 4 == 0, _ring((x, y), (x + w, y), (x, y))).when(k % 4 == 1, box).when(k % 4 == 2, notched).otherwise(flat)
    c = _t(spark, sf_dir, "customer").select(k.alias("id"), geo.area_centroid(F.array(F.array(ring))).alias("c"))
    return c.select("id", _floor(F.col("c.lng"), 6).alias("lng"), _floor(F.col("c.lat"), 6).alias("lat"))


@query("""WITH s AS (SELECT c_custkey % 40 AS x, c_custkey // 40 AS y FROM customer), e AS (SELECT unnest([[x, y, x + 1, y], [x + 1, y, x + 1, y + 1], [x, y + 1, x + 1, y + 1], [x, y, x, y + 1]]) AS p FROM s)
SELECT DISTINCT p[1]::DOUBLE AS ax, p[2]::DOUBLE AS ay, p[3]::DOUBLE AS bx, p[4]::DOUBLE AS by FROM e""")
def borders_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Squares in rows of forty, every second one wound the other way: each side that they share is one border."""
    k = F.col("c_custkey")
    x, y = k % 40, F.floor(k / 40)
    right = _ring((x, y), (x + 1, y), (x + 1, y + 1), (x, y + 1), (x, y))
    squares = _t(spark, sf_dir, "customer").select(k.alias("id"), F.array(F.when(k % 2 == 0, right).otherwise(F.reverse(right))).alias("rings"))
    sides = rings.distinct_edges(rings.segments(squares, "id", "rings"))
    return sides.select(F.col("a.lng").alias("ax"), F.col("a.lat").alias("ay"), F.col("b.lng").alias("bx"), F.col("b.lat").alias("by"))


@query("""SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq FROM events""")
def numbered_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's commands with their numbers, so that the same one given twice is two rows."""
    return telemetry.command_log(_t(spark, sf_dir, "events"), "user_id", ["ts", "event_id"]).select("user_id", "event_id", "event_type", F.col("seq").cast("long").alias("seq"))


@query("""SELECT event_type, event_id, min(event_id) OVER (PARTITION BY event_type) AS first_ord, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS position FROM events""")
def members_of_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The members of five hot groups in order, with their group's first."""
    return ranking.grouped_rows(_t(spark, sf_dir, "events").select("event_type", "event_id"), "event_type", "event_id").select("event_type", "event_id", "first_ord", F.col("position").cast("long").alias("position"))


#: Letters for plain ones, so that the names have accents to fold.
_PLAIN, _ACCENTED = "CATION", "ÇÀTÍÖÑ"


@query("""WITH n AS (SELECT * FROM (SELECT n_nationkey, translate(n_name, 'CATION', 'ÇÀTÍÖÑ') AS name FROM nation)), c AS (SELECT c_custkey, c_nationkey, translate(upper(c_name), 'CATION', 'ÇÀTÍÖÑ') AS name FROM customer)
SELECT c_custkey, lower(strip_accents(c.name)) AS folded, lower(strip_accents(n.name)) AS nation FROM c JOIN n ON c_nationkey = n_nationkey""")
def accented_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names with accents, composed and in parts, folded to the same plain ones."""
    k = F.col("c_custkey")
    name = F.translate(F.upper("c_name"), _PLAIN, _ACCENTED)
    parts = F.replace(F.replace(name, F.lit("\u00c7"), F.lit("C\u0327")), F.lit("\u00d6"), F.lit("O\u0308"))
    c = _t(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", F.concat(F.lit(" "), F.when(k % 2 == 0, name).otherwise(parts)).alias("name"))
    n = _t(spark, sf_dir, "nation").select("n_nationkey", text.fold_name(F.translate("n_name", _PLAIN, _ACCENTED)).alias("nation"))
    return c.select("c_custkey", "c_nationkey", text.fold_name("name").alias("folded")).join(n, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "folded", "nation")
