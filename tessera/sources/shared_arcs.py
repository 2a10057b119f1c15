"""Polygons to a topology of shared arcs, and its file.

A vertex where rings part (it has different neighbours in them) is a junction. Rings are cut at their junctions; a ring without any begins at its least
vertex. An arc that runs either way is one arc, so a border between neighbours is kept, simplified and written once. Rings come back the same but for the
vertex at which they begin. Vertices are compared exactly; a vertex that repeats its neighbour is left out.

Null polygons and empty rings have no arcs; features with equal rings share them; a ring is held in one row, nothing larger is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import bound
from ..operators.segments import numbered
from .documents import write_document
from .topology import simplified

_PLACE = ["feature", "polygon", "ring"]


def rings_of(features: DataFrame, id_col: str = "id", polygons: str = "polygons") -> DataFrame:
    """(feature, polygon, ring, points): the different vertices of each ring, in their order, without the closing one."""
    each = features.select(F.col(id_col).alias("feature"), F.posexplode(polygons).alias("polygon", "rings")).select("feature", "polygon", F.posexplode("rings").alias("ring", "points"))
    single = F.filter("points", lambda p, i: (i == 0) | ~p.eqNullSafe(F.get("points", i - 1)))
    opened = bound(single, lambda a: F.when((F.size(a) > 1) & (a[0] == F.element_at(a, -1)), F.slice(a, 1, F.size(a) - 1)).otherwise(a))
    return each.where("size(points) > 0").select(*_PLACE, opened.alias("points"))


def _at(points: Column, i: Column) -> Column:
    return F.get(points, F.pmod(i, F.size(points)))


def junctions(rings: DataFrame) -> DataFrame:
    """(point): vertices that have other neighbours in one place than in another. Minima and maxima are pre-aggregated, however often a vertex recurs."""
    near = F.transform("points", lambda p, i: F.struct(p.alias("point"), F.sort_array(F.array(_at(F.col("points"), i - 1), _at(F.col("points"), i + 1))).alias("pair")))
    pairs = rings.select(F.explode(near).alias("v")).select("v.point", "v.pair")
    return pairs.groupBy("point").agg(F.min("pair").alias("a"), F.max("pair").alias("b")).where("a <> b").select("point")


def cut(rings: DataFrame) -> DataFrame:
    """(feature, polygon, ring, at, points, forward): the ring's arcs in order, each in the direction that sorts first, and whether the ring runs that way."""
    vertices = rings.select(*_PLACE, F.posexplode("points").alias("i", "point"))
    cuts = vertices.join(junctions(rings), "point").groupBy(*_PLACE).agg(F.sort_array(F.collect_list("i")).alias("cuts"))  # at most a ring's vertices
    own = rings.join(cuts, _PLACE, "left")
    begin = F.array(F.array_position("points", F.array_min("points")).cast("int") - 1)
    own = own.withColumn("cuts", F.coalesce("cuts", begin)).withColumn("n", F.size("points"))
    start = F.col("cuts")[0]
    turned = F.concat(F.slice("points", start + 1, F.col("n") - start), F.slice("points", F.lit(1), start + 1))  # closed at its begin
    places = F.concat(F.transform("cuts", lambda i: i - start), F.array("n"))
    own = own.select(*_PLACE, turned.alias("turned"), places.alias("places"))
    lines = F.transform(F.sequence(F.lit(0), F.size("places") - 2), lambda i: F.slice("turned", F.get("places", i) + 1, F.get("places", i + 1) - F.get("places", i) + 1))
    arcs = own.select(*_PLACE, F.posexplode(lines).alias("at", "line"))
    back = F.reverse("line")
    return arcs.select(*_PLACE, "at", F.least("line", back).alias("points"), (F.col("line") <= back).alias("forward"))


def shared_arcs(features: DataFrame, id_col: str = "id", polygons: str = "polygons") -> tuple[DataFrame, DataFrame]:
    """arcs(arc, points, users), numbered from 0 in the order of their points, and refs(feature, polygon, ring, at, n): n is the arc, or -1 - arc where the ring runs against it."""
    pieces = cut(rings_of(features, id_col, polygons))
    arcs = numbered(pieces.groupBy("points").agg(F.count("*").alias("users")), ["points"], "arc")
    refs = pieces.join(arcs.select("points", "arc"), "points").select(*_PLACE, "at", F.when(F.col("forward"), F.col("arc")).otherwise(-1 - F.col("arc")).alias("n"))
    return arcs.select("arc", "points", "users"), refs


def _nested(df: DataFrame, keys: list[str], by: str, item: str, out: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct(by, item))), lambda x: x[item]).alias(out))


def geometries(features: DataFrame, refs: DataFrame, id_col: str = "id", properties: list[str] | None = None) -> DataFrame:
    """(id, json): each feature's geometry of a topology object; a feature without rings has the type null."""
    rings = _nested(refs, _PLACE, "at", "n", "ns")
    polygons = _nested(_nested(rings, ["feature", "polygon"], "ring", "ns", "rings"), ["feature"], "polygon", "rings", "arcs")
    joined = features.select(F.col(id_col).alias("id"), F.struct(*(properties or [])).alias("properties") if properties else F.lit(None).alias("properties")).join(polygons.withColumnRenamed("feature", "id"), "id", "left")
    kind = F.when(F.col("arcs").isNull(), F.lit("null")).otherwise(F.lit('"MultiPolygon"'))
    parts = [F.concat(F.lit('{"type":'), kind), F.concat(F.lit('"id":'), F.to_json(F.array(F.col("id").cast("string"))).substr(F.lit(2), F.length(F.to_json(F.array(F.col("id").cast("string")))) - 2)), F.concat(F.lit('"arcs":'), F.to_json("arcs"))]
    if properties:
        parts.append(F.concat(F.lit('"properties":'), F.to_json("properties", {"ignoreNullFields": "false"})))
    return joined.select("id", F.concat(F.concat_ws(",", *parts), F.lit("}")).alias("json"))


def quantized(arcs: DataFrame, steps: float = 1e5) -> tuple[DataFrame, dict[str, list[float]]]:
    """(arc, moves): places as differences in whole steps of the bounding box, and the scale and translation that undo it. Points that fall together are one; two always stay."""
    b = arcs.select(F.explode("points").alias("p")).agg(F.min("p.lng"), F.max("p.lng"), F.min("p.lat"), F.max("p.lat")).first()
    x0, x1, y0, y1 = (0.0 if v is None else v for v in b)
    scale = [(x1 - x0) / (steps - 1) or 1.0, (y1 - y0) / (steps - 1) or 1.0]
    whole = F.transform("points", lambda p: F.struct(F.floor((p["lng"] - x0) / scale[0] + 0.5).alias("x"), F.floor((p["lat"] - y0) / scale[1] + 0.5).alias("y")))

    def moves(q: Column) -> Column:
        step = F.transform(q, lambda p, i: F.array(p["x"] - F.when(i > 0, F.get(q, i - 1)["x"]).otherwise(0), p["y"] - F.when(i > 0, F.get(q, i - 1)["y"]).otherwise(0)))
        moved = F.filter(step, lambda m, i: (i == 0) | (m[0] != 0) | (m[1] != 0))
        zero = F.array(F.lit(0).cast("long"), F.lit(0).cast("long"))
        return F.when(F.size(moved) == 1, F.concat(moved, F.array(zero))).otherwise(moved)

    return arcs.select("arc", bound(whole, moves).alias("moves")), {"scale": scale, "translate": [x0, y0]}


def write_topology(features: DataFrame, path: str, name: str, id_col: str = "id", polygons: str = "polygons", properties: list[str] | None = None, quantile: float | None = 0.35, steps: float = 1e5) -> None:
    """One topology file: the features' shared arcs, simplified and in whole steps, and their geometries. Read it with ``topology.read_features``."""
    arcs, refs = shared_arcs(features, id_col, polygons)
    kept = arcs.select("arc", "points") if quantile is None else simplified(arcs, quantile, steps)
    moves, transform = quantized(kept, steps)
    lines = moves.select(F.lit(0).alias("section"), F.col("arc").alias("ordinal"), F.to_json("moves").alias("line"))
    shapes = numbered(geometries(features, refs, id_col, properties), ["id", "json"], "ordinal").select(F.lit(1).alias("section"), "ordinal", F.col("json").alias("line"))
    head = '{"type":"Topology","transform":{"scale":[%r,%r],"translate":[%r,%r]},"arcs":[' % (*transform["scale"], *transform["translate"])
    write_document(lines.unionByName(shapes), path, [head, '],"objects":{"%s":{"type":"GeometryCollection","geometries":[' % name], "]}}}")
