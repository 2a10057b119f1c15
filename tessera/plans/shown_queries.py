"""Queries of text cells, lookups, relations, labels and buffers, each with DuckDB SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo, text
from ..operators import lookups, placement, ranking, relations, resolve, rings
from ..streaming import telemetry
from .driver_queries import _GREEDY, _entities, _floor, _t, query

_ROUND = "floor({} * 1e6 + 0.5) / 1e6"


@query("""WITH c AS (SELECT c_custkey, c_acctbal AS b, CASE WHEN c_custkey % 9 <> 0 THEN c_acctbal END AS n, least(100.0, greatest(0.0, c_acctbal / 100)) AS v, (c_custkey * 37) % 1800 / 10.0 - 90 AS lat, (c_custkey * 91) % 3600 / 10.0 - 180 AS lng FROM customer)
SELECT c_custkey, '$' || printf('%,d', CAST(floor(b + 0.5) AS BIGINT)) || ' km' AS grouped, coalesce(printf('%.2f%%', n), '—') AS cell,
 CASE WHEN n IS NOT NULL THEN 'rgb(' || CAST(floor(CASE WHEN v <= 50 THEN 239 + (245 - 239) * v / 50 ELSE 245 + (34 - 245) * (v - 50) / 50 END + 0.5) AS INT) || ', ' || CAST(floor(CASE WHEN v <= 50 THEN 68 + (158 - 68) * v / 50 ELSE 158 + (197 - 158) * (v - 50) / 50 END + 0.5) AS INT) || ', ' || CAST(floor(CASE WHEN v <= 50 THEN 68 + (11 - 68) * v / 50 ELSE 11 + (94 - 11) * (v - 50) / 50 END + 0.5) AS INT) || ')' END AS color,
 CASE WHEN n IS NULL THEN '—' ELSE printf('%.2f°', abs(lat::DOUBLE)) || CASE WHEN lat >= 0 THEN 'N' ELSE 'S' END || ' ' || printf('%.2f°', abs(lng::DOUBLE)) || CASE WHEN lng >= 0 THEN 'E' ELSE 'W' END END AS place FROM c""")
def number_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grouped integers, percent cells, colours and coordinates; every ninth value is missing."""
    k = F.col("c_custkey")
    n = F.when(k % 9 != 0, F.col("c_acctbal"))
    lat, lng = (k * 37) % 1800 / 10.0 - 90, (k * 91) % 3600 / 10.0 - 180
    return _t(spark, sf_dir, "customer").select("c_custkey", text.grouped_integer(F.col("c_acctbal"), "$", " km").alias("grouped"), text.percent_cell(n).alias("cell"), text.score_color(n / 100).alias("color"), text.coordinate_text(F.when(n.isNotNull(), lat), lng).alias("place"))


@query("""WITH c AS (SELECT c_custkey AS k, c_custkey % 90 AS d, c_custkey % 60 AS m, c_custkey % 7 = 0 AS sec, CASE WHEN c_custkey % 2 = 0 THEN 'S' ELSE 'N' END AS ns, CASE WHEN c_custkey % 3 = 0 THEN 'W' ELSE 'E' END AS ew FROM customer),
p AS (SELECT *, CASE WHEN k % 11 = 0 THEN 'nowhere' WHEN k % 13 <> 0 THEN 'x' END AS bad, floor((CASE WHEN ns = 'S' THEN -1 ELSE 1 END) * (d + m / 60 + (CASE WHEN sec THEN 36 ELSE 0 END) / 3600) * 100.0 + 0.5) / 100 AS lat, floor((CASE WHEN ew = 'W' THEN -1 ELSE 1 END) * (d + m / 60) * 100.0 + 0.5) / 100 AS lng FROM c)
SELECT k AS c_custkey, CASE WHEN k % 11 <> 0 THEN lat END AS lat, CASE WHEN k % 11 <> 0 THEN lng END AS lng,
 CASE k % 4 WHEN 0 THEN 'prior' WHEN 1 THEN 'prior' ELSE 'City ' || k END AS capital, CAST(CASE WHEN k % 4 < 2 OR k % 11 = 0 THEN 1.5 ELSE lat END AS DOUBLE) AS capital_lat,
 CASE WHEN k % 4 = 0 THEN NULL ELSE 'Republic of the Sea' END AS kind, CASE WHEN k % 5 = 0 AND k % 4 = 1 THEN 'Contested. Full entry: "republic OF the sea; old"' WHEN k % 5 = 0 AND k % 4 <> 0 THEN 'Contested.' END AS note FROM p""")
def places_and_capitals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Degrees from text with and without seconds, capitals with prior values, governments with a note."""
    k = F.col("c_custkey")

    def part(letter):
        return [(k % 90).cast("string"), (k % 60).cast("string"), *([F.when(k % 7 == 0, "36")] if letter == "ns" else []), F.when(k % 2 == 0, "S").otherwise("N") if letter == "ns" else F.when(k % 3 == 0, "W").otherwise("E")]

    place = F.when(k % 11 == 0, "nowhere").otherwise(F.concat(F.concat_ws(" ", *part("ns")), F.lit(", "), F.concat_ws(" ", *part("ew"))))
    name = F.when(k % 4 == 0, None).when(k % 4 == 1, "One; Two").otherwise(F.concat(F.lit("City "), k.cast("string")))
    prior = F.struct(F.lit("prior").alias("name"), F.lit(1.5).alias("lat"), F.lit(2.5).alias("lng"))
    rule = F.when(k % 4 == 0, None).when(k % 4 == 1, "republic OF the sea; old").otherwise("republic OF the sea")
    c = _t(spark, sf_dir, "customer").select("c_custkey", text.dms_degrees(place).alias("at"), text.capital(name, place, prior).alias("c"), text.government(rule, k % 5 == 0, "Contested.").alias("g"))
    return c.select("c_custkey", "at.lat", "at.lng", F.col("c.name").alias("capital"), F.col("c.lat").alias("capital_lat"), "g.kind", "g.note")


@query("""WITH p AS (SELECT page_id, url, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1) AS host, page_id % 3 AS a, page_id % 4 AS b FROM pages)
SELECT page_id, CASE WHEN b = 3 THEN 'Source unavailable' WHEN contains(url, 'example.net') THEN 'Net' WHEN contains(url, 'example') THEN 'Any' ELSE host END AS source, CASE WHEN a <> 0 AND a <> 1 THEN ' (' || (2000 + a) || ')' ELSE '' END AS suffix,
 CASE WHEN b = 0 THEN '2001' WHEN b = 1 THEN '2001–2004' ELSE '2001–2003' END AS years, CASE WHEN a = 0 THEN 'name' ELSE 'name (since ' || (1990 + a) || ')' END AS relation,
 CASE WHEN a = 0 AND b = 0 THEN '0/2; missing: gdp, pop' WHEN a = 0 THEN '1/2: pop; missing: gdp' WHEN b = 0 THEN '1/2: gdp; missing: pop' ELSE '2/2: gdp, pop' END AS coverage FROM p""")
def label_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources of addresses, year suffixes and ranges, relations and coverage."""
    a, b = F.col("page_id") % 3, F.col("page_id") % 4
    some_a, some_b = F.when(a != 0, a), F.when(b != 0, b)
    years = F.when(b == 0, F.array(F.lit(2001))).when(b == 1, F.array(F.lit(2001), F.lit(2004))).otherwise(F.array(F.lit(2001), F.lit(2002), F.lit(2003)))
    return _t(spark, sf_dir, "pages").select(
        "page_id", text.source_label(F.when(b != 3, F.col("url")), (("example.net", "Net"), ("example", "Any"))).alias("source"), text.year_suffix(2000 + some_a, F.lit(2001)).alias("suffix"), text.years_label(years).alias("years"),
        text.relation_label(F.lit("name"), (1990 + some_a).cast("string")).alias("relation"), text.coverage_sentence({"gdp": some_a, "pop": some_b}).alias("coverage"),
    )


@query(f"""WITH e AS (SELECT event_id, value / 50 - 0.5 AS t, CAST(floor(value * 10000) AS BIGINT) AS pop, event_id % 5 = 0 AS cap FROM events), f AS (SELECT *, least(1.0, greatest(0.0, t)) AS c, CASE WHEN cap THEN greatest(pop, 350000) ELSE pop END AS score FROM e)
SELECT event_id, {_ROUND.format('c')} AS clamped, {_ROUND.format('(1 - power(1 - c, 3))')} AS eased, {_ROUND.format('(CASE WHEN c < 0.5 THEN 4 * c * c * c ELSE 1 - power(2 - 2 * c, 3) / 2 END)')} AS both_eased, score,
 CASE WHEN score >= 700000 THEN 45 WHEN score >= 250000 THEN 35 WHEN score >= 100000 THEN 28 WHEN score >= 30000 THEN 20 ELSE 14 END AS spacing, {_ROUND.format('(length(event_id::VARCHAR) * least(11.0, greatest(6.0, pop / 10000 * 0.12)) * 0.6)')} AS width FROM f""")
def city_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Easing, scores with a floor for capitals, spacing by score, font sizes and text widths."""
    t, pop = F.col("value") / 50 - 0.5, F.floor(F.col("value") * 10000).cast("long")
    score = text.city_score(pop, F.col("event_id") % 5 == 0)
    width = text.text_width(F.col("event_id").cast("string"), placement.font_size(pop / 10000))
    return _t(spark, sf_dir, "events").select("event_id", _floor(text.clamp(t), 6).alias("clamped"), _floor(text.ease_out(t), 6).alias("eased"), _floor(text.ease_in_out(t), 6).alias("both_eased"), score.cast("long").alias("score"), text.spacing_radius(score).alias("spacing"), _floor(width, 6).alias("width"))


@query(f"""WITH e AS (SELECT event_id, value / 100 AS dot, 1 + value / 50 AS distance, value * 20 - 300 AS px, value * 10 - 200 AS py FROM events)
SELECT event_id, dot >= 1.0 / distance AS near_side, px BETWEEN -100 AND 1380 AND py BETWEEN -100 AND 820 AS on_screen, {_ROUND.format('(2 * sin(radians(dot * 20) / 2) * 720 / (2 * distance * tan(radians(45.0) / 2)))')} AS apparent FROM e""")
def visibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Horizon, screen bounds and apparent size."""
    v = F.col("value")
    dot, distance = v / 100, 1 + v / 50
    size = placement.apparent_size(dot * 20, distance, F.lit(720.0), F.lit(45.0), F.lit(1.0))
    return _t(spark, sf_dir, "events").select("event_id", placement.on_near_side(dot, F.lit(1.0), distance).alias("near_side"), placement.in_view(v * 20 - 300, v * 10 - 200, 1280, 720).alias("on_screen"), _floor(size, 6).alias("apparent"))


@query("""SELECT event_id, 'state' AS level, value <= 40 AS active FROM events UNION ALL SELECT event_id, 'street', false FROM events""")
def level_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Single levels; one that is not implemented is never active."""
    levels = [("world", None, True), ("street", 90.0, False), ("state", 40.0, True)]
    rows = placement.active_levels(_t(spark, sf_dir, "events"), levels, "value")
    parts = [rows.select("event_id", F.lit(x).alias("level"), placement.level_is_active(F.col("levels"), x).alias("active")) for x in ("state", "street")]
    return parts[0].union(parts[1])


def _views(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    return _t(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("view"), k.alias("id"), F.floor("c_acctbal").cast("double").alias("score"), (k * 7919 % 1000).cast("double").alias("px"), (k * 104729 % 800).cast("double").alias("py"), F.when(k % 3 == 0, 30.0).alias("spacing"))


@query(_GREEDY.format(most=12, pool="""SELECT * FROM (SELECT c_nationkey AS view, c_custkey AS id, (c_custkey * 7919 % 1000)::DOUBLE AS px, (c_custkey * 104729 % 800)::DOUBLE AS py, CASE WHEN c_custkey % 3 = 0 THEN 30.0 ELSE 20.0 END::DOUBLE AS r,
 row_number() OVER (PARTITION BY c_nationkey ORDER BY floor(c_acctbal) DESC, c_custkey) AS ord FROM customer WHERE floor(c_acctbal) >= 1000 AND c_custkey * 7919 % 1000 <= 900) WHERE ord <= 40"""))
def label_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score floor, visibility, the best forty of a view, then greedy placement of at most twelve."""
    return placement.shown_labels(_views(spark, sf_dir), "view", F.lit(1000.0), F.col("px") <= 900, "score", "id", 40.0, 40, 12).select("view", "id")


@query(_GREEDY.format(most=120, pool="""SELECT *, row_number() OVER (PARTITION BY view ORDER BY size DESC, id) AS ord FROM (SELECT c_nationkey AS view, c_custkey AS id, (c_custkey * 7919 % 1000)::DOUBLE AS px, (c_custkey * 104729 % 800)::DOUBLE AS py, (c_custkey % 200)::DOUBLE AS size,
 greatest(12.0, length(CASE WHEN length(c_name) * least(11.0, greatest(6.0, c_custkey % 200 * 0.12)) * 0.6 <= c_custkey % 200 * 1.15 THEN c_name ELSE 'C' END) * least(11.0, greatest(6.0, c_custkey % 200 * 0.12)) * 0.6 / 2)::DOUBLE AS r FROM customer) QUALIFY ord <= 60"""))
def passive_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that fit their size, else short ones; the largest first."""
    k = F.col("c_custkey")
    rows = _t(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("view"), k.alias("id"), F.col("c_name").alias("name"), F.lit("C").alias("short"), (k % 200).cast("double").alias("size"), (k * 7919 % 1000).cast("double").alias("px"), (k * 104729 % 800).cast("double").alias("py"))
    return placement.passive_placement(rows, "view", "id", 60).select("view", "id")


@query("""SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN 'renamed' ELSE c_name END AS name FROM customer WHERE c_custkey % 3 = 0""")
def allowed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An allow list with new names for some; the count is asserted."""
    c = _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    allow = c.where("id % 3 = 0").select("id", F.when(F.col("id") % 2 == 0, "renamed").alias("shown"))
    return resolve.allowed(c, allow, "id", "name", "shown", allow.count())


@query("""SELECT '#' || n_nationkey AS id, n_name AS name FROM nation WHERE n_nationkey < 20""")
def matched_by_id_or_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half are found by id, the others by name; the wanted id is put on the row."""
    n = _t(spark, sf_dir, "nation")
    k, own = F.col("n_nationkey"), F.concat(F.lit("#"), F.col("n_nationkey").cast("string"))
    rows = n.select(F.when(k % 2 == 0, own).otherwise("?").alias("id"), F.col("n_name").alias("name"))
    wanted = n.where(k < 20).select(own.alias("id"), F.when(k % 2 == 0, "other").otherwise(F.col("n_name")).alias("name"))
    return resolve.assert_count(resolve.match_id_or_name(rows, wanted), 20)


@query("""SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders GROUP BY 1""")
def first_of_each(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.assert_unique(resolve.first_wins(_t(spark, sf_dir, "orders"), ["o_custkey"], [F.col("o_orderkey").asc()]).select("o_custkey", "o_orderkey"), ["o_custkey"])


@query("""SELECT c_mktsegment AS reason, count(*) AS n FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders) GROUP BY 1""")
def dropped_with_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = _t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return resolve.dropped_reasons(_t(spark, sf_dir, "customer"), kept, "c_custkey", "c_mktsegment").withColumnRenamed("c_mktsegment", "reason")


@query("""SELECT c_custkey, coalesce(n, 0) AS n FROM customer LEFT JOIN (SELECT o_custkey AS c_custkey, count(*) AS n FROM orders GROUP BY 1) USING (c_custkey)""")
def counts_with_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by customer, zero where there are none; every order's customer must exist."""
    c, o = _t(spark, sf_dir, "customer").select("c_custkey"), _t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return resolve.with_default(c, resolve.assert_all_match(o, c, ["c_custkey"]).groupBy("c_custkey").agg(F.count("*").alias("n")), "c_custkey", "n", 0)


@query("""SELECT n_regionkey AS value, min(n_nationkey) AS key FROM nation GROUP BY 1""")
def one_to_one_inverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The inverse of a map whose values repeat, by its canonical rows."""
    n = _t(spark, sf_dir, "nation")
    first = n.groupBy("n_regionkey").agg(F.min("n_nationkey").alias("least"))
    pairs = n.join(first, "n_regionkey").select(F.col("n_nationkey").alias("key"), F.col("n_regionkey").alias("value"), (F.col("n_nationkey") == F.col("least")).alias("canonical"))
    return resolve.inverse_one_to_one(pairs, "key", "value", "canonical")


@query("""SELECT c_custkey::VARCHAR AS id, CASE WHEN c_custkey < 25 THEN 'country' WHEN c_custkey <= 100 THEN 'geo-entity' END AS kind, CASE WHEN c_custkey < 25 THEN n_name WHEN c_custkey <= 100 THEN c_name END AS name FROM customer LEFT JOIN nation ON n_nationkey = c_custkey""")
def resolved_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of countries, of other entities, of both (countries win) and of none."""
    c = _t(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("id"), F.col("c_name").alias("name"), "c_custkey")
    n = _t(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("id"), F.col("n_name").alias("name"))
    return relations.resolve_entity(c.select("id"), n, c.where("c_custkey <= 100"))


@query("""SELECT c_custkey::VARCHAR AS id, 'disputed' AS what FROM customer WHERE c_custkey % 5 <> 0 OR c_custkey % 4 = 0 OR c_custkey IN (SELECT c_custkey // 2 FROM customer WHERE c_custkey % 5 <> 0)
UNION ALL SELECT c_custkey::VARCHAR, 'child of 3' FROM customer WHERE c_nationkey = 3 UNION ALL SELECT c_custkey::VARCHAR, 'touching 7' FROM customer WHERE c_nationkey = 7 AND c_custkey % 5 <> 0""")
def claims_and_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Disputed entities, those of a parent, those whose claims touch a country."""
    e = _entities(spark, sf_dir)
    edge = relations.edges(e)
    parts = [relations.disputed(e, relations.effective_claims(edge, e)), relations.children(edge, "country", F.lit("3")), relations.touching(e, "country", "7")]
    parts = [p.select("id", F.lit(w).alias("what")) for p, w in zip(parts, ("disputed", "child of 3", "touching 7"), strict=True)]
    return parts[0].union(parts[1]).union(parts[2])


@query("""SELECT n_regionkey AS region, min(n_nationkey) AS first_ord, list(n_name ORDER BY n_nationkey) AS items FROM nation GROUP BY 1""")
def lists_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.grouped_lists(_t(spark, sf_dir, "nation").withColumnRenamed("n_regionkey", "region"), "region", "n_nationkey", "n_name")


@query("""WITH r AS (SELECT c_custkey AS id, c_nationkey AS g, c_custkey % 7 AS vertices, c_custkey % 4 AS faces FROM customer)
SELECT id, CAST(coalesce(sum(vertices) OVER g, 0) AS BIGINT) AS vertices_start, CAST(coalesce(sum(faces) OVER g, 0) AS BIGINT) AS faces_start, CAST(coalesce(sum(vertices) OVER a, 0) AS BIGINT) AS whole_start, [CAST(coalesce(sum(vertices) OVER g, 0) AS BIGINT), CAST(coalesce(sum(vertices) OVER g, 0) AS BIGINT) + 2] AS indices
FROM r WINDOW g AS (PARTITION BY g ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), a AS (ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def joined_buffers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offsets in a buffer per group and in one of all rows, and indices moved by them."""
    k = F.col("c_custkey")
    r = _t(spark, sf_dir, "customer").select(k.alias("id"), F.col("c_nationkey").alias("g"), (k % 7).alias("vertices"), (k % 4).alias("faces"), F.array(F.lit(0).cast("long"), F.lit(2).cast("long")).alias("indices"))
    whole = rings.buffer_offsets(r, None, "id", "vertices", "faces").select("id", F.col("vertices_start").alias("whole_start"))
    return rings.rebased(rings.buffer_offsets(r, "g", "id", "vertices", "faces")).join(whole, "id").select("id", "vertices_start", "faces_start", "whole_start", "indices")


@query("""WITH r AS (SELECT c_custkey AS id, c_nationkey AS g, c_custkey % 4 AS faces, coalesce(sum(c_custkey % 4) OVER (PARTITION BY c_nationkey ORDER BY c_custkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM customer) SELECT g, CAST(unnest(range(s::BIGINT, (s + faces)::BIGINT)) AS BIGINT) AS face, id FROM r""")
def rows_of_faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every face of the joined buffers with the row that it came from."""
    k = F.col("c_custkey")
    r = rings.buffer_offsets(_t(spark, sf_dir, "customer").select(k.alias("id"), F.col("c_nationkey").alias("g"), (k % 7).alias("vertices"), (k % 4).alias("faces")), "g", "id", "vertices", "faces")
    faces = r.groupBy("g").agg(F.sum("faces").alias("n")).where("n > 0").select("g", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("face"))
    return lookups.row_of_face(faces, r, "g")


def _squares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Squares with a hole around key-derived places, some over the date line."""
    lng, lat = F.col("n_nationkey") * 15 - 180.0, F.col("n_nationkey") * 3 - 36.0

    def ring(points):
        return F.array(*(F.struct(geo.wrap_longitude(lng - 2 + x).alias("lng"), (lat + y).alias("lat")) for x, y in points))

    return _t(spark, sf_dir, "nation").select("n_nationkey", F.array(ring([(0, 0), (4, 0), (4, 2), (0, 2), (0, 0)]), ring([(1, 0.5), (3, 0.5), (3, 1.5), (1, 0.5)])).alias("rings"))


@query("""WITH n AS (SELECT n_nationkey, n_nationkey * 15 - 182.0::DOUBLE AS x, n_nationkey * 3 - 36.0::DOUBLE AS y FROM nation), p AS (SELECT *, CASE WHEN x < -180 THEN x + 360 ELSE x END AS s FROM n)
SELECT n_nationkey, [s, s + 4, s + 4, s, s] AS outer_ring, CASE WHEN s + 1 > 180 AND s + 1 - 360 - s < -180 THEN [s + 1, s + 3, s + 3, s + 1] ELSE [s + 1, s + 3, s + 3, s + 1] END AS hole, y + 0.8 AS lat FROM p""")
def unwrapped_rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rings and holes without jumps over the date line, and the plain mean of the first ring's latitudes."""
    p = _squares(spark, sf_dir).withColumn("u", geo.unwrap_polygon(F.col("rings")))
    return p.select("n_nationkey", F.transform(F.col("u")[0], lambda q: q["lng"]).alias("outer_ring"), F.transform(F.col("u")[1], lambda q: q["lng"]).alias("hole"), _floor(geo.first_ring_centroid(F.array(F.col("rings")))["lat"], 6).alias("lat"))


@query("""WITH s AS (SELECT n_nationkey AS id, i AS seg, [0.0, 4, 4, 0, 0][i + 1] AS x0, [0.0, 0, 2, 2, 0][i + 1] AS y0, [4.0, 2, 4, 2][i + 1] AS d, [0.0, 4, 6, 10][i + 1] AS before FROM nation, range(4) t(i)) SELECT id, CAST(seg AS INT) AS "at", CAST(before / 12 AS DOUBLE) AS from_share, CAST((before + d) / 12 AS DOUBLE) AS to_share FROM s""")
def border_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments of borders with their share of the ring's length; polygons among lines have none."""
    p = _squares(spark, sf_dir).select(F.col("n_nationkey").alias("id"), F.array(F.transform(geo.unwrap_ring(F.col("rings")[0]), lambda q: q)).alias("rings"), F.lit("MultiLineString").alias("type"))
    both = rings.line_rings(p.union(p.withColumn("type", F.lit("Polygon"))))
    return rings.running_share(both, "id", "rings", lambda a, b: F.abs(a["lng"] - b["lng"]) + F.abs(a["lat"] - b["lat"])).select("id", "at", "from_share", "to_share")


@query("""SELECT event_id FROM events WHERE event_id % 6 = 0""")
def every_sixth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telemetry.every_nth(_t(spark, sf_dir, "events"), F.col("event_id"), 6).select("event_id")


_HELD = "SELECT user_id AS session, ts, event_id, CASE WHEN event_id % 17 = 0 THEN 'blur' WHEN event_id % 2 = 0 THEN 'down' ELSE 'up' END AS kind, event_type AS key FROM events"


@query(f"""WITH e AS ({_HELD}), l AS (SELECT session, key, max_by(kind, (ts, event_id)) AS kind, max((ts, event_id)) AS last_at FROM e WHERE kind <> 'blur' GROUP BY 1, 2), b AS (SELECT session, max((ts, event_id)) AS b FROM e WHERE kind = 'blur' GROUP BY 1)
SELECT session, key FROM l LEFT JOIN b USING (session) WHERE kind = 'down' AND (b IS NULL OR last_at > b)""")
def held_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    e = _t(spark, sf_dir, "events").select(F.col("user_id").alias("session"), "ts", "event_id", F.when(k % 17 == 0, "blur").when(k % 2 == 0, "down").otherwise("up").alias("kind"), F.col("event_type").alias("key"))
    return telemetry.held_keys(e, "session", ["ts", "event_id"])


@query("""WITH e AS (SELECT user_id AS pointer, event_id AS t, CASE WHEN event_id % 3 = 0 THEN 'down' ELSE 'up' END AS kind, value AS x FROM events),
w AS (SELECT *, last_value(CASE WHEN kind = 'down' THEN x END IGNORE NULLS) OVER (PARTITION BY pointer ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS d FROM e) SELECT pointer, t, abs(x - d) < 20 AS click FROM w WHERE kind = 'up' AND d IS NOT NULL""")
def clicks_and_drags(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _t(spark, sf_dir, "events").select(F.col("user_id").alias("pointer"), F.col("event_id").alias("t"), F.when(F.col("event_id") % 3 == 0, "down").otherwise("up").alias("kind"), F.col("value").alias("x"), F.lit(0.0).alias("y"))
    return telemetry.click_or_drag(e, "pointer", 20.0)


@query("""SELECT c_custkey::VARCHAR AS id, coalesce(n_nationkey::VARCHAR, c_custkey::VARCHAR) AS entity_id, n_name AS entity_name FROM customer LEFT JOIN nation ON n_nationkey = c_custkey % 40 AND c_custkey % 40 < 25""")
def geometry_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Geometries mapped to entities; those without a mapping stand for themselves."""
    k = F.col("c_custkey")
    c = _t(spark, sf_dir, "customer")
    mapping = c.where(k % 40 < 25).select(k.cast("string").alias("geometry_id"), (k % 40).cast("string").alias("entity_id"))
    n = _t(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("id"), F.col("n_name").alias("name"))
    return lookups.entity_of_geometry(c.select(k.cast("string").alias("id")), mapping, n).select("id", "entity_id", "entity_name")


@query("""SELECT c_custkey AS id FROM customer WHERE c_custkey % 3 <> 0 AND c_custkey NOT IN (SELECT o_custkey FROM orders)""")
def entities_without_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    e = _t(spark, sf_dir, "customer").select(k.alias("id"), F.when(k % 3 != 0, F.struct(k.alias("lat"))).alias("location"))
    return lookups.location_only(e, _t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"))).select("id")


@query("""SELECT c_nationkey AS n_nationkey, count(*) AS n FROM customer WHERE c_nationkey < 12 GROUP BY 1""")
def children_by_parent(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("n_nationkey"))
    return lookups.by_parent(rows, _t(spark, sf_dir, "nation").where("n_nationkey < 12"), "n_nationkey")


@query("""SELECT tier, count(*) AS n, count(*) FILTER (doc_id % 7 = 0) AS n_confirmed FROM (SELECT doc_id, CASE WHEN quality = 1 THEN 'measured' WHEN quality = 0 THEN 'proxy' ELSE 'unavailable' END AS tier FROM documents LEFT JOIN labels USING (doc_id)) GROUP BY 1""")
def counts_by_tier(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = lookups.left_columns(_t(spark, sf_dir, "documents").select("doc_id"), _t(spark, sf_dir, "labels"), "doc_id", ["quality"])
    tier = F.when(F.col("quality") == 1, "measured").when(F.col("quality") == 0, "proxy").otherwise("unavailable")
    return lookups.tier_counts(d.withColumn("tier", tier), "tier", F.col("doc_id") % 7 == 0)


@query("""SELECT DISTINCT c_nationkey FROM customer WHERE c_acctbal > 9000""")
def visible_countries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookups.visible_keys(_t(spark, sf_dir, "customer"), F.col("c_acctbal") > 9000, "c_nationkey")


@query("""SELECT p_partkey AS id, p_brand AS category, CASE WHEN p_size > 10 THEN p_size END AS size, CASE WHEN p_type LIKE '%1' THEN 'territory' ELSE p_type END AS kind FROM part WHERE (p_size <= 20 OR p_retailprice > 1000) AND p_brand IN ('Brand#11', 'Brand#12', 'Brand#21') AND p_partkey NOT IN (SELECT ps FROM (SELECT p_partkey AS ps FROM part WHERE p_partkey % 5 = 0))""")
def scoped_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Either of two flags, categories (none stands for all), an exclusion list, positive values and a default category."""
    p = _t(spark, sf_dir, "part").withColumn("type", F.lit("x"))
    rows = lookups.in_categories(lookups.capital_or_world_city(p, F.col("p_size") <= 20, F.col("p_retailprice") > 1000), "p_brand", ["Brand#11", "Brand#12", "Brand#21"])
    rows = lookups.in_categories(lookups.in_scope(rows, ["x"], [p.where("p_partkey % 5 = 0").select("p_partkey")], "p_partkey"), "p_brand", [])
    return rows.select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("category"), (lookups.positive(F.col("p_size") - 10) + 10).alias("size"), lookups.category_of(F.when(~F.col("p_type").endswith("1"), F.col("p_type"))).alias("kind"))


@query("""SELECT n_nationkey, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey % 3 <> 0, n_nationkey) AS position FROM nation""")
def major_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookups.flagged_first(_t(spark, sf_dir, "nation"), F.col("n_nationkey") % 3 == 0, "n_nationkey", "n_regionkey").select("n_nationkey", "position")


@query("""SELECT p_partkey, p_size AS rank, p_size <= 1 AS major FROM (SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN 6 ELSE p_size END AS p_size, p_partkey % 10 AS named FROM part) WHERE named > 1 AND p_size <= 6""")
def named_lakes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Named rows with a default rank, of rank six or better."""
    k = F.col("p_partkey")
    p = _t(spark, sf_dir, "part").select("p_partkey", F.when(k % 10 == 0, None).when(k % 10 == 1, "").otherwise(F.col("p_name")).alias("name"), F.when(k % 4 != 0, F.col("p_size")).alias("rank"))
    return lookups.ranked_at_most(lookups.lakes(p, "name", "rank"), "rank", 6, ["p_partkey", "rank", "major"])


@query("""SELECT n_nationkey, n_nationkey % 2 = 0 AS ocean FROM nation WHERE n_nationkey % 2 = 0 UNION ALL SELECT n_nationkey + 100, n_nationkey % 2 = 0 FROM nation""")
def water_by_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Far away oceans only, near by seas too."""
    n = _t(spark, sf_dir, "nation").select("n_nationkey", F.when(F.col("n_nationkey") % 2 == 0, "ocean").otherwise("sea").alias("kind"))
    both = lookups.water_shown(n, 4.5).union(lookups.water_shown(n.withColumn("n_nationkey", F.col("n_nationkey") + 100), 4.4))
    return both.select("n_nationkey", (F.col("kind") == "ocean").alias("ocean"))


@query("""SELECT event_id, value > 50 AS entered FROM events WHERE (value > 50) <> (value < 80)""")
def front_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What came to the front and what left it between two looks."""
    e = _t(spark, sf_dir, "events")
    return lookups.changed_rows(e.where("value > 50"), e.where("value < 80"), "event_id")


@query("""SELECT p_partkey, CAST(CASE WHEN p_partkey % 3 = 0 THEN p_size WHEN p_partkey % 3 = 1 THEN 10000 + p_partkey END AS DOUBLE) AS value, CASE WHEN p_partkey % 3 = 0 THEN 2020 END AS year, CASE WHEN p_partkey % 4 = 0 THEN 'note ' || p_partkey END AS note FROM part""")
def fallbacks_and_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An indicator, else the first number of a text without a year, else nothing; notes beside the values."""
    k = F.col("p_partkey")
    p = _t(spark, sf_dir, "part")
    told = F.when(k % 3 == 1, F.format_string("about %d in all, or 99999", 10000 + k)).otherwise("none")
    rows = p.select("p_partkey", lookups.measured_or_told(F.when(k % 3 == 0, F.col("p_size")), F.lit(2020), told).alias("m")).select("p_partkey", "m.*")
    return lookups.annotated(rows, p.where(k % 4 == 0).select("p_partkey", F.concat(F.lit("note "), k.cast("string")).alias("note")), "p_partkey", "note")
