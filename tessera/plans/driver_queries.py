"""Queries of the library's operators over the driver tables, each with DuckDB SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo, text
from ..operators import placement, ranking, relations, resolve, rings, scoring
from ..streaming import telemetry

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _floor(x, digits: int):
    return F.floor(x * 10.0**digits + 0.5) / F.lit(10.0**digits)


def _nation_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """nation with balances, counts and means; nations with a key divisible by 4 lack suppliers' balance, by 6 also orders."""
    c, o, s = (_t(spark, sf_dir, n) for n in ("customer", "orders", "supplier"))
    per_customer = o.groupBy("o_custkey").agg(F.count("*").alias("n"), F.sum(F.floor(F.col("o_totalprice")).cast("long")).alias("total"))
    by_c = c.join(per_customer, c["c_custkey"] == per_customer["o_custkey"], "left").groupBy("c_nationkey").agg(F.count("*").alias("customers"), F.sum("n").alias("orders"), F.sum("total").alias("total"), F.sum(F.floor(F.col("c_acctbal")).cast("long")).alias("balance"))
    by_s = s.groupBy("s_nationkey").agg(F.sum(F.floor(F.col("s_acctbal")).cast("long")).alias("supply"))
    n = _t(spark, sf_dir, "nation")
    joined = n.join(by_c, n["n_nationkey"] == by_c["c_nationkey"], "left").join(by_s, n["n_nationkey"] == by_s["s_nationkey"], "left")
    return joined.select("n_nationkey", "n_name", "customers", F.when(F.col("n_nationkey") % 6 != 0, F.col("orders")).alias("orders"), "total", "balance", F.when(F.col("n_nationkey") % 4 != 0, F.col("supply")).alias("supply"))


_MEASURES = """m AS (SELECT n_nationkey, n_name, customers, CASE WHEN n_nationkey % 6 <> 0 THEN orders END AS orders, total, balance, CASE WHEN n_nationkey % 4 <> 0 THEN supply END AS supply
FROM nation LEFT JOIN (SELECT c_nationkey, count(*) AS customers, sum(n) AS orders, sum(total) AS total, sum(CAST(floor(c_acctbal) AS BIGINT)) AS balance
  FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, sum(CAST(floor(o_totalprice) AS BIGINT)) AS total FROM orders GROUP BY 1) ON o_custkey = c_custkey GROUP BY 1) ON c_nationkey = n_nationkey
LEFT JOIN (SELECT s_nationkey, sum(CAST(floor(s_acctbal) AS BIGINT)) AS supply FROM supplier GROUP BY 1) ON s_nationkey = n_nationkey)"""


def _pct(c: str) -> str:
    n = f"count({c}) OVER ()"
    return f"CASE WHEN {c} IS NULL THEN NULL WHEN {n} = 1 THEN 100.0 ELSE (rank() OVER (ORDER BY {c} NULLS LAST) - 1 + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0) / ({n} - 1) * 100 END::DOUBLE"


def _mean(parts: list[str]) -> str:
    return f"({' + '.join(f'coalesce({p}, 0)' for p in parts)}) / nullif({' + '.join(f'({p} IS NOT NULL)::INT' for p in parts)}, 0)"


@query(f"""WITH {_MEASURES}, p AS (SELECT *, {_pct('customers')} AS a, {_pct('orders')} AS b, {_pct('total')} AS c, 100 - {_pct('balance')} AS d, {_pct('supply')} AS e,
  (customers IS NOT NULL)::INT + (orders IS NOT NULL)::INT + (total IS NOT NULL)::INT + (balance IS NOT NULL)::INT + (supply IS NOT NULL)::INT AS n_present FROM m),
s AS (SELECT *, CASE WHEN n_present >= 3 THEN floor({_mean(['a', 'a', 'b', 'c', 'd', 'e'])} * 10 + 0.5) / 10 END AS score FROM p)
SELECT n_name, score, n_present, CASE WHEN n_present >= 4 THEN 'measured' WHEN n_present >= 3 THEN 'proxy' ELSE 'unavailable' END AS tier,
  row_number() OVER (ORDER BY coalesce(score, -1) DESC, n_name) AS position FROM s""")
def score_percentile_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentile components, one inverted and one of double weight, floor 3 of 5, tiers and the ranking."""
    parts = [scoring.Component(c, c, inverted=c == "balance", weight=2 if c == "customers" else 1) for c in ("customers", "orders", "total", "balance", "supply")]
    scored = scoring.composite_score(_nation_measures(spark, sf_dir), parts, floor=3, measured=4, proxy=3)
    return ranking.ranked(scored, "score", name="n_name").select("n_name", "score", "n_present", "tier", "position")


@query(f"""WITH {_MEASURES}, f AS (SELECT *, n_nationkey % 11 = 3 AS sure, coalesce(supply, 0) AS supply0 FROM m),
b AS (SELECT {', '.join(f"min({c}) FILTER (NOT sure) AS {c}_lo, max({c}) FILTER (NOT sure) AS {c}_hi, coalesce(min({c}) FILTER (NOT sure AND {c} > 0) * 0.01, 0.01) AS {c}_eps" for c in ('total', 'orders', 'supply0'))} FROM f),
n AS (SELECT f.*, {', '.join(f"CASE WHEN {c} IS NULL OR {c} + {c}_eps <= 0 THEN NULL WHEN ln({c}_hi + {c}_eps) = ln({c}_lo + {c}_eps) THEN 100.0 ELSE 100 * (ln({c} + {c}_eps) - ln({c}_lo + {c}_eps)) / (ln({c}_hi + {c}_eps) - ln({c}_lo + {c}_eps)) END AS {c}_norm" for c in ('total', 'orders', 'supply0'))},
 (total IS NOT NULL)::INT + (orders IS NOT NULL)::INT AS k FROM f, b)
SELECT n_name, CASE WHEN sure THEN 0.0 WHEN k >= 1 THEN floor({_mean(['total_norm', 'total_norm', 'orders_norm', 'supply0_norm'])} * 10 + 0.5) / 10 END AS score,
 CASE WHEN sure THEN 2 ELSE k END AS n_present, CASE WHEN sure OR k >= 2 THEN 'measured' WHEN k >= 1 THEN 'proxy' ELSE 'unavailable' END AS tier FROM n""")
def score_logminmax_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log-min-max components with one true-zero component and confirmed rows."""
    parts = [scoring.Component("total", "total", "log", weight=2), scoring.Component("orders", "orders", "log"), scoring.Component("supply", "supply", "log", zero_if_missing=True, covers=False)]
    return scoring.composite_score(_nation_measures(spark, sf_dir), parts, floor=1, measured=2, proxy=1, confirmed=F.col("n_nationkey") % 11 == 3).select("n_name", "score", "n_present", "tier")


@query("""SELECT tier, gaps, count(*) AS n FROM (SELECT CASE WHEN k >= 2 THEN 'measured' WHEN k >= 1 THEN 'proxy' ELSE 'unavailable' END AS tier, CASE k WHEN 0 THEN 'both' WHEN 1 THEN 'one' ELSE 'none' END AS gaps
FROM (SELECT (quality IS NOT NULL)::INT + (CASE WHEN toxic > 0 THEN toxic END IS NOT NULL)::INT AS k FROM documents LEFT JOIN labels USING (doc_id))) GROUP BY ALL""")
def coverage_tiers_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _t(spark, sf_dir, "documents").select("doc_id").join(_t(spark, sf_dir, "labels"), "doc_id", "left")
    toxic = F.when(F.col("toxic") > 0, F.col("toxic"))
    return d.select(scoring.tier(scoring.coverage(F.col("quality"), toxic), 2, 1).alias("tier"), resolve.gap_classes(F.col("quality"), toxic).alias("gaps")).groupBy("tier", "gaps").agg(F.count("*").alias("n"))


@query("""SELECT doc_id, source, quality, row_number() OVER (PARTITION BY source ORDER BY quality DESC NULLS LAST, lang, doc_id) AS position,
row_number() OVER (PARTITION BY source ORDER BY quality NULLS LAST, lang, doc_id) AS upwards, row_number() OVER (PARTITION BY source ORDER BY coalesce(quality, -1), lang, doc_id) AS by_score FROM documents LEFT JOIN labels USING (doc_id)""")
def ranked_list_null_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _t(spark, sf_dir, "documents").select("doc_id", "source", "lang").join(_t(spark, sf_dir, "labels"), "doc_id", "left")
    down = ranking.ranked(d, "quality", True, name="lang", within=["source"], tie=["doc_id"])
    up = ranking.ranked(down.withColumnRenamed("position", "down"), "quality", False, name="lang", within=["source"], tie=["doc_id"])
    scored = ranking.ranked(up.withColumnRenamed("position", "upwards"), "quality", False, score="quality", name="lang", within=["source"], tie=["doc_id"])
    return scored.select("doc_id", "source", "quality", F.col("down").alias("position"), "upwards", F.col("position").alias("by_score"))


@query("""SELECT o_custkey, year(o_orderdate) AS year, o_totalprice FROM orders WHERE year(o_orderdate) BETWEEN 1990 AND 1997 AND o_orderstatus <> 'P'
QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY year(o_orderdate) DESC, o_orderkey DESC) = 1""")
def latest_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _t(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.year("o_orderdate").cast("long").alias("year"), F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")).alias("o_totalprice"))
    return resolve.latest_value(o, ["o_custkey"], "year", "o_totalprice", 1990, 1997, tie="o_orderkey").select("o_custkey", "year", "o_totalprice")


@query("""SELECT user_id, floor(avg(value) * 1e6 + 0.5) / 1e6 AS mean, list_sort(list(event_id)) AS years FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events WHERE event_type <> 'view') WHERE r <= 5 GROUP BY 1""")
def recent5_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _t(spark, sf_dir, "events").withColumn("value", F.when(F.col("event_type") != "view", F.col("value")))
    return resolve.recent_mean(e, ["user_id"], "event_id", "value").select("user_id", _floor(F.col("mean"), 6).alias("mean"), "years")


@query("""WITH c AS (SELECT p_brand, p_partkey, unnest([{'y': 2001, 'v': p_size::DOUBLE}, {'y': 2002, 'v': NULL}, {'y': 2003, 'v': CASE WHEN p_partkey % 3 = 0 THEN p_retailprice END}]) AS x FROM part),
l AS (SELECT p_brand, x.y AS year, max_by(x.v, p_partkey) AS value FROM c WHERE x.v IS NOT NULL AND (x.y <> 2003 OR p_brand LIKE '%1') GROUP BY ALL) SELECT p_brand, max(year) AS year, max_by(value, year) AS value FROM l GROUP BY 1""")
def unpivot_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers, words, and numbers for some brands only."""
    last = F.when((F.col("p_partkey") % 3 == 0) & F.col("p_brand").endswith("1"), F.col("p_retailprice").cast("string")).otherwise("n/a")
    p = _t(spark, sf_dir, "part").select("p_brand", "p_partkey", F.col("p_size").cast("string").alias("y2001"), F.col("p_type").alias("y2002"), last.alias("y2003"))
    return resolve.unpivot_latest(p, ["p_brand"], {2001: "y2001", 2002: "y2002", 2003: "y2003"}, "p_partkey")


_ALIASES = [(f"source {i}", f"src{i}") for i in range(0, 40, 2)] + [("lost", "nowhere")]


def _lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _t(spark, sf_dir, "nation").where("n_nationkey < 15").select(F.concat(F.lit("src"), F.col("n_nationkey").cast("string")).alias("name"), F.lpad(F.col("n_nationkey").cast("string"), 3, "0").alias("id"))
    return resolve.name_lookup(n, spark.createDataFrame(_ALIASES, "alias string, canonical string"), text.fold_name)


@query("""SELECT lpad(n_nationkey::VARCHAR, 3, '0') AS id, count(*) AS n FROM documents LEFT JOIN (SELECT * FROM nation WHERE n_nationkey < 15) ON lower(trim(source)) = 'src' || n_nationkey GROUP BY ALL""")
def name_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _t(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("c"))
    return resolve.resolve_names(d, "source", _lookup(spark, sf_dir), text.fold_name).groupBy("id").agg(F.sum("c").alias("n"))


@query("""SELECT DISTINCT source FROM documents WHERE source IS NOT NULL AND lower(trim(source)) NOT IN (SELECT 'src' || n_nationkey FROM nation WHERE n_nationkey < 15)""")
def unmatched_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.unmatched_names(_t(spark, sf_dir, "documents"), "source", _lookup(spark, sf_dir), text.fold_name)


@query("""SELECT n_nationkey AS id, sum(l_quantity) AS amount FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey GROUP BY 1""")
def sum_by_resolved_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _t(spark, sf_dir, "supplier").select(F.lower("s_name").alias("key"), F.col("s_nationkey").alias("id"))
    sums = _t(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.sum("l_quantity").alias("amount")).join(_t(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    return resolve.sum_by_resolved(sums.select("s_name", "amount"), "s_name", "amount", s, F.lower)


def _entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as entities: a nation as parent, claimed by the customer of half the key, claiming the next one."""
    def relation(kind, ref, name):
        return F.struct(F.struct(F.lit(kind).alias("type"), ref.cast("string").alias("id")).alias("ref"), name.alias("displayName"), F.lit(None).cast("string").alias("extent"), F.lit("1999-05").alias("since"))

    k = F.col("c_custkey")
    half, after = F.floor(k / 2), k + 1
    return _t(spark, sf_dir, "customer").select(
        k.cast("string").alias("id"), F.col("c_name").alias("name"), F.when(k % 3 == 0, "administrative-division").otherwise("territory").alias("type"),
        relation("country", F.col("c_nationkey"), F.col("c_mktsegment")).alias("parent"),
        F.filter(F.array(relation("country", F.col("c_nationkey"), F.col("c_mktsegment"))), lambda r: k % 2 == 0).alias("administeredBy"),
        F.filter(F.array(relation("geo-entity", half, F.concat(F.lit("c"), half.cast("string"))), relation("country", F.col("c_nationkey"), F.col("c_mktsegment"))), lambda r: k % 5 != 0).alias("claimedBy"),
        F.filter(F.array(relation("geo-entity", after, F.concat(F.lit("c"), after.cast("string")))), lambda r: k % 4 == 0).alias("claims"),
    )


@query("""WITH e AS (SELECT c_custkey AS k, c_name AS name FROM customer), stated AS (SELECT k::VARCHAR AS id, 'c' || (k + 1) AS name, true AS explicit FROM e WHERE k % 4 = 0),
inferred AS (SELECT CAST(k // 2 AS VARCHAR) AS id, name, false AS explicit FROM e WHERE k % 5 <> 0) SELECT id, name, bool_or(explicit) AS explicit FROM (SELECT * FROM stated UNION ALL SELECT * FROM inferred) GROUP BY 1, 2""")
def claims_inverted(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _entities(spark, sf_dir)
    return relations.effective_claims(relations.edges(e), e)


@query("""WITH e AS (SELECT c_custkey AS k FROM customer), o AS (SELECT k AS id, k // 2 AS other FROM e WHERE k % 5 <> 0 UNION SELECT k, k + 1 FROM e WHERE k % 4 = 0),
b AS (SELECT id, other FROM o UNION SELECT other, id FROM o WHERE id <> other) SELECT id::VARCHAR AS id, other::VARCHAR AS other FROM b WHERE other IN (SELECT k FROM e)""")
def related_both_ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _entities(spark, sf_dir)
    return relations.related(relations.edges(e), e)


@query("""SELECT c_custkey::VARCHAR AS id, c_nationkey::VARCHAR AS country, CASE WHEN c_custkey % 5 <> 0 THEN ['claimant', 'parent'] ELSE ['parent'] END AS roles FROM customer WHERE c_custkey % 3 <> 0""")
def related_country_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _entities(spark, sf_dir)
    return relations.related_roles(relations.edges(e), e)


@query("""WITH e AS (SELECT c_custkey AS k, c_custkey::VARCHAR AS id, c_mktsegment AS m FROM customer)
SELECT id, 1 AS ord, 0 AS at, 'parent' AS label, m AS name, '1999' AS year FROM e UNION ALL SELECT id, 2, 0, 'administering', m, '1999' FROM e WHERE k % 2 = 0
UNION ALL SELECT id, 3, 0, 'claimants', 'c' || (k // 2), '1999' FROM e WHERE k % 5 <> 0 UNION ALL SELECT id, 3, 1, 'claimants', m, '1999' FROM e WHERE k % 5 <> 0 UNION ALL SELECT id, 4, 0, 'claim', 'c' || (k + 1), '1999' FROM e WHERE k % 4 = 0""")
def relation_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relations.feed(relations.edges(_entities(spark, sf_dir)))


@query("""SELECT vec_id, n_name FROM embeddings JOIN nation ON n_regionkey = label % 7""")
def membership_bridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = _t(spark, sf_dir, "embeddings").select("vec_id", F.array((F.col("label") % 7).cast("int")).alias("codes"))
    return relations.membership(groups, _t(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("code"), "n_name")).select("vec_id", "n_name")


def _place(k):
    return ((k * 37) % 1800 / 10.0 - 90).alias("lat"), ((k * 91) % 3600 / 10.0 - 180).alias("lng")


@query("""WITH c AS (SELECT c_custkey, c_mktsegment AS name, (c_custkey * 37) % 1800 / 10.0 - 90 AS lat, (c_custkey * 91) % 3600 / 10.0 - 180 AS lng FROM customer),
s AS (SELECT c_mktsegment AS name, (c_custkey * 37 + 11) % 1800 / 10.0 - 90 AS lat, (c_custkey * 91 + 5) % 3600 / 10.0 - 180 AS lng FROM customer)
SELECT c_custkey AS id FROM c WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.name = c.name AND (s.lat - c.lat) ** 2 + (s.lng - c.lng) ** 2 < 0.09)""")
def fuzzy_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _t(spark, sf_dir, "customer")
    left = c.select(F.col("c_custkey").alias("id"), F.concat("c_mktsegment", F.lit(", x")).alias("name"), *_place(F.col("c_custkey")))
    k = F.col("c_custkey")
    right = c.select(F.col("c_mktsegment").alias("name"), ((k * 37 + 11) % 1800 / 10.0 - 90).alias("lat"), ((k * 91 + 5) % 3600 / 10.0 - 180).alias("lng"))
    return resolve.same_name_nearby(left, right, text.base_name, 0.3).select("id")


_D = "2 * atan2(sqrt(h), sqrt(greatest(0.0, 1 - h)))"


@query(f"""WITH p AS (SELECT c_custkey AS id, (c_custkey * 37) % 1800 / 10.0 - 90 AS lat, (c_custkey * 91) % 3600 / 10.0 - 180 AS lng FROM customer),
o AS (SELECT n_nationkey AS origin, (n_nationkey * 53) % 120 - 60.0 AS olat, (n_nationkey * 29) % 300 - 150.0 AS olng FROM nation),
j AS (SELECT *, atan2(sin(radians(lng - olng)) * cos(radians(lat)), cos(radians(olat)) * sin(radians(lat)) - sin(radians(olat)) * cos(radians(lat)) * cos(radians(lng - olng))) - pi() / 2 AS off,
 sin(radians(lat - olat) / 2) ** 2 + cos(radians(olat)) * cos(radians(lat)) * sin(radians(lng - olng) / 2) ** 2 AS h FROM p, o WHERE NOT (lat = olat AND lng = olng)),
k AS (SELECT *, {_D} AS d FROM j WHERE abs(CASE WHEN off < -pi() THEN off + 2 * pi() ELSE off END) < pi() / 2)
SELECT origin, floor(min(d) * 1e6 + 0.5) / 1e6 AS distance FROM k GROUP BY 1""")
def nearest_in_direction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The closest customer east of each nation."""
    k = F.col("n_nationkey")
    origins = _t(spark, sf_dir, "nation").select((-1 - k).cast("long").alias("id"), ((k * 53) % 120 - 60.0).alias("lat"), ((k * 29) % 300 - 150.0).alias("lng"))
    places = _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_custkey").alias("ord"), *_place(F.col("c_custkey")))
    return ranking.nearest_in_direction(origins, places, "east").select((-1 - F.col("origin")).cast("int").alias("origin"), _floor(F.col("distance"), 6).alias("distance"))


@query("""SELECT source, ord, name, CASE WHEN lower(name) = 'src1' THEN 0 WHEN starts_with(lower(name), 'src1') THEN 1 ELSE 2 END AS tier FROM (SELECT 0 AS source, p_partkey AS ord, p_name AS name FROM part UNION ALL SELECT 1, doc_id, source FROM documents)
WHERE contains(lower(name), 'src1') ORDER BY tier, source, ord LIMIT 8""")
def tiered_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("ord"), F.col("p_name").alias("name"))
    d = _t(spark, sf_dir, "documents").select(F.col("doc_id").alias("ord"), F.col("source").alias("name"))
    return ranking.tiered_search([p, d], " SRC1 ")


def _replaced(column: str) -> str:
    """The named references of ``text.ENTITIES`` by nested replacements, the ampersand last (the pages have no numbers)."""
    for name, char in sorted(text.ENTITIES.items(), key=lambda x: x[0] == "amp"):
        column = f"replace({column}, '&{name};', chr({ord(char)}))"
    return column


@query(f"SELECT page_id, sha256({_replaced('html')}) AS decoded_sha256 FROM pages")
def html_entity_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "pages").select("page_id", F.sha2(text.decode_entities("html"), 256).alias("decoded_sha256"))


@query("""SELECT doc_id, CASE WHEN n > 0 THEN n END AS n FROM (SELECT doc_id, try_cast(replace(regexp_extract(text, '([0-9,]{4,})', 1), ',', '') AS DOUBLE) AS n FROM documents)""")
def first_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "documents").select("doc_id", text.first_number(F.col("text")).alias("n"))


@query("""SELECT p_partkey, regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g') || '-' || p_size AS slug,
 list_aggregate(list_transform(string_split(p_type, ' '), lambda w, i: CASE WHEN i > 1 AND lower(w) IN ('a','an','and','at','does','for','in','not','of','on','the','to') THEN lower(w) ELSE upper(lower(w)[1]) || substr(lower(w), 2) END), 'string_agg', ' ') AS title FROM part""")
def slug_and_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "part").select("p_partkey", text.slug(F.col("p_name"), F.col("p_size").cast("string")).alias("slug"), text.title_case(F.col("p_type")).alias("title"))


@query("""WITH w AS (SELECT p_partkey, p_type, list_filter(string_split_regex(p_type, '[\\s-]+'), lambda x: length(x) > 0) AS words FROM part), k AS (SELECT *, list_filter(words, lambda x: lower(x) NOT IN ('of','the','and')) AS kept FROM w)
SELECT p_partkey, CASE WHEN len(kept) >= 2 THEN upper(array_to_string(list_transform(kept[1:5], lambda x: x[1]), '')) ELSE upper(substr(coalesce(words[1], p_type), 1, 3)) END AS short FROM k""")
def abbreviations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "part").select("p_partkey", text.abbreviate(F.col("p_type")).alias("short"))


@query("""WITH v AS (SELECT o_orderkey, CASE WHEN o_orderkey % 50 = 0 THEN 0 WHEN o_orderkey % 7 = 0 THEN -floor(o_totalprice) * 1000 ELSE floor(o_totalprice) * 1000 END / 1e6 AS m FROM orders),
t AS (SELECT *, CASE WHEN m >= 1000 THEN 1000 WHEN m >= 1 THEN 1 ELSE 0.001 END AS unit, CASE WHEN m >= 1000 THEN 'Billion' WHEN m >= 1 THEN 'Million' ELSE 'Thousand' END AS name FROM v),
x AS (SELECT *, CAST(m AS DOUBLE) / CAST(unit AS DOUBLE) AS q FROM t), y AS (SELECT *, CASE WHEN q = 0 THEN 1 ELSE power(10.0, 2 - floor(log10(abs(CASE WHEN q = 0 THEN 1 ELSE q END)))) END AS s FROM x)
SELECT o_orderkey, CASE WHEN q = 0 THEN '0' ELSE regexp_replace(printf('%.8f', floor(abs(q) * s + 0.5) / s * sign(q)), '\\.?0+$', '') END || ' ' || name AS scaled FROM y""")
def format_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fiftieth order as zero, every seventh as a loss."""
    k, v = F.col("o_orderkey"), F.floor("o_totalprice").cast("double") * 1000
    return _t(spark, sf_dir, "orders").select("o_orderkey", text.format_scale(F.when(k % 50 == 0, 0.0).when(k % 7 == 0, -v).otherwise(v)).alias("scaled"))


@query("""SELECT event_id, list_filter([CASE WHEN true THEN 'world' END, CASE WHEN value <= 80 THEN 'country' END, CASE WHEN value <= 20 THEN 'city' END, CASE WHEN value <= 40 THEN 'state' END], lambda x: x IS NOT NULL) AS levels,
 CASE WHEN value <= 40 THEN 'state' WHEN value <= 20 THEN 'city' WHEN value <= 80 THEN 'country' ELSE 'world' END AS deepest,
 CASE WHEN value <= 40 THEN 1000.0 ELSE 'inf'::DOUBLE END AS least_score FROM events""")
def lod_active(spark: SparkSession, sf_dir: str) -> DataFrame:
    levels = [("world", None, True), ("country", 80.0, True), ("street", 90.0, False), ("city", 20.0, True), ("state", 40.0, True)]
    rows = placement.active_levels(_t(spark, sf_dir, "events"), levels, "value")
    deepest = placement.deepest_level(F.col("levels"))
    return rows.select("event_id", "levels", deepest.alias("deepest"), placement.least_score(deepest, {"city": 10, "state": 1000}).alias("least_score"))


_GREEDY = """WITH RECURSIVE pool AS ({pool}),
step AS (SELECT view, 0::BIGINT AS i, []::STRUCT(x DOUBLE, y DOUBLE, r DOUBLE, id BIGINT)[] AS kept FROM (SELECT DISTINCT view FROM pool)
 UNION ALL SELECT s.view, p.ord, CASE WHEN len(s.kept) < {most} AND len(list_filter(s.kept, lambda a: (a.x - p.px) ** 2 + (a.y - p.py) ** 2 < (a.r + p.r) ** 2)) = 0 THEN list_append(s.kept, {{'x': p.px, 'y': p.py, 'r': p.r, 'id': p.id}}) ELSE s.kept END
 FROM step s JOIN pool p ON p.view = s.view AND p.ord = s.i + 1),
last AS (SELECT view, arg_max(kept, i) AS kept FROM step GROUP BY view) SELECT view, unnest(kept).id AS id FROM last"""


_CUSTOMERS = """SELECT c_nationkey AS view, c_custkey AS id, (c_custkey * 7919 % 1000)::DOUBLE AS px, (c_custkey * 104729 % 800)::DOUBLE AS py, CASE WHEN c_custkey % 3 = 0 THEN 30.0 ELSE 20.0 END::DOUBLE AS r, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS ord FROM customer"""


@query("SELECT view, id AS ord, (id * 7919 % 1000)::DOUBLE AS px, (id * 104729 % 800)::DOUBLE AS py, CASE WHEN id % 3 = 0 THEN 30.0 END::DOUBLE AS spacing FROM (" + _GREEDY.format(most=120, pool=_CUSTOMERS) + ")")
def greedy_placement(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    rows = _t(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("view"), k.alias("ord"), (k * 7919 % 1000).cast("double").alias("px"), (k * 104729 % 800).cast("double").alias("py"), F.when(k % 3 == 0, 30.0).alias("spacing"))
    return placement.greedy_labels(rows, "view", "ord", 40.0, 120)


@query("""SELECT event_id, sum(CAST(floor(value * 100) AS BIGINT)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS running FROM events""")
def running_ring_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rings.running_sum(_t(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], F.floor(F.col("value") * 100).cast("long")).select("event_id", "running")


@query("""SELECT event_id FROM (SELECT event_id, event_type, lag(event_type) OVER w AS b, row_number() OVER w AS r FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE r = 1 OR event_type IS DISTINCT FROM b""")
def change_only_emission(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telemetry.changes_only(_t(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], F.col("event_type")).select("event_id")


@query("""SELECT epoch(time_bucket(INTERVAL 1 HOUR, ts))::BIGINT AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2""")
def tumbling_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telemetry.tumbling_rate(_t(spark, sf_dir, "events"), "ts", "1 hour", ("event_type",)).select(F.expr("timestampdiff(SECOND, timestamp_ntz'1970-01-01', start)").alias("start"), "event_type", "n")


@query("""SELECT user_id, max(event_id) AS event_id FROM events GROUP BY 1""")
def latest_per_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telemetry.latest(_t(spark, sf_dir, "events"), "user_id", ["event_id"], ["event_id"])


@query("""SELECT n_nationkey, floor(atan2(sin(radians(30 - lng)) * cos(radians(10)), cos(radians(lat)) * sin(radians(10)) - sin(radians(lat)) * cos(radians(10)) * cos(radians(30 - lng))) * 1e6 + 0.5) / 1e6 AS bearing, CAST(lat AS DOUBLE) AS lat, CAST(lng AS DOUBLE) AS lng FROM (SELECT n_nationkey, (n_nationkey * 53) % 120 - 60.0 AS lat, (n_nationkey * 29) % 300 - 150.0 AS lng FROM nation)""")
def sphere_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bearings, and places taken to the sphere and back."""
    k = F.col("n_nationkey")
    n = _t(spark, sf_dir, "nation").select("n_nationkey", ((k * 53) % 120 - 60.0).alias("lat"), ((k * 29) % 300 - 150.0).alias("lng"))
    back = geo.from_vector(geo.to_vector(F.col("lat"), F.col("lng"), 2.0))
    return n.select("n_nationkey", _floor(geo.bearing(F.col("lat"), F.col("lng"), F.lit(10.0), F.lit(30.0)), 6).alias("bearing"), _floor(back["lat"], 6).alias("lat"), _floor(back["lng"], 6).alias("lng"))


def _ring():
    """A square around each nation's key-derived place; some cross the date line."""
    lng, lat = F.col("n_nationkey") * 15 - 180.0, F.col("n_nationkey") * 3 - 36.0
    points = [(0, 0), (4, 0), (4, 2), (0, 2), (0, 0)]
    return F.array(F.array(F.array(*(F.struct(geo.wrap_longitude(lng - 2 + x).alias("lng"), (lat + y).alias("lat")) for x, y in points))))


@query("""SELECT n_nationkey, n_nationkey * 3 - 36 + 0.8::DOUBLE AS lat, CAST(CASE WHEN x > 180 THEN x - 360 WHEN x < -180 THEN x + 360 ELSE x END AS DOUBLE) AS lng, 4.0::DOUBLE AS extent FROM (SELECT n_nationkey, n_nationkey * 15 - 182 + 1.6 AS x FROM nation)""")
def ring_extents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Centres and extents of squares, some over the date line."""
    n = _t(spark, sf_dir, "nation").select("n_nationkey", _ring().alias("p"))
    n = n.select("n_nationkey", geo.centroid(F.col("p")).alias("c"), geo.angular_extent(F.col("p")).alias("e"))
    return n.select("n_nationkey", _floor(F.col("c.lat"), 6).alias("lat"), _floor(F.col("c.lng"), 6).alias("lng"), _floor(F.col("e"), 6).alias("extent"))


from . import chain_queries, lookup_queries, shown_queries  # noqa: E402, F401  register more queries
