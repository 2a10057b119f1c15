"""Claims and other relations of entities, as edges.

Entities have ``id, name, type, parent struct, administeredBy, claimedBy, claims`` (arrays of
``struct<ref:struct<type,id>,displayName,extent,since>``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

ROLES = ("parent", "administering", "claimant", "claims")


def _marked(role: str):
    return lambda r, i: F.struct(F.lit(role).alias("role"), i.alias("at"), r.alias("r"))


def edges(entities: DataFrame) -> DataFrame:
    """(id, role, at, ref_type, ref_id, name, extent, since): one row per relation, role by role in the order listed."""
    both = F.concat(
        F.when(F.col("parent").isNotNull(), F.array(F.struct(F.lit("parent").alias("role"), F.lit(0).alias("at"), F.col("parent").alias("r")))).otherwise(F.expr("filter(array(struct('' as role, 0 as at, parent as r)), x -> false)")),
        *(F.transform(F.coalesce(F.col(c), F.expr(f"filter(array(get({c}, 0)), x -> false)")), _marked(role)) for c, role in (("administeredBy", "administering"), ("claimedBy", "claimant"), ("claims", "claims"))),
    )
    e = entities.select("id", F.explode(both).alias("e"))
    return e.select("id", "e.role", "e.at", F.col("e.r.ref.type").alias("ref_type"), F.col("e.r.ref.id").alias("ref_id"), F.col("e.r.displayName").alias("name"), F.col("e.r.extent").alias("extent"), F.col("e.r.since").alias("since"))


def inverted_claims(edge: DataFrame, names: DataFrame) -> DataFrame:
    """(ref_type, ref_id, name): what each claimant claims, from the claimed side; relations without a ref are left out."""
    return edge.where("role = 'claimant' and ref_id is not null").join(names.select("id", F.col("name").alias("claimed")), "id").select("ref_type", "ref_id", F.col("claimed").alias("name"))


def effective_claims(edge: DataFrame, names: DataFrame, own_type: str = "geo-entity") -> DataFrame:
    """(id, name, explicit): claims that are stated or inferred, one per name, stated first."""
    stated = edge.where("role = 'claims'").select("id", "name", F.lit(True).alias("explicit"))
    inferred = inverted_claims(edge, names).where(F.col("ref_type") == own_type).select(F.col("ref_id").alias("id"), "name", F.lit(False).alias("explicit"))
    return stated.union(inferred).groupBy("id", "name").agg(F.max("explicit").alias("explicit"))


def disputed(entities: DataFrame, claims: DataFrame) -> DataFrame:
    """Entities claimed by someone or with an effective claim."""
    flagged = entities.join(claims.select("id").distinct().withColumn("__claims", F.lit(True)), "id", "left")
    return flagged.where(F.col("__claims").isNotNull() | (F.size(F.coalesce("claimedBy", F.expr("filter(array(get(claimedBy, 0)), x -> false)"))) > 0)).drop("__claims")


def related(edge: DataFrame, entities: DataFrame, of_type: str = "geo-entity") -> DataFrame:
    """(id, other) in both directions among entities that exist; only outbound edges may lead to itself."""
    out = edge.where((F.col("ref_type") == of_type) & F.col("ref_id").isNotNull()).select("id", F.col("ref_id").alias("other"))
    back = out.where("id <> other").select(F.col("other").alias("id"), F.col("id").alias("other"))
    return out.union(back).distinct().join(entities.select(F.col("id").alias("other")), "other", "left_semi").select("id", "other")


def children(edge: DataFrame, parent_type: str, parent: Column) -> DataFrame:
    return edge.where((F.col("role") == "parent") & (F.col("ref_type") == parent_type) & (F.col("ref_id") == parent)).select("id")


def touching(entities: DataFrame, ref_type: str, ref_id: str) -> DataFrame:
    """Entities with a claim by or on the given one."""
    def hit(r: Column) -> Column:
        return (r["ref"]["type"] == ref_type) & (r["ref"]["id"] == ref_id)

    return entities.where(F.coalesce(F.exists("claimedBy", hit), F.lit(False)) | F.coalesce(F.exists("claims", hit), F.lit(False)))


def claim_neighbours(edge: DataFrame, of_type: str = "geo-entity") -> DataFrame:
    """(id, other, roles): the entities that claim each entity or that it claims itself, as stated on its own side; see ``related`` for both sides."""
    rows = edge.where((F.col("ref_type") == of_type) & F.col("ref_id").isNotNull() & F.col("role").isin("claimant", "claims"))
    return rows.groupBy("id", F.col("ref_id").alias("other")).agg(F.array_sort(F.collect_set("role")).alias("roles"))


def related_roles(edge: DataFrame, entities: DataFrame, skipped_type: str = "administrative-division") -> DataFrame:
    """(id, country, roles) of countries as parent or claimant."""
    rows = edge.where("ref_type = 'country' and role in ('parent', 'claimant')").join(entities.where(F.col("type") != skipped_type).select("id"), "id", "left_semi")
    return rows.groupBy("id", F.col("ref_id").alias("country")).agg(F.array_sort(F.collect_set("role")).alias("roles"))


def feed(edge: DataFrame) -> DataFrame:
    """Relation rows in reading order with a label (plural for several) and the year of ``since``."""
    n = F.count("*").over(Window.partitionBy("id", "role"))
    label = F.when(F.col("role") == "claimant", F.when(n > 1, "claimants").otherwise("claimant")).when(F.col("role") == "claims", F.when(n > 1, "claims").otherwise("claim")).otherwise(F.col("role"))
    order = F.array_position(F.array(*(F.lit(r) for r in ROLES)), F.col("role"))
    return edge.select("id", order.cast("int").alias("ord"), "at", label.alias("label"), "name", F.substring("since", 1, 4).alias("year"))


def membership(groups: DataFrame, members: DataFrame, codes: str = "codes", key: str = "code") -> DataFrame:
    """One row per group and existing member."""
    return groups.withColumn(key, F.explode(codes)).drop(codes).join(members, key)


def unmatched_members(groups: DataFrame, members: DataFrame, codes: str = "codes", key: str = "code") -> DataFrame:
    """The codes that ``membership`` leaves out."""
    return groups.withColumn(key, F.explode(codes)).drop(codes).join(members, key, "left_anti")


def resolve_entity(refs: DataFrame, countries: DataFrame, entities: DataFrame) -> DataFrame:
    """refs(id) with kind and name: countries come before other entities."""
    both = countries.select("id", F.lit("country").alias("kind"), "name", F.lit(0).alias("p")).union(entities.select("id", F.lit("geo-entity"), "name", F.lit(1)))
    return refs.join(both.groupBy("id").agg(F.min_by(F.struct("kind", "name"), "p").alias("e")), "id", "left").select(*refs.columns, "e.kind", "e.name")
