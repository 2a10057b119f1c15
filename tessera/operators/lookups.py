"""Short lookups, filters and counts that a map view asks for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import first_number
from .segments import last_before


def left_columns(left: DataFrame, right: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Further columns by key; missing keys leave them null, a repeated key in ``right`` is an error of the caller."""
    return left.join(right.select(key, *columns), key, "left")


def chained(rows: DataFrame, key: str, hops: list[tuple[DataFrame, str, str]]) -> DataFrame:
    """Goes from code to code: each hop (table, its key, its value) looks up what the hop before found, the first one ``key``.

    Adds each hop's value, null from the first hop on that finds none, and ``missed``, that hop's number from 1 (null if the chain is whole).
    A key that a table repeats stands for its least value, so no row is multiplied; null codes find nothing.
    """
    missed = F.lit(None).cast("int")
    for i, (table, ours, value) in enumerate(hops, 1):
        once = table.groupBy(F.col(ours).alias("__code")).agg(F.min(value).alias("__value"))
        rows = rows.join(once, F.col(key) == F.col("__code"), "left").withColumnRenamed("__value", value).drop("__code")
        missed, key = F.coalesce(missed, F.when(F.col(value).isNull(), i)), value
    return rows.withColumn("missed", missed)


def entity_of_geometry(geometries: DataFrame, mapping: DataFrame, entities: DataFrame) -> DataFrame:
    """geometries(id) with the entity they stand for: by mapping(geometry_id, entity_id), else the entity of the same id."""
    mapped = geometries.join(mapping.withColumnRenamed("geometry_id", "id"), "id", "left").withColumn("entity_id", F.coalesce("entity_id", "id"))
    return mapped.join(entities.select(F.col("id").alias("entity_id"), F.col("name").alias("entity_name")), "entity_id", "left")


def location_only(entities: DataFrame, geometries: DataFrame) -> DataFrame:
    """Entities with a place but no geometry of their own."""
    return entities.where("location is not null").join(geometries.select("id"), "id", "left_anti")


def by_parent(rows: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """key and number of rows of each existing parent; rows without one are left out."""
    return rows.groupBy(key).agg(F.count("*").alias("n")).join(parents.select(key), key)


def tier_counts(rows: DataFrame, tier: str, confirmed: Column) -> DataFrame:
    """tier, n and how many of them are confirmed rather than scored."""
    return rows.groupBy(tier).agg(F.count("*").alias("n"), F.count_if(F.coalesce(confirmed, F.lit(False))).alias("n_confirmed"))


def visible_keys(rows: DataFrame, visible: Column, key: str) -> DataFrame:
    return rows.where(visible).select(key).distinct()


def ranked_at_most(rows: DataFrame, rank: str, most: int, keep: list[str]) -> DataFrame:
    """Rows of rank ``most`` or better, with the kept columns only."""
    return rows.where(F.col(rank) <= most).select(*keep)


def pruned(rows: DataFrame, name: str, rank: str) -> DataFrame:
    """name (null as empty) and rank only."""
    return rows.select(F.coalesce(F.col(name), F.lit("")).alias(name), rank)


def capital_or_world_city(rows: DataFrame, capital: Column, world: Column) -> DataFrame:
    return rows.where(F.coalesce(capital, F.lit(False)) | F.coalesce(world, F.lit(False)))


def positive(x: Column) -> Column:
    return F.when(x > 0, x)


def in_scope(rows: DataFrame, kinds: list[str], excluded: list[DataFrame], key: str = "id") -> DataFrame:
    """Rows of the kinds that are on none of the exclusion lists."""
    out = rows.where(F.col("type").isin(*kinds))
    for other in excluded:
        out = out.join(other.select(key), key, "left_anti")
    return out


def in_categories(rows: DataFrame, category: str, categories: list[str]) -> DataFrame:
    """No categories stand for all."""
    return rows.where(F.col(category).isin(*categories)) if categories else rows


def category_of(kind: Column, default: str = "territory") -> Column:
    return F.coalesce(kind, F.lit(default))


def of_type(entities: DataFrame, kind: str) -> DataFrame:
    return entities.where(F.col("type") == kind)


def by_type(entities: DataFrame, path: str, kind: str = "type") -> DataFrame:
    """The entities written in a folder per type and read back, so that ``of_type`` reads that type's files alone."""
    entities.write.mode("overwrite").partitionBy(kind).parquet(path)
    return entities.sparkSession.read.schema(entities.schema).parquet(path)


def flagged_first(rows: DataFrame, flag: Column, order: str, within: str) -> DataFrame:
    """Adds ``position`` within groups: flagged rows first, else in the order given."""
    return rows.withColumn("position", F.row_number().over(Window.partitionBy(within).orderBy(F.coalesce(flag, F.lit(False)).desc(), order)).cast("long"))


def water_shown(rows: DataFrame, distance: float, near: float = 4.5) -> DataFrame:
    """rows(kind): oceans always, seas only when nearer than ``near``."""
    return rows.where((F.col("kind") == "ocean") | F.lit(distance < near))


def lakes(rows: DataFrame, name: str, rank: str, default: int = 6, major: int = 1) -> DataFrame:
    """Named lakes with their rank (``default`` where missing) and whether they are major."""
    r = F.coalesce(F.col(rank), F.lit(default))
    return rows.where(F.col(name).isNotNull() & (F.col(name) != "")).withColumns({rank: r, "major": r <= major})


def points_only(features: DataFrame) -> DataFrame:
    return features.where(F.col("type") == "Point")


def changed_rows(now: DataFrame, before: DataFrame, key: str) -> DataFrame:
    """(key, entered): what came into view or left it since the last time; nothing where both are equal."""
    both = now.select(key, F.lit(1).alias("side")).union(before.select(key, F.lit(2)))
    return both.groupBy(key).agg(F.sum(F.col("side")).alias("s")).where("s <> 3").select(key, (F.col("s") == 1).alias("entered"))


def annotated(scores: DataFrame, notes: DataFrame, key: str, note: str) -> DataFrame:
    """Scores with a note that plays no part in them."""
    return left_columns(scores, notes, key, [note])


def measured_or_told(measured: Column, year: Column, text: Column) -> Column:
    """``struct<value,year>``: the indicator, else the first number in a text, whose year is not known."""
    return F.when(measured.isNotNull(), F.struct(measured.cast("double").alias("value"), year.cast("int").alias("year"))).otherwise(F.struct(first_number(text).alias("value"), F.lit(None).cast("int").alias("year")))


def row_of_face(faces: DataFrame, offsets: DataFrame, group: str) -> DataFrame:
    """faces(group, face) with the id of the row whose faces_start is the last at or before the face."""
    both = faces.select(group, "face", F.lit(1).alias("asked"), F.lit(None).cast(offsets.schema["id"].dataType).alias("at_id")).union(offsets.where("faces > 0").select(group, F.col("faces_start").cast("long"), F.lit(0), "id"))
    found = last_before(both, group, ["face", "asked"], F.col("at_id"), "id")
    return found.where("asked = 1").select(group, "face", "id")
