"""Readers with fixed schemas and the writers of shards, collections and reports."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

POINT = "array<double>"


def feature_collection(spark: SparkSession, path: str, properties: str, coordinates: str = "string") -> DataFrame:
    """(id, ordinal, type, coordinates, properties...) of a GeoJSON collection; a missing id is ``feature-<ordinal>``."""
    schema = f"features array<struct<id:string,geometry:struct<type:string,coordinates:{coordinates}>,properties:struct<{properties}>>>"
    rows = spark.read.schema(schema).option("multiLine", True).json(path).select(F.posexplode("features").alias("ordinal", "f"))
    return rows.select(F.coalesce("f.id", F.concat(F.lit("feature-"), F.col("ordinal").cast("string"))).alias("id"), "ordinal", F.col("f.geometry.type").alias("type"), F.col("f.geometry.coordinates").alias("coordinates"), "f.properties.*")


def plain_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Cut at every comma: quotes mean nothing; the first line is a header."""
    return spark.read.schema(schema).option("header", True).option("quote", "").csv(path)


def embedded_csv(df: DataFrame, column: str, names: list[str], skipped: tuple[str, ...] = ()) -> DataFrame:
    """Rows of CSV text inside base64; the first line is a header, rows whose first cell is among ``skipped`` go."""
    lines = F.split(F.decode(F.unbase64(column), "UTF-8"), r"\r?\n")
    cells = df.select(F.explode(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0)))).alias("line")).where("trim(line) <> ''").select(F.split("line", ",").alias("c"))
    return cells.select(*(F.try_element_at("c", F.lit(i + 1)).alias(n) for i, n in enumerate(names))).where(F.coalesce(~F.trim(names[0]).isin(*skipped), F.lit(True)) if skipped else F.lit(True))


def tree_codes(paths: DataFrame, pattern: str) -> DataFrame:
    """path -> (folder, code) by a pattern with two groups."""
    return paths.select("path", F.regexp_extract("path", pattern, 1).alias("folder"), F.regexp_extract("path", pattern, 2).alias("code")).where("code <> ''")


def write_shards(df: DataFrame, path: str, key: str) -> None:
    """One folder per lower-cased key; rows of a key are spread over tasks by the writer, not gathered in one."""
    df.withColumn(key, F.lower(key)).write.mode("overwrite").partitionBy(key).parquet(path)


def write_scores(df: DataFrame, path: str, key: str) -> None:
    """A line of JSON per row: its key and the other columns as a struct."""
    df.select(F.to_json(F.struct(F.col(key), F.struct(*(c for c in df.columns if c != key)).alias("value"))).alias("value")).write.mode("overwrite").text(path)


def write_features(df: DataFrame, path: str, properties: list[str]) -> None:
    """GeoJSON features of (id, lng, lat), one per line, so that no task holds the collection."""
    point = F.struct(F.lit("Point").alias("type"), F.array("lng", "lat").alias("coordinates"))
    df.select(F.to_json(F.struct(F.lit("Feature").alias("type"), "id", point.alias("geometry"), F.struct(*properties).alias("properties"))).alias("value")).write.mode("overwrite").text(path)


def gap_report(kept: DataFrame, skipped: DataFrame) -> DataFrame:
    """section, record: the skipped rows and the kept ones as JSON."""
    parts = [d.select(F.lit(n).alias("section"), F.to_json(F.struct("*")).alias("record")) for n, d in (("skipped", skipped), ("entities", kept))]
    return parts[0].union(parts[1])


def component_dump(df: DataFrame, key: str, components: list[str], tier: str = "tier") -> DataFrame:
    """A line of JSON per scored row: its key and components; unavailable rows are left out."""
    return df.where(F.col(tier) != "unavailable").select(key, F.to_json(F.struct(*components)).alias("components"))


def replace_marked(path: str, begin: str, end: str, text: str) -> None:
    """Puts text between two markers of a small document; without them, before its first heading."""
    file, block = Path(path), f"{begin}\n{text}\n{end}"
    old = file.read_text()
    if begin in old and end in old.split(begin, 1)[1]:
        head, rest = old.split(begin, 1)
        new = head + block + rest.split(end, 1)[1]
    else:
        at = 0 if old.startswith("## ") else old.find("\n## ") + 1
        new = old[:at] + block + "\n\n" + old[at:] if at or old.startswith("## ") else old + block + "\n"
    file.write_text(new)


def register_lines(df: DataFrame, title: str, columns: list[str]) -> DataFrame:
    """Lines of a Markdown table with a summary, by ``section`` and ``ord``."""
    head = df.agg(F.concat(F.lit(f"# {title}: "), F.count("*").cast("string"), F.lit(" rows")).alias("line")).select(F.lit(0).alias("section"), F.lit("").alias("ord"), "line")
    rows = df.select(F.lit(1), F.col(columns[0]).cast("string"), F.concat(F.lit("| "), F.concat_ws(" | ", *(F.coalesce(F.col(c).cast("string"), F.lit("—")) for c in columns)), F.lit(" |")))
    return head.union(rows)


def presets(df: DataFrame, column: str = "json", known: list[str] | None = None) -> DataFrame:
    """id -> on maps from JSON; corrupt text is an empty map; ids that are not known are left out."""
    parsed = F.coalesce(F.from_json(column, "map<string,boolean>", {"mode": "PERMISSIVE"}), F.expr("cast(map() as map<string,boolean>)"))
    return df.withColumn("preset", F.map_filter(parsed, lambda k, v: k.isin(*known)) if known is not None else parsed)
