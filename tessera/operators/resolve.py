"""Latest values, names and keys from several sources, and checks on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .steps import written


def latest_value(df: DataFrame, keys: list[str], year: str, value: str, low=None, high=None, tie: str | None = None) -> DataFrame:
    """keys, year, value of the last row with a value in [low, high]; ``tie`` decides within a year (greatest wins)."""
    rows = df.where(F.col(value).isNotNull())
    if low is not None:
        rows = rows.where(F.col(year).between(low, high))
    return rows.groupBy(*keys).agg(F.max(F.struct(year, *([tie] if tie else []), value)).alias("__last")).select(*keys, f"__last.{year}", f"__last.{value}")


def recent_mean(df: DataFrame, keys: list[str], year: str, value: str, n: int = 5, tie: str | None = None) -> DataFrame:
    """keys, mean and sorted years of the n most recent values; years may be skipped."""
    order = Window.partitionBy(*keys).orderBy(F.desc(year), *([F.desc(tie)] if tie else []))
    top = df.where(F.col(value).isNotNull()).withColumn("__r", F.row_number().over(order)).where(F.col("__r") <= n)
    return top.groupBy(*keys).agg(F.avg(value).alias("mean"), F.sort_array(F.collect_list(year)).alias("years"))


def unpivot_latest(df: DataFrame, keys: list[str], years: dict[int, str], order: str | None = None) -> DataFrame:
    """Wide yearly text columns -> last numeric year per key; of repeated keys the row last in ``order`` wins."""
    cells = F.array(*(F.struct(F.lit(y).alias("year"), F.col(c).try_cast("double").alias("value")) for y, c in years.items()))
    rank = [F.col(order).alias("__order")] if order else []
    long = df.select(*keys, *rank, F.explode(cells).alias("c")).where("c.value is not null").select(*keys, *(["__order"] if order else []), "c.*")
    rows = long.groupBy(*keys, "year").agg(F.max(F.struct("__order", "value"))["value"].alias("value")) if order else long
    return latest_value(rows, keys, "year", "value")


def first_wins(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("__r") == 1).drop("__r")


def name_lookup(canonical: DataFrame, aliases: DataFrame, fold) -> DataFrame:
    """(key, id) from canonical(id, name) and aliases(alias, canonical): aliases of unknown names are left out, others win."""
    names = canonical.select(fold(F.col("name")).alias("key"), "id", F.lit(0).alias("p"))
    known = aliases.join(canonical, aliases["canonical"] == canonical["name"]).select(fold(aliases["alias"]).alias("key"), canonical["id"], F.lit(1).alias("p"))
    return names.union(known).groupBy("key").agg(F.max(F.struct("p", "id"))["id"].alias("id"))


def resolve_names(rows: DataFrame, name: str, lookup: DataFrame, fold) -> DataFrame:
    """The rows with ``id`` (null where the name is unknown). Skew of frequent names is left to adaptive execution."""
    return rows.withColumn("__key", fold(F.col(name))).join(lookup.withColumnRenamed("key", "__key"), "__key", "left").drop("__key")


def unmatched_names(rows: DataFrame, name: str, lookup: DataFrame, fold) -> DataFrame:
    names = rows.select(F.col(name)).distinct()
    return names.where(F.col(name).isNotNull()).withColumn("__key", fold(F.col(name))).join(lookup, F.col("__key") == F.col("key"), "left_anti").drop("__key")


def sum_by_resolved(rows: DataFrame, name: str, amount: str, lookup: DataFrame, fold) -> DataFrame:
    """Sums by resolved id; amounts that are no numbers are skipped. Summed by name first, then looked up."""
    sums = rows.groupBy(name).agg(F.sum(F.col(amount).try_cast("double")).alias("amount"))
    return resolve_names(sums, name, lookup, fold).where("id is not null").groupBy("id").agg(F.sum("amount").alias("amount"))


def inverse_one_to_one(pairs: DataFrame, key: str, value: str, canonical: str) -> DataFrame:
    """value -> key by canonical rows only; raises if two canonical rows share a value."""
    return assert_unique(pairs.where(F.col(canonical)), [value]).select(value, key)


def allowed(rows: DataFrame, allow: DataFrame, key: str, name: str, override: str, expected: int | None = None) -> DataFrame:
    """Rows on the list, renamed where the list says so; raises if their number is not the expected one."""
    out = rows.join(allow.select(key, F.col(override).alias("__new")), key).withColumn(name, F.coalesce("__new", name)).drop("__new")
    return out if expected is None else assert_count(out, expected)


def match_id_or_name(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted(id, name) against rows(id, name): by id, else by name; the wanted id is put on the row found."""
    w = wanted.select(F.col("id").alias("w_id"), F.col("name").alias("w_name"))
    by_id = w.join(rows, F.col("w_id") == F.col("id"))
    rest = w.join(by_id.select("w_id"), "w_id", "left_anti").join(rows, F.col("w_name") == F.col("name"))
    return by_id.unionByName(rest).withColumn("id", F.col("w_id")).drop("w_id", "w_name")


def dropped_reasons(rows: DataFrame, kept: DataFrame, key: str, reason: str) -> DataFrame:
    """reason, n of rows that are not among the kept ones."""
    return rows.join(kept.select(key), key, "left_anti").groupBy(reason).agg(F.count("*").alias("n"))


def same_name_nearby(left: DataFrame, right: DataFrame, base, degrees: float = 0.5) -> DataFrame:
    """Rows of ``left`` without a row of ``right`` of the same base name under ``degrees`` away (flat distance).

    Places are filed in cells of ``degrees``; those of ``right`` also in the eight cells around, so rows that are near
    enough meet in the cell of the left one, and a frequent name is spread over its cells. Places of ``right`` that are
    alike count once. The nine rows of a place are joined by a shuffle: their size is estimated as that of one, which would broadcast them.
    """

    def cell(x: str) -> Column:
        return F.floor(F.col(x) / degrees)

    around = F.transform(F.sequence(F.lit(0), F.lit(8)), lambda i: F.struct((cell("lat") + F.floor(i / 3) - 1).alias("a"), (cell("lng") + i % 3 - 1).alias("b")))
    places = right.select(base(F.col("name")).alias("__n"), "lat", "lng").distinct()
    r = places.select("__n", F.col("lat").alias("__lat"), F.col("lng").alias("__lng"), F.explode(around).alias("__c")).hint("merge")
    near = F.pow(F.col("lat") - F.col("__lat"), F.lit(2.0)) + F.pow(F.col("lng") - F.col("__lng"), F.lit(2.0)) < degrees * degrees
    return left.join(r, (base(F.col("name")) == F.col("__n")) & (cell("lat") == F.col("__c.a")) & (cell("lng") == F.col("__c.b")) & near, "left_anti")


def with_default(left: DataFrame, right: DataFrame, key: str, column: str, default) -> DataFrame:
    return left.join(right.select(key, column), key, "left").withColumn(column, F.coalesce(column, F.lit(default)))


def gap_classes(a: Column, b: Column) -> Column:
    return F.when(a.isNull() & b.isNull(), "both").when(a.isNull() | b.isNull(), "one").otherwise("none")


def assert_count(df: DataFrame, expected: int) -> DataFrame:
    """The rows, written once and counted as written; raises if there are not as many as expected."""
    df = written(df)
    if (n := df.count()) != expected:
        raise ValueError(f"{n} rows, not {expected}")
    return df


def assert_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    """The rows, written once; raises if two of those written have the same keys (nulls are alike)."""
    df = written(df)
    if twice := df.groupBy(*keys).count().where("count > 1").limit(5).collect():
        raise ValueError(f"repeated keys, among them {[tuple(r)[:-1] for r in twice]}")
    return df


def assert_all_match(rows: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """The rows, written once; raises if one of those written has no row of ``other`` with its keys (null matches nothing)."""
    rows = written(rows)
    if lost := rows.join(other, keys, "left_anti").limit(5).collect():
        raise ValueError(f"rows without a match, among them {lost}")
    return rows
