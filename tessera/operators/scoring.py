"""Composite scores: normalizers, weighted components, coverage floors and tiers."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import half_up
from .steps import written


#: Value ranges in which percentiles are ranked.
CUTS = 64


@dataclass(frozen=True)
class Component:
    """One component: its raw column, normalizer ('percentile' or 'log'), direction, weight, and what null means."""

    name: str
    column: str
    normalizer: str = "percentile"
    inverted: bool = False
    weight: int = 1
    zero_if_missing: bool = False
    covers: bool = True


def percentile(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Adds for each (raw, new) the average-rank percentile 0-100 among non-null values; one value alone is 100.

    The input is written once, with a number for each row. All columns are ranked together: their distinct values (as doubles) are
    counted, then ranked in CUTS value ranges of about equal numbers (cut at approximate quantiles, which decide only the dealing),
    so no task sorts all of them; a range's start is the sum of the ranges before it. Ranks go back to (row, column, value) in one
    join and from there to the rows in another, however many columns there are. Nulls take no part in the first; values that hold
    at least 1 / CUTS of a column's rows, of which there are CUTS at most, are broadcast, so that no task gets all rows of one value.
    """
    if not columns:
        return df
    raws = list(columns)
    df = written(df.withColumn("__row", F.monotonically_increasing_id()))
    values = df.select(*(F.col(raw).cast("double").alias(f"v{i}") for i, raw in enumerate(raws)))
    quantiles = values.approxQuantile(values.columns, [i / CUTS for i in range(1, CUTS)], 0.005)
    cuts = F.array(*(F.array(*(F.lit(c) for c in sorted(set(q)))).cast("array<double>") for q in quantiles))
    cells = F.array(*(F.struct(F.lit(i).alias("__of"), F.col(raw).cast("double").alias("__v")) for i, raw in enumerate(raws)))
    long = df.select("__row", F.explode(cells).alias("x")).select("__row", "x.*").where("__v is not null")
    counts = long.groupBy("__of", "__v").agg(F.count("*").alias("__n")).withColumn("__part", F.size(F.filter(cuts[F.col("__of")], lambda c: c < F.col("__v"))))
    parts = counts.groupBy("__of", "__part").agg(F.sum("__n").alias("__m"))  # at most CUTS rows of each column
    of = Window.partitionBy("__of")
    starts = parts.select("__of", "__part", (F.sum("__m").over(of.orderBy("__part")) - F.col("__m")).alias("__start"), F.sum("__m").over(of).alias("__all"))
    upto = F.sum("__n").over(Window.partitionBy("__of", "__part").orderBy("__v"))
    ranked = counts.withColumn("__upto", upto).join(F.broadcast(starts), ["__of", "__part"])
    below = F.col("__start") + F.col("__upto") - F.col("__n")
    value = F.when(F.col("__all") == 1, 100.0).otherwise((below + (F.col("__n") - 1) / 2) / F.nullif(F.col("__all") - 1, F.lit(0)) * 100)
    ranked = ranked.select("__of", "__v", value.alias("__p"), (F.col("__n") * CUTS >= F.col("__all")).alias("__hot"))
    key, hot = ["__of", "__v"], F.broadcast(ranked.where("__hot"))
    placed = long.join(hot, key).union(long.join(hot, key, "left_anti").join(ranked.where("not __hot"), key))
    by_row = placed.groupBy("__row").agg(*(F.max(F.when(F.col("__of") == i, F.col("__p"))).alias(new) for i, new in enumerate(columns.values())))
    return df.join(by_row, "__row", "left").drop("__row")


def log_minmax(df: DataFrame, columns: dict[str, str], pending: Column | None = None) -> DataFrame:
    """Adds for each (raw, new) the log-scaled position 0-100 between least and greatest of the pending rows' values."""
    use = F.lit(True) if pending is None else pending
    bounds = df.agg(*(x for raw in columns for v in [F.when(use, F.col(raw))] for x in (F.min(v).alias(f"__{raw}_min"), F.max(v).alias(f"__{raw}_max"), F.min(F.when(v > 0, v)).alias(f"__{raw}_pos"))))
    joined = df.join(F.broadcast(bounds))  # one row
    out = list(df.columns)
    for raw, new in columns.items():
        eps = F.coalesce(F.col(f"__{raw}_pos") * 0.01, F.lit(0.01))
        low, high, v = F.ln(F.col(f"__{raw}_min") + eps), F.ln(F.col(f"__{raw}_max") + eps), F.ln(F.col(raw) + eps)
        out.append(F.when(F.col(raw).isNull(), None).when(high == low, 100.0).otherwise(100 * (v - low) / F.nullif(high - low, F.lit(0.0))).alias(new))
    return joined.select(*out)


def coverage(*values: Column) -> Column:
    """How many of the values are there."""
    return F.size(F.filter(F.array(*values), lambda x: x.isNotNull()))


def weighted_mean(values: list[tuple[Column, int]]) -> Column:
    """Mean over present values, each counted as often as its weight."""
    repeated = F.filter(F.array(*(v for v, w in values for _ in range(w))), lambda x: x.isNotNull())
    return F.try_divide(F.aggregate(repeated, F.lit(0.0), lambda so, x: so + x), F.size(repeated))


def tier(count: Column, measured: int, proxy: int) -> Column:
    return F.when(count >= measured, "measured").when(count >= proxy, "proxy").otherwise("unavailable")


def composite_score(df: DataFrame, components: list[Component], floor: int, measured: int, proxy: int, confirmed: Column | None = None) -> DataFrame:
    """Adds ``<component>_norm``, ``n_present``, ``score`` (one decimal, null under the floor) and ``tier``.

    confirmed: rows scored 0 and measured whatever their components; they take no part in the log bounds.
    """
    pending = None if confirmed is None else ~F.coalesce(confirmed, F.lit(False))
    for c in components:
        if c.zero_if_missing:
            df = df.withColumn(c.column, F.coalesce(F.col(c.column), F.lit(0)))
    df = percentile(df, {c.column: f"{c.name}_norm" for c in components if c.normalizer == "percentile"})
    logs = {c.column: f"{c.name}_norm" for c in components if c.normalizer == "log"}
    if logs:
        df = log_minmax(df, logs, pending)
    for c in components:
        if c.inverted:
            df = df.withColumn(f"{c.name}_norm", 100 - F.col(f"{c.name}_norm"))
    n = coverage(*(F.col(c.column) for c in components if c.covers))
    mean = F.when(n >= floor, half_up(weighted_mean([(F.col(f"{c.name}_norm"), c.weight) for c in components]), 1))
    df = df.withColumn("n_present", n)
    if confirmed is None:
        return df.withColumn("score", mean).withColumn("tier", tier(F.col("n_present"), measured, proxy))
    sure = ~pending
    df = df.withColumns({"n_present": F.when(sure, measured).otherwise(F.col("n_present")), "score": F.when(sure, 0.0).otherwise(mean), "tier": F.when(sure, "measured").otherwise(tier(F.col("n_present"), measured, proxy))})
    return df.withColumns({f"{c.name}_norm": F.when(sure, 0.0).otherwise(F.col(f"{c.name}_norm")) for c in components})
