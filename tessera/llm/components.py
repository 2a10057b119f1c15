"""Connected components over an edge table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed

#: Rows of a small table that one task takes: rounds over few edges make few tasks and few files.
ROWS_A_TASK = 250_000


def tasks_for(rows: int) -> int:
    return 1 + rows // ROWS_A_TASK


def _with_least(edges: DataFrame) -> DataFrame:
    """(u, v, m): each edge with the least of u and all its neighbours. Minima are pre-aggregated, then joined."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    return edges.join(least, "u").select("u", "v", F.least("u", "m").alias("m"))


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node that has an edge to another node; root is the component's least node.

    Every round is written to the checkpoint folder; only two numbers per round come to the driver. Null ends and
    edges of a node to itself are left out. The number of rounds grows with the logarithm of the longest path.
    """
    e = checkpointed(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct())
    seen = None
    while True:
        # DECIMAL sums so that no overflow depends on the values
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen or not now[0]:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen, tasks = now, tasks_for(now[0])
        e = e.coalesce(tasks)
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").coalesce(tasks).distinct().coalesce(tasks)
        small = _with_least(large).coalesce(tasks)
        e = checkpointed(small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v"))).where("u <> v").distinct().coalesce(tasks))
