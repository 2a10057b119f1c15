"""Whitening of embeddings by merging singular value decompositions.

Entries become whole numbers x = floor(64 c) + 1,000,000; the fit list holds each different x vector once, found by a pre-aggregated
shuffle, so a vector that fills a third of the table counts and travels once a task. Every partition of the list is decomposed block by block and keeps all
its singular values, vectors, and exact sums (full rank, nothing is cut off). Two summaries are merged by stacking their scaled vectors
and one row that corrects for the distance of their means, and decomposing again; ``FAN`` summaries a group are merged by Spark, level by level, until one
is left. Only that one (d x d doubles and d sums for d dimensions) comes to the driver: its right vectors are the components, its squared values
over n the variances.

Vectors are decomposed as deviations from exact means, never as products, so small variances keep their digits. Signs are fixed (a component's
largest entry is positive) and one model serves all rows.

Defined results: rows whose vector is null, or holds a null, NaN, infinite or beyond-2^56 entry are dropped; the dimension is the commonest vector length
of the fit list (of several, the longest), and vectors of other lengths lack or exceed it and are dropped; an equal vector counts once in the fit but every row is
whitened; directions without variance cannot be scaled and give no component, so one vector alone gives no rows; null ids stay; an empty table
gives no rows; new columns whose names the table has get underscores before them. A deviation beyond 2^63 raises an error.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, fresh_name, map_columns

COMPONENTS, FAN, BLOCK_ROWS = 16, 16, 4096
#: A direction whose singular value is a smaller share of the largest has no variance, only rounding.
LEAST_SHARE = 1e-11
SCALE, OFFSET = 64, 1_000_000
_SUMMARY = "part int, n long, sums array<long>, scales array<double>, vectors array<double>"
_SUMMARY_TYPE = pa.schema([("part", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.int64())), ("scales", pa.list_(pa.float64())), ("vectors", pa.list_(pa.float64()))])


def quantized(vector: Column) -> Column:
    """The whole numbers of a vector, or null where an entry has none."""
    usable = F.forall(vector, lambda c: F.coalesce(F.abs(c.cast("double")) < float(1 << 56), F.lit(False)) & ~F.isnan(c.cast("double")))
    return F.when(usable, F.transform(vector, lambda c: F.floor(c.cast("double") * SCALE) + OFFSET))


@dataclass
class Summary:
    """n rows, their exact sums, and the singular values and right vectors of their deviations from the mean."""

    n: int
    sums: np.ndarray
    scales: np.ndarray
    vectors: np.ndarray

    @property
    def mean(self) -> np.ndarray:
        return self.sums / self.n

    @classmethod
    def of(cls, x: np.ndarray) -> Summary:
        """x: whole numbers less the offset, so that means keep their digits."""
        sums = x.sum(axis=0)
        _, scales, vectors = np.linalg.svd(x - sums / len(x), full_matrices=False)
        return cls(len(x), sums, scales, vectors)

    def merged(self, other: Summary) -> Summary:
        n = self.n + other.n
        between = np.sqrt(self.n * other.n / n) * (self.mean - other.mean)
        stacked = np.vstack([self.scales[:, None] * self.vectors, other.scales[:, None] * other.vectors, between])
        _, scales, vectors = np.linalg.svd(stacked, full_matrices=False)
        return Summary(n, self.sums + other.sums, scales, vectors)

    def row(self, part: int) -> dict:
        return {"part": part, "n": self.n, "sums": self.sums.tolist(), "scales": self.scales.tolist(), "vectors": self.vectors.ravel().tolist()}

    @classmethod
    def of_row(cls, row: dict) -> Summary:
        return cls(row["n"], np.array(row["sums"]), np.array(row["scales"]), np.array(row["vectors"]).reshape(-1, len(row["sums"])))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def partition_summaries(vectors: DataFrame) -> DataFrame:
    """A summary for each partition of one column of vectors of whole numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        so_far = None
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                block = Summary.of(_matrix(batch.column(0).slice(at, BLOCK_ROWS)) - OFFSET)
                so_far = so_far.merged(block) if so_far else block
        if so_far:
            yield pa.RecordBatch.from_pylist([so_far.row(TaskContext.get().partitionId())], _SUMMARY_TYPE)

    return vectors.mapInArrow(run, _SUMMARY)


def merged_summary(summaries: DataFrame, parts: int) -> Summary | None:
    """The summary of all; ``parts``: one more than the largest part number. A level's groups hold ``FAN`` summaries at most."""

    def merge(rows: pa.Table) -> pa.Table:
        ordered = sorted(rows.to_pylist(), key=lambda r: r["part"])
        one = reduce(Summary.merged, map(Summary.of_row, ordered))
        return pa.Table.from_pylist([one.row(ordered[0]["part"] // FAN)], _SUMMARY_TYPE)

    while parts > 1:
        summaries, parts = summaries.groupBy(F.expr(f"part div {FAN}")).applyInArrow(merge, _SUMMARY), -(-parts // FAN)
    row = summaries.first()
    return Summary.of_row(row.asDict()) if row else None


@dataclass
class Whitening:
    """n and sums of the fit list; the components with variance, the largest first; each one's share of the total variance."""

    n: int
    sums: np.ndarray
    components: np.ndarray
    variances: np.ndarray
    explained: np.ndarray
    identity_error: float = 0.0

    @classmethod
    def of(cls, s: Summary, components: int) -> Whitening:
        kept = min(components, int((s.scales > s.scales.max(initial=0) * LEAST_SHARE).sum()))
        variances = s.scales**2 / s.n
        vectors = s.vectors[:kept]
        signs = np.sign(vectors[np.arange(kept), np.abs(vectors).argmax(axis=1)])
        return cls(s.n, s.sums, vectors * signs[:, None], variances[:kept], variances[:kept] / max(variances.sum(), 1e-300))

    def whitened(self, x: np.ndarray) -> np.ndarray:
        """x: whole numbers less the offset."""
        return (x - self.sums / self.n) @ self.components.T / np.sqrt(self.variances)

    def deviations(self, x: np.ndarray) -> list[int]:
        """Exact sums of (n x - S)^2."""
        apart = float(np.abs(x).max(initial=0)) * self.n + float(np.abs(self.sums).max(initial=0))
        exact = x if apart * apart * x.shape[1] < 2.0**62 else x.astype(object)
        return ((self.n * exact - self.sums) ** 2).sum(axis=1).tolist()


def _identity_error(fit: DataFrame, model: Whitening) -> float:
    """The largest entry of the whitened fit list's covariance less the identity; each partition sends k x k sums."""
    k = len(model.components)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, k))
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                w = model.whitened(_matrix(batch.column(0).slice(at, BLOCK_ROWS)) - OFFSET)
                total += w.T @ w
        yield pa.RecordBatch.from_pydict({"products": pa.array([total.ravel().tolist()], pa.list_(pa.float64()))})

    products = fit.mapInArrow(run, "products array<double>").select(F.posexplode("products").alias("place", "product")).groupBy("place").agg(F.sum("product").alias("product"))
    covariance = np.zeros(k * k)
    for place, product in products.collect():
        covariance[place] = product / model.n
    return float(np.abs(covariance.reshape(k, k) - np.eye(k)).max(initial=0.0))


def fit_whitening(df: DataFrame, vector_col: str = "embedding", components: int = COMPONENTS) -> Whitening | None:
    """The model of a table's vectors, or None where there are none."""
    different = df.select(quantized(F.col(f"`{vector_col}`")).alias("x")).where("size(x) > 0").distinct()
    fit = checkpointed(different)
    lengths = fit.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    if not lengths:
        return None
    fit = fit.where(F.size("x") == lengths[0]["d"])
    model = Whitening.of(merged_summary(partition_summaries(fit), fit.rdd.getNumPartitions()), components)
    model.identity_error = _identity_error(fit, model)
    return model


def whiten(df: DataFrame, model: Whitening | None, vector_col: str = "embedding") -> tuple[DataFrame, str, str]:
    """The rows that have whole numbers in the model's dimension, with their whitened vector and their deviation; also the two columns' names."""
    x, whitened, deviation = (fresh_name(df, name) for name in ("x", "whitened", "deviation"))
    d = len(model.sums) if model else -1
    rows = df.withColumn(x, quantized(F.col(f"`{vector_col}`"))).where(F.size(x) == d)

    def start():
        def work(vectors):
            if not vectors:
                return [[], []]
            own = np.array(vectors) - OFFSET
            return [model.whitened(own).tolist(), model.deviations(own)]

        return work

    fields = [(whitened, "array<double>", pa.list_(pa.float64())), (deviation, "long", pa.int64())]
    return map_columns(rows, [x], fields, start, rows=BLOCK_ROWS, drop=(x,)), whitened, deviation


def op13_merged_svd(embeddings: DataFrame) -> DataFrame:
    vectors = embeddings.select("vec_id", "embedding")
    model = fit_whitening(vectors)
    rows, whitened, deviation = whiten(vectors, model)
    explained = F.array(*(F.lit(float(e)) for e in (model.explained if model else [])))
    each = rows.select("vec_id", deviation, F.posexplode(whitened).alias("at", "whitened"))
    return each.select("vec_id", (F.col("at") + 1).alias("component"), F.lit(model.n if model else 0).cast("long").alias("n"), F.col(deviation).alias("deviation"), "whitened", F.get(explained.cast("array<double>"), F.col("at")).alias("explained"), F.lit(model.identity_error if model else 0.0).alias("identity_error"))
