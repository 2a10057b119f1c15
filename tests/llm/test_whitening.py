"""Whitening against the eigenvectors of the covariance of all vectors at once."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import whitening

SF = "/root/testdata/sf0.001"


def brute(rows, components=16):
    """(id, component) -> (n, deviation, whitened, explained), with signs as they fall."""
    own = [(i, [int(np.floor(64 * float(c))) + 1_000_000 for c in v]) for i, v in rows if v and all(c is not None and np.isfinite(c) for c in v)]
    fit = np.array(sorted({tuple(x) for _, x in own}))
    n, sums = len(fit), fit.sum(axis=0)
    centred = fit - sums / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(-values)[:components]
    out = {}
    for i, x in own:
        deviation = sum((n * int(a) - int(s)) ** 2 for a, s in zip(x, sums, strict=True))
        for k, at in enumerate(order, 1):
            out[i, k] = n, deviation, (np.array(x) - sums / n) @ vectors[:, at] / np.sqrt(values[at]), values[at] / values.sum()
    return out


def same(got, expected):
    assert {(r["vec_id"], r["component"]) for r in got} == expected.keys() and len(got) == len(expected)
    signs = {}
    for r in got:
        n, deviation, whitened, explained = expected[r["vec_id"], r["component"]]
        assert (r["n"], r["deviation"]) == (n, deviation) and r["explained"] == pytest.approx(explained, rel=1e-9)
        sign = signs.setdefault(r["component"], 1 if abs(r["whitened"] - whitened) < abs(r["whitened"] + whitened) else -1)
        assert sign * r["whitened"] == pytest.approx(whitened, abs=1e-8)
        assert r["identity_error"] < 1e-9


@pytest.mark.parametrize("parts", [1, 40])
def test_whole_table(spark, parts):
    vectors = spark.read.parquet(f"{SF}/embeddings.parquet").repartition(parts)
    copies = vectors.unionByName(vectors.where("vec_id = 7").crossJoin(spark.range(300).select((F.col("id") + 10_000).alias("copy"))).withColumn("vec_id", F.col("copy")).drop("copy"))
    same(whitening.op13_merged_svd(copies).collect(), brute([(r["vec_id"], r["embedding"]) for r in copies.collect()]))


def test_merges_lose_nothing():
    rng = np.random.default_rng(5)
    x = rng.integers(-50, 50, (700, 12)) * (10 ** rng.integers(0, 4, 12)) + rng.integers(-(10**5), 10**5, 12)
    parts = [whitening.Summary.of(b) for b in np.array_split(x, 23)]
    while len(parts) > 1:
        parts = [a.merged(b) for a, b in zip(parts[::2], parts[1::2], strict=False)] + parts[len(parts) // 2 * 2 :]
    one, whole = parts[0], np.linalg.svd(x - x.mean(axis=0), full_matrices=False)[1]
    assert one.n == 700 and (one.sums == x.sum(axis=0)).all() and np.allclose(one.scales, whole, rtol=1e-12)
    assert np.allclose((one.vectors.T * one.scales**2) @ one.vectors, (x - x.mean(axis=0)).T @ (x - x.mean(axis=0)), rtol=1e-9)


def test_levels(spark):
    """More summaries than one group holds."""
    vectors = spark.range(3000).select(F.array(*(F.floor(F.rand(i) * 100).cast("long") + 1_000_000 for i in range(5))).alias("x")).repartition(300)
    one = whitening.merged_summary(whitening.partition_summaries(vectors), 300)
    x = np.array([r["x"] for r in vectors.collect()]) - 1_000_000
    assert one.n == 3000 and np.allclose(one.scales, np.linalg.svd(x - x.mean(axis=0), full_matrices=False)[1], rtol=1e-10)


HARD = [(1, [1.0, 2.0, 0.5]), (2, [1.0, None, 0.0]), (3, None), (4, [float("nan"), 1.0, 1.0]), (5, [float("inf"), 1.0, 1.0]), (6, []), (7, [1.0]), (8, [-3.25, 2.0, 0.25]), (8, [-3.25, 2.0, 0.25]), (None, [0.1, 0.2, 0.3]), (9, [7.0, 1.0, 1.0]), (10, [1e30, 1.0, 1.0])]


def test_hard_rows(spark):
    df = spark.createDataFrame(HARD, "vec_id long, embedding array<double>").withColumns({c: F.lit(1) for c in ("x", "whitened", "deviation", "n", "part")})
    got = whitening.op13_merged_svd(df).collect()
    assert sorted({r["vec_id"] for r in got}, key=str) == [1, 8, 9, None] and {r["n"] for r in got} == {4}
    assert sum(r["vec_id"] == 8 for r in got) == 2 * sum(r["vec_id"] == 1 for r in got) == 6
    assert whitening.op13_merged_svd(df.where("vec_id = 99")).count() == 0
    assert whitening.op13_merged_svd(df.where("vec_id = 1")).count() == 0
    kept, whitened, deviation = whitening.whiten(df, whitening.fit_whitening(df, components=2))
    assert (whitened, deviation) == ("_whitened", "_deviation") and {len(r["_whitened"]) for r in kept.collect()} == {2}


def test_flat_directions(spark):
    """Directions without variance have no component."""
    df = spark.range(50).select(F.col("id").alias("vec_id"), F.array(F.col("id") / 64.0, F.lit(3.0), F.col("id") / 32.0).alias("embedding"))
    got = whitening.op13_merged_svd(df).collect()
    assert {r["component"] for r in got} == {1} and len(got) == 50


def test_large_deviations():
    model = whitening.Whitening(10**6, np.array([5 * 10**11, -3]), np.eye(2), np.ones(2), np.ones(2))
    x = np.array([[123_456, 7], [-50, 2]])
    assert model.deviations(x) == [sum((10**6 * int(a) - int(s)) ** 2 for a, s in zip(row, model.sums, strict=True)) for row in x]
