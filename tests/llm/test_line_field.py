"""The field's sums against enumeration of all labelings; training on hard label tables."""

from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import line_crf


@pytest.mark.parametrize("pulled", [False, True])
def test_marginals_by_enumeration(pulled):
    rng = np.random.default_rng(5)
    lengths = np.array([1, 4, 7, 2, 7, 1])
    starts = np.cumsum(lengths) - lengths
    features = rng.normal(size=(lengths.sum(), 9))
    field = line_crf.Field(rng.normal(size=(9, 2)), rng.normal(size=(2, 2)))
    pull = rng.normal(size=lengths.sum()) if pulled else None
    got, moves = field.marginals(features, starts, lengths, pull)
    local = features @ field.weights
    if pulled:
        local[:, 1] += pull
    want, total_moves = np.zeros_like(local), np.zeros((2, 2))
    for start, n in zip(starts, lengths):
        weights = {y: np.exp(sum(local[start + i, v] for i, v in enumerate(y)) + sum(field.moves[a, b] for a, b in zip(y, y[1:]))) for y in product((0, 1), repeat=int(n))}
        whole = sum(weights.values())
        for y, w in weights.items():
            for i, v in enumerate(y):
                want[start + i, v] += w / whole
            for a, b in zip(y, y[1:]):
                total_moves[a, b] += w / whole
    assert np.allclose(got, want) and np.allclose(moves, total_moves)


def test_lines_may_differ_from_their_document():
    """Documents of good and bad lines: after training, lines are told apart better than by their document's label."""
    rng = np.random.default_rng(2)
    lines, labels, truth = [], [], []
    for i in range(300):
        y = i % 2
        good = rng.random(12) < (0.8 if y else 0.2)
        x = np.zeros((12, line_crf.MEASURES), np.float32)
        x[:, 2], x[:, 4] = np.where(good, 0.8, 0.3) + rng.normal(0, 0.05, 12), np.where(good, 0.05, 0.6) + rng.normal(0, 0.05, 12)
        lines.append((x, np.full(12, 40.0)))
        labels.append(y)
        truth.append(good)
    field = line_crf.fit(lines, np.array(labels), np.ones(2))
    lengths = np.full(len(lines), 12)
    starts = np.cumsum(lengths) - lengths
    marginal = field.marginals(line_crf.with_neighbours(np.concatenate([x for x, _ in lines]), starts, lengths), starts, lengths)[0][:, 1]
    assert np.mean((marginal > 0.5) == np.concatenate(truth)) > np.mean(np.repeat(labels, 12) == np.concatenate(truth))
    inside = [len(set((marginal[12 * i : 12 * i + 12] > 0.5).tolist())) for i in range(len(lines))]
    assert np.mean(np.array(inside) == 2) > 0.1
    assert np.mean((field.score(field.quality(lines)) > 0.5) == np.array(labels)) > 0.95


def test_label_tables(spark):
    docs = spark.createDataFrame([(i, f"line {i} of text.\n" * 3 if i % 2 else "#$% @@ ^^\n" * 3) for i in range(40)] + [(1, "another text"), (3, None)], "doc_id long, text string").withColumn("score", F.lit(1))
    scores = lambda labels: [r["score"] for r in line_crf.op5_line_crf_quality(docs, spark.createDataFrame(labels, "doc_id long, quality int")).orderBy("doc_id", "score").collect()]
    assert set(scores([])) == set(scores([(i, 1) for i in range(40)])) == set(scores([(i, None) for i in range(40)])) == {0.5}
    known = [(i, i % 2) for i in range(40)] + [(None, 1), (5, 0), (7, None)]
    assert scores(known) == scores(known[::-1])
    assert line_crf.train(docs, spark.createDataFrame(known, "doc_id long, quality int"), sample_bytes=0).slope == 0


def test_an_oversized_text_is_skipped_alone(spark):
    """The text with the smallest hash of each label is longer than the bound: the others are learned from."""
    docs = spark.createDataFrame([(i, ("line %d of text.\n" % i if i % 2 else "#$% @@ ^^\n") * 3) for i in range(40)], "doc_id long, text string")
    first = docs.where(~line_crf.held_out("doc_id")).orderBy(F.xxhash64("doc_id")).select("doc_id").collect()
    big = {next(r["doc_id"] for r in first if r["doc_id"] % 2 == k) for k in (0, 1)}
    docs = docs.withColumn("text", F.when(F.col("doc_id").isin(list(big)), F.repeat("text", 100)).otherwise(F.col("text")))
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    assert line_crf.train(docs, labels, sample_bytes=1000).slope > 0


def test_blocks_of_lines(monkeypatch):
    """Scores do not depend on how many lines are held at once."""
    rng = np.random.default_rng(1)
    field = line_crf.Field(rng.normal(size=(3 * line_crf.MEASURES + 1, 2)), rng.normal(size=(2, 2)), 2.0, -1.0)
    texts = ["", None, "one line", "a\n\nB 7!\n" * 50, "x y z.\n" * 7]
    whole = field.quality([line_crf.text_measures(t) for t in texts])
    monkeypatch.setattr(line_crf, "BLOCK_LINES", 3)
    assert np.allclose(field.quality([line_crf.text_measures(t) for t in texts]), whole)
    assert [list(range(5))[s] for s in line_crf.shares([1, 1, 5, 1, 1], 3)] == [[0, 1], [2], [3, 4]]


def test_many_long_texts_in_one_slice():
    """Ten texts of 20,000 lines: features of a block of lines at a time."""
    import tracemalloc

    field = line_crf.Field(np.ones((3 * line_crf.MEASURES + 1, 2)), np.zeros((2, 2)))
    texts = ["ab\n" * 20_000] * 10
    tracemalloc.start()
    for some in line_crf.shares([t.count("\n") + 1 for t in texts], line_crf.BLOCK_LINES):
        field.quality([line_crf.text_measures(t) for t in texts[some]])
    assert tracemalloc.get_traced_memory()[1] < 40 << 20
    tracemalloc.stop()
