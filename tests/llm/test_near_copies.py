"""The pipeline's near-copy stage against brute force over all pairs."""

from itertools import combinations

import numpy as np
from pyspark.sql import functions as F

from tessera.llm import near_copies


def similar(texts):
    """Pairs of distinct texts with Jaccard >= 0.8 over five-word shingles, by comparing all."""
    sets = {}
    for t in texts:
        words = (t or "").encode().lower().split()
        sets[t or ""] = {b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))}
    return [(x, y) for x, y in combinations(sorted(sets), 2) if 5 * len(sets[x] & sets[y]) >= 4 * len(sets[x] | sets[y])]


def firsts(rows, pairs):
    """The least id of each component."""
    root = {r["text"] or "": r["text"] or "" for r in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x, y in pairs:
        root[find(y)] = find(x)
    least = {}
    for r in rows:
        top = find(r["text"] or "")
        least[top] = min(r["doc_id"], least.get(top, r["doc_id"]))
    return set(least.values())


def test_all_pairs_are_found(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    pairs = similar([r["text"] for r in rows])
    assert pairs
    got = {r["doc_id"] for r in near_copies.drop_near_duplicates(docs).collect()}
    assert got == firsts(rows, pairs)


def test_crowded_chain(spark):
    """Texts that slide by one word each are one group, although its ends share nothing."""
    words = [f"w{i}" for i in range(160)]
    rows = [(i, " ".join(words[i : i + 60])) for i in range(100)] + [(200, ""), (201, None), (202, "a b"), (203, "A  b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r["doc_id"] for r in near_copies.drop_near_duplicates(docs).collect()) == [0, 200, 202]


def test_bitmaps_bound_the_difference():
    rng = np.random.default_rng(3)
    for n, m, same in ((10, 12, 8), (500, 520, 400), (1000, 1100, 900), (60_000, 70_000, 55_000), (1, 1, 0), (3, 3, 3)):
        every = rng.integers(-(2**63), 2**63, n + m - same)
        one, two = np.unique(every[:n]), np.unique(every[n - same :])
        apart = near_copies.bits_apart(near_copies.bitmap(one), near_copies.bitmap(two))
        assert apart <= len(np.setxor1d(one, two)) and apart == near_copies.bits_apart(near_copies.bitmap(two), near_copies.bitmap(one))


def test_rows_are_judged_by_their_own_text(spark):
    """Repeated and null ids, exact copies, extra columns of clashing names: no unique text is lost."""
    a, b = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    rows = [(3, a), (5, a), (5, b), (None, a), (None, "only here"), (None, "only here"), (7, b + " more"), (8, ""), (9, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as node", "2 as root", "3 as n")
    got = near_copies.drop_near_duplicates(docs)
    assert got.columns == docs.columns
    assert sorted((str(r["doc_id"]), r["text"]) for r in got.collect()) == [("3", a), ("5", b), ("8", ""), ("None", "only here")]
    assert near_copies.drop_near_duplicates(docs.where("doc_id = 99")).count() == 0


def test_lists_beyond_the_bound_are_shuffled(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = sorted(r["doc_id"] for r in near_copies.drop_near_duplicates(docs).collect())
    monkeypatch.setattr(near_copies, "BROADCAST_NODES", 0)
    assert sorted(r["doc_id"] for r in near_copies.drop_near_duplicates(docs).collect()) == want


def test_texts_that_share_a_hash(spark, monkeypatch):
    """With a hash of five values, different texts still are different texts."""
    words = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(words[i:] + words[: i % 3])) for i in range(0, 24, 3)] + [(50, " ".join(words)), (51, " ".join(words) + " w"), (52, ""), (53, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(r["doc_id"] for r in near_copies.drop_near_duplicates(docs).collect())
    monkeypatch.setattr(near_copies, "text_hash", lambda c: F.pmod(F.length(F.coalesce(F.col(c).cast("string"), F.lit(""))), F.lit(5)).cast("long"))
    assert sorted(r["doc_id"] for r in near_copies.drop_near_duplicates(docs).collect()) == want
