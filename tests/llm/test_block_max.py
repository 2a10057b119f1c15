"""Searches over many small shards and blocks, ties and few results; what pruning looks at."""

from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tessera.llm import topk_search
from tessera.llm.common import ascii_lower_words

SF = "/root/testdata/sf0.001"


def rows_of(df):
    return sorted((r["query_id"], r["rank"], -1 if r["id"] is None else r["id"], r["score"]) for r in df.collect())


def test_shards_and_blocks_do_not_matter(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").repartition(3)
    asked = docs.where("doc_id % 10 = 0")
    want = rows_of(topk_search.search(docs, asked))
    assert want and rows_of(topk_search.search(docs, asked, shard_bytes=20_000, block_bytes=30_000)) == want


def test_texts_of_one_query_id_ask_together(spark):
    """Repeated query rows, and an id with several texts, give the same rows however many blocks there are."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").where("doc_id < 120")
    texts = [r.text for r in docs.orderBy("doc_id").limit(24).collect()]
    asked = spark.createDataFrame([(i % 6, t) for i, t in enumerate(texts)] * 2 + [(9, None), (None, "x")], "doc_id long, text string")
    whole = spark.createDataFrame([(q, " ".join(texts[q::6])) for q in range(6)], "doc_id long, text string")
    want = rows_of(topk_search.search(docs, whole))
    assert len(want) == 60 and rows_of(topk_search.search(docs, asked)) == want and rows_of(topk_search.search(docs, asked, block_bytes=2_000)) == want


def test_few_results_and_ties(spark):
    rows = [(i, "common word") for i in range(30)] + [(100, "rare thing"), (101, "thing"), (None, "common word"), (7, "common word")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit(1)).repartition(8)
    got = rows_of(topk_search.search(docs, docs.where("doc_id in (5, 100)"), shard_bytes=1))
    assert [r[2] for r in got if r[0] == 5] == [0, 1, 2, 3, 4, 5, 6, 7, 7, 8]
    assert [r[2] for r in got if r[0] == 100] == [100, 101]


def test_pruning_skips_postings_and_loses_nothing():
    """Common words in half of all documents, and three rare ones in twelve each: cells of common words stay closed."""
    rng = np.random.default_rng(8)
    texts = [" ".join([*(f"common{int(w)}" for w in rng.integers(0, 12, 10)), *(f"rare{i // 12}{c}" for c in "abc")]) for i in range(4000)]
    names = sorted({w for t in texts for w in ascii_lower_words(t)})
    number = {w: i for i, w in enumerate(names)}
    counts = [Counter(number[w] for w in ascii_lower_words(t)) for t in texts]
    order = list(range(len(texts)))
    word = np.array([w for i in order for w in counts[i]])
    doc = np.array([k for k, i in enumerate(order) for _ in counts[i]])
    tf = np.array([n for i in order for n in counts[i].values()], float)
    by = np.lexsort((doc, word))
    seen = np.bincount(word, minlength=len(names))
    idf = np.log(1 + (len(texts) - seen + 0.5) / (seen + 0.5))
    shard = topk_search.Shard(np.array(order), np.full(len(texts), 13), word[by], doc[by], tf[by], idf, 13.0)
    for q in range(0, 400, 7):
        words = np.array(sorted(counts[q]))
        words = words[np.argsort(-seen[words], kind="stable")]
        full = np.round([sum(idf[w] * n * 2.2 / (n + 1.2) for w, n in sorted(counts[i].items()) if w in counts[q]) for i in range(len(texts))], 6)
        best = sorted(range(len(texts)), key=lambda i: (-full[i], i))[:10]
        scores, ids = shard.search(words, 10, np.zeros(0), np.zeros(0, np.int64))
        assert ids.tolist() == best and np.allclose(scores, full[best])
        again = shard.search(words, 10, np.zeros(0), np.zeros(0, np.int64), scores[-1])
        assert again[1].tolist() == best
    assert shard.scored < 0.1 * shard.postings, shard.scored / shard.postings
