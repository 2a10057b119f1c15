"""Benchmark containment with wide and saturated bitmaps against enumeration, with hard rows."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.llm import decontaminate
from tessera.llm.decontaminate import ascii_lower_words


def by_hand(text, items):
    words, hit, found = ascii_lower_words(text), set(), set()
    for item, item_text in items:
        own = ascii_lower_words(item_text)
        size = min(13, len(own))
        for at in range(len(own) - size + 1) if own else ():
            for i in range(len(words) - size + 1):
                if words[i : i + size] == own[at : at + size]:
                    hit |= set(range(i, i + size))
                    found.add(item or "")
    return len(words), len(hit), sorted(found)


@pytest.mark.parametrize("filter_bytes", [1 << 20, 8, 512])
def test_windows_by_enumeration(spark, filter_bytes):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(6)]
    items = [(str(i), " ".join(rng.choices(words, k=rng.choice([0, 1, 2, 4, 5, 12, 13, 14, 30])))) for i in range(40)] + [(None, "w1 w1 w1 w1 w1 w1"), ("x", None), ("y", "w1 w1 w1 w1 w1 w1")]
    docs = [(i, " ".join(rng.choices(words, k=rng.randint(0, 60)) + (items[i % 40][1] or "").split() + rng.choices(words, k=5))) for i in range(30)] + [(1, None), (None, ""), (3, "W1, w1; w1 w1-w1 W1"), (3, "W1, w1; w1 w1-w1 W1")]
    rows = spark.createDataFrame(docs, "doc_id long, text string").withColumns({c: F.lit(7) for c in ("n_words", "items", "key_a", "candidates")})
    found, names = decontaminate.find_contamination(rows, spark.createDataFrame(items, "item_id string, text string"), filter_bytes=filter_bytes)
    got = sorted((str(r["doc_id"]), r["text"] or "", r[names["n_words"]], sum(b - a for a, b in r[names["spans"]]), r[names["items"]]) for r in found.collect())
    assert got == sorted((str(i), t or "", *by_hand(t, items)) for i, t in docs)
    assert set(rows.columns) <= set(found.columns)
    narrow, names = decontaminate.find_contamination(rows, spark.createDataFrame(items, "item_id string, text string"), filter_bytes=filter_bytes, keep_text=False)
    assert sorted((str(r["doc_id"]), r[names["n_words"]], r[names["items"]]) for r in narrow.collect()) == sorted((i, n, x) for i, _, n, _, x in got)
    clean = decontaminate.decontaminate(rows, spark.createDataFrame(items, "item_id string, text string"), filter_bytes=filter_bytes)
    assert clean.columns == rows.columns
    assert sorted((str(r["doc_id"]), r["text"] or "") for r in clean.collect()) == sorted((i, t) for i, t, n, hit, _ in got if not (hit and 20 * hit >= n))


def test_a_large_benchmark(spark):
    """Tens of thousands of windows, a few of which occur; no block of them is held by the driver."""
    rng = random.Random(8)
    items = [(i, " ".join(f"q{rng.randrange(10**6)}" for _ in range(200))) for i in range(300)]
    docs = [(i, " ".join(f"d{rng.randrange(50)}" for _ in range(100)) + " " + " ".join(items[i * 7][1].split()[20 : 20 + 10 + i])) for i in range(20)]
    found, names = decontaminate.find_contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {r["doc_id"]: r[names["items"]] for r in found.collect()} == {i: [str(i * 7)] if i >= 3 else [] for i in range(20)}
