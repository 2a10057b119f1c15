"""Sharding by a permutation of row numbers, and fill-in-middle by units, against plain Python."""

import re
import zlib
from hashlib import sha256

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.llm import feistel_shards, fill_middle

HARD = [(None, "null id"), (1, None), (2, ""), (3, "word 🙂 é\n" * 20_000), (3, "word 🙂 é\n" * 20_000), (3, "other"), (4, "has <S> inside"), (5, "a<"), (6, "<<P<"), (7, "a\u0000b\r\n")]


@pytest.fixture(scope="module")
def hard(spark):
    more = [(i, f"text {i}, {'x1 ' * (i % 7)}<{i}") for i in range(100, 400)]
    return spark.createDataFrame(HARD + more + [(9, "copy")] * 50, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("shard", "slot", "place", "part", "row_number", "key_a", "n")})


@given(st.integers(1, 5000), st.integers(0, 99))
@settings(max_examples=40, deadline=None)
def test_permutation(rows, seed):
    p = feistel_shards.RowPermutation(rows, seed)
    places = p.place_of(np.arange(rows))
    assert sorted(places) == list(range(rows)) and (p.row_at(places) == np.arange(rows)).all()
    shard, slot = p.shard_and_slot(np.arange(rows), 7)
    assert (p.row_of(shard, slot, 7) == np.arange(rows)).all()


def test_large_numbers():
    p = feistel_shards.RowPermutation(10**14 + 7)
    rows = np.array([0, 1, 10**14 + 6, 12345678901234])
    assert (p.row_at(p.place_of(rows)) == rows).all()
    with pytest.raises(ValueError):
        p.place_of(np.array([10**14 + 7]))


def test_mixes():
    """Neighbouring numbers part: no more neighbours stay neighbours than in a random order, and seeds differ."""
    p = feistel_shards.RowPermutation(20_000)
    places = p.place_of(np.arange(20_000))
    assert (np.abs(np.diff(places)) == 1).sum() < 12
    assert abs(np.corrcoef(np.arange(20_000), places)[0, 1]) < 0.03
    assert (places == feistel_shards.RowPermutation(20_000, 1).place_of(np.arange(20_000))).sum() < 12


def brute_shards(rows, shards=16):
    rows = sorted(((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1:]))
    shard, slot = feistel_shards.RowPermutation(len(rows)).shard_and_slot(np.arange(len(rows)), shards)
    return sorted(((*r, int(a), int(b)) for r, a, b in zip(rows, shard, slot, strict=True)), key=str)


@pytest.mark.parametrize("parts", [1, 13])
def test_shards(hard, parts):
    got = feistel_shards.op11_feistel_shards(hard.repartition(parts)).collect()
    rows = [(r["doc_id"], r["text"]) for r in hard.collect()]
    assert sorted(((r["doc_id"], r["size"], r["text_crc32"], r["shard"], r["slot"]) for r in got), key=str) == brute_shards(rows)
    counts = {}
    for r in got:
        counts.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in counts.values())
    assert max(map(len, counts.values())) - min(map(len, counts.values())) <= 1
    assert {(r["law"], r["grown_shard"]) for r in got} == {("rows", None)}


def test_shards_of_few_rows(hard):
    assert feistel_shards.op11_feistel_shards(hard.where("doc_id = -1")).count() == 0
    assert [(r["shard"], r["slot"]) for r in feistel_shards.op11_feistel_shards(hard.where("doc_id = 2")).collect()] == [(0, 0)]


def test_written_shards(spark, hard, tmp_path):
    dealt, shard, slot = feistel_shards.shuffled_shards(hard, ["doc_id", "text"], shards=4)
    assert {"shard", "slot"}.isdisjoint({shard, slot}) and set(hard.columns) <= set(dealt.columns)
    feistel_shards.write_shards(dealt.select("doc_id", F.col(shard).alias("s"), F.col(slot).alias("at")), str(tmp_path / "out"), "s", "at", rows_per_file=20)
    back = spark.read.parquet(str(tmp_path / "out")).withColumn("file", F.input_file_name())
    assert back.count() == hard.count() and back.groupBy("file").count().agg(F.max("count")).first()[0] <= 20


def brute_middle(doc_id, text):
    text, digest = text or "", sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    units, h = re.findall(r"[A-Za-z]+|[^A-Za-z]", text), [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    hashed = lambda x: sha256(x.encode()).hexdigest()
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return doc_id, n, "plain", None, None, hashed(text), hashed(text)
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    spm = h[3] % 100 < 20
    return doc_id, n, "spm" if spm else "psm", len(p), len(m), hashed(f"<S>{s}<P>{p}<M>{m}" if spm else f"<P>{p}<S>{s}<M>{m}"), hashed(text)


def test_middles(hard):
    rows = [(r["doc_id"], r["text"]) for r in hard.collect()]
    got = fill_middle.op12_relational_units(hard).collect()
    assert sorted(map(tuple, got), key=str) == sorted((brute_middle(*r) for r in rows), key=str)
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}
    assert fill_middle.op12_relational_units(hard.where("doc_id = -1")).count() == 0


def test_middles_copies(hard):
    got = {r["id"]: r for r in fill_middle.fill_middle(hard.where("doc_id IN (4, 9)"), rate=100, suffix_first=100).collect()}
    assert got[9]["copies"] == 50 and got[9]["form"] == "spm" and got[4]["output"] == "has <S> inside"


def test_sentinels_beside_cuts(spark):
    """Texts full of sentinel pieces are restored wherever they are cut."""
    df = spark.createDataFrame([(i, t) for i, t in enumerate(["<<", "<P<", "P>", "<S", ">M>", "<M<", "<P", "S>x"] * 40)], "doc_id long, text string")
    cut = fill_middle.fill_middle(df, rate=100).withColumn("back", fill_middle.restored(F.col("output"), F.col("form")))
    assert cut.where("back <> text OR form = 'plain'").count() == 0
