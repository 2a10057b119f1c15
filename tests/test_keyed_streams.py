"""Streams with timers and generations: late and idle keys, restarts, and agreement with the batch forms."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.streaming import generations, telemetry, timers


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, timers.PROVIDER)
    yield spark
    spark.conf.set(name, before)


def streamed(spark, tmp_path, make, batches, schema):
    """What a stream gives for batches that arrive one after the other, each in a run of its own."""
    for batch in batches:
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        q = make(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        assert q.awaitTermination(240) and q.exception() is None
    return sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect()))


def test_throttle_stream(rocks, tmp_path):
    """a: held and released by a later event; b: falls idle and is released by the watermark; c: an old event changes nothing."""
    batches = [
        [("a", 1000, "a1"), ("a", 1050, "a2"), ("a", 1100, "a3"), ("b", 1000, "b1"), ("b", 1149, "b2"), ("c", 2000, "c1")],
        [("a", 1400, "a4"), ("c", 1900, "c0"), ("c", 2150, "c2")],
        [("x", 60_000, "x1")],
        [("x", 120_000, "x2"), ("b", 3, "too late")],
    ]
    got = streamed(rocks, tmp_path, lambda e: timers.throttle_stream(e, late="2 seconds"), batches, "key string, t long, value string")
    assert got == [("a", 1000.0, "a1", False), ("a", 1100.0, "a3", True), ("a", 1400.0, "a4", False), ("b", 1000.0, "b1", False), ("b", 1149.0, "b2", True), ("c", 2000.0, "c1", False), ("c", 2150.0, "c2", False), ("x", 60000.0, "x1", False), ("x", 120000.0, "x2", False)]


def test_window_stream_agrees_with_batch(rocks, tmp_path):
    r, rows, t = random.Random(4), [], 0.0
    for _ in range(400):
        t += r.choice([1.0, 30.0, 90.0, 700.0])
        rows.append((r.choice("aab"), t))
    got = streamed(rocks, tmp_path, timers.closing_windows_stream, [rows[:130], rows[130:131], rows[131:]], "key string, t double")
    batch = telemetry.closing_windows(rocks.createDataFrame(rows, "key string, t double"), "key", "t", 500.0)
    assert got == sorted(map(tuple, batch.collect())) and len(got) > 20


SCHEMA = "key string, generation long, id long"


def test_generations(spark, tmp_path):
    """Chunks of ten; the sink dies in the middle and starts again; then a new generation cancels the old one's rest."""
    source, out, cp = (str(tmp_path / x) for x in ("in", "out", "cp"))
    old = spark.range(45).select(F.lit("k").alias("key"), F.lit(1).cast("long").alias("generation"), "id").coalesce(1)
    generations.write_chunks(old, source, ["id"], 10)
    seen = []

    def failing(rows, number):
        rows.write.mode("overwrite").parquet(f"{out}/trigger={number}")
        seen.append(rows.count())
        if number == 2:
            raise RuntimeError("lost")

    stream = generations.not_cancelled(generations.chunk_stream(spark, source, SCHEMA), "key")
    q = stream.writeStream.foreachBatch(failing).option("checkpointLocation", cp).trigger(availableNow=True).start()
    with pytest.raises(Exception, match="lost"):
        q.awaitTermination(240)
    assert max(seen) <= 10 and sorted(r.id for r in generations.shown(spark, out, SCHEMA, "key").collect()) != list(range(45))
    assert generations.start_sink(generations.not_cancelled(generations.chunk_stream(spark, source, SCHEMA), "key"), out, cp).awaitTermination(240)
    assert sorted(r.id for r in generations.shown(spark, out, SCHEMA, "key").collect()) == list(range(45))
    new = spark.createDataFrame([("k", 2, 100), ("k", 1, 50), ("other", 1, 7), (None, None, 8)], SCHEMA).coalesce(1)
    generations.write_chunks(new, source, ["id"], 10)
    assert generations.start_sink(generations.not_cancelled(generations.chunk_stream(spark, source, SCHEMA), "key"), out, cp).awaitTermination(240)
    assert sorted((r.key or "", r.id) for r in generations.shown(spark, out, SCHEMA, "key").collect()) == [("", 8), ("k", 100), ("other", 7)]
    every = spark.read.parquet(f"{out}/trigger=*")
    assert every.where("id = 50").count() == 0 and every.where("key = 'k' AND generation = 1").count() == 45


def test_nothing_shown_yet(spark, tmp_path):
    assert generations.shown(spark, str(tmp_path / "none"), SCHEMA, "key").count() == 0
