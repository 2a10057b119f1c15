import math
from bisect import bisect_left

import pytest
from pyspark.sql import functions as F

from tessera.functions import geo, text
from tessera.operators import placement, ranking, relations, resolve, rings, scoring
from tessera.sources import files
from tessera.streaming import telemetry


def test_percentile_ties_and_single(spark):
    df = spark.createDataFrame([(1, 1.0), (2, 2.0), (3, 2.0), (4, 5.0), (5, None)], "id int, v double")
    got = {r.id: r.p for r in scoring.percentile(df, {"v": "p"}).collect()}
    assert got == {1: 0.0, 2: 50.0, 3: 50.0, 4: 100.0, 5: None}
    assert scoring.percentile(df.where("id = 1"), {"v": "p"}).first()["p"] == 100.0
    assert scoring.percentile(df.where("id = 9"), {"v": "p"}).count() == 0


def test_percentiles_of_frequent_and_missing_values(spark):
    """One value in two thirds of the rows, nulls in a third of another column, repeated rows, against counting."""
    rows = [(i, 7.0 if i % 3 else float(i * 37 % 101), None if i % 3 == 0 else float(i % 250)) for i in range(3000)] * 2
    got = scoring.percentile(spark.createDataFrame(rows, "id int, v double, w double"), {"v": "p", "w": "q"}).collect()
    assert len(got) == 6000 and got[0].__fields__ == ["id", "v", "w", "p", "q"]
    for raw, new in (("v", "p"), ("w", "q")):
        values = sorted(r[raw] for r in got if r[raw] is not None)
        want = {x: (bisect_left(values, x) + (values.count(x) - 1) / 2) / (len(values) - 1) * 100 for x in set(values)}
        assert all(r[new] is None if r[raw] is None else r[new] == pytest.approx(want[r[raw]]) for r in got)


def test_percentiles_shuffle_once_for_all_columns(spark):
    """The plan does not grow with the columns, and no value that holds many rows is a key of a shuffled join."""
    df = spark.range(1000).selectExpr("id", "id % 7 a", "id % 3 b", "id % 11 c", "id d")
    plans = [scoring.percentile(df, {c: f"{c}_p" for c in cols})._jdf.queryExecution().executedPlan().toString() for cols in ("a", "abcd")]
    assert plans[0].count("Exchange") == plans[1].count("Exchange")


def test_log_minmax(spark):
    df = spark.createDataFrame([(1, 0.0), (2, 10.0), (3, 1000.0), (4, None)], "id int, v double")
    got = {r.id: r.p for r in scoring.log_minmax(df, {"v": "p"}).collect()}
    assert got[1] == 0 and got[3] == pytest.approx(100) and got[4] is None
    assert got[2] == pytest.approx(100 * (math.log(10.1) - math.log(0.1)) / (math.log(1000.1) - math.log(0.1)))


def test_confirmed_rows_and_floor(spark):
    df = spark.createDataFrame([(1, 1.0, 2.0), (2, None, None), (3, 5.0, None)], "id int, a double, b double")
    parts = [scoring.Component("a", "a"), scoring.Component("b", "b")]
    got = {r.id: (r.score, r.tier) for r in scoring.composite_score(df, parts, 2, 2, 1, confirmed=F.col("id") == 3).collect()}
    assert got == {1: (50.0, "measured"), 2: (None, "unavailable"), 3: (0.0, "measured")}


def test_sort_rules(spark):
    df = spark.createDataFrame([("b", None, 1.0), ("a", 2.0, None), ("c", 3.0, 0.0)], "name string, score double, part double")
    order = lambda *a: [r.name for r in df.orderBy(*ranking.sort_keys(*a)).collect()]
    assert order("part", True) == ["b", "c", "a"] and order("part", False) == ["c", "b", "a"]
    assert order("score", True) == ["c", "a", "b"] and order("score", False) == ["b", "a", "c"]
    assert ranking.sort_state(("score", True), "name") == ("name", False)
    assert ranking.next_category(list("abcdefg"), None, -1) == "f" and ranking.next_category(list("abcdefg"), None, 1) == "a"


def test_whole_table_ranking_by_ranges(spark):
    df = spark.createDataFrame([(i, float(i * 7919 % 211), chr(97 + i % 5)) for i in range(1000)], "id int, score double, name string")
    got = sorted(ranking.ranked(df, "score", tie=["id"], parts=7).collect(), key=lambda r: r.position)
    assert [r.id for r in got] == [r.id for r in df.orderBy(F.desc("score"), "name", "id").collect()] and [r.position for r in got] == list(range(1, 1001))
    assert ranking.ranked(df.where("id < 0"), "score").count() == 0
    accents = spark.createDataFrame([("z",), ("é",), ("a",), ("É",), ("f",)], "name string").withColumn("score", F.lit(1.0))
    assert [r.name for r in sorted(ranking.ranked(accents, "name", False).collect(), key=lambda r: r.position)] == ["a", "é", "É", "f", "z"]


def test_buffers_and_long_rings(spark):
    rows = spark.createDataFrame([(i, i % 5, i % 3) for i in range(500)], "id int, vertices int, faces int")
    got = sorted(rings.buffer_offsets(rows, None, "id", "vertices", "faces", parts=6).collect(), key=lambda r: r.id)
    total = 0
    for r in got:
        assert r.vertices_start == total
        total += r.vertices
    line = [(float(i % 360 - 180), 0.0) for i in range(9000)]
    ring = spark.createDataFrame([(line,)], "r array<struct<lng:double,lat:double>>")
    lngs = [p.lng for p in ring.select(geo.unwrap_ring(F.col("r")).alias("u")).first().u]
    assert lngs == [float(i - 180) for i in range(9000)]


def test_checkpoint_folder_of_a_cluster_must_be_named(spark):
    from types import SimpleNamespace

    from tessera.operators import steps

    none = SimpleNamespace(get=lambda k: None)
    sc = SimpleNamespace(getConf=lambda: none, master="spark://x", _jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: SimpleNamespace(isEmpty=lambda: True))))
    with pytest.raises(ValueError):
        steps.written(SimpleNamespace(sparkSession=SimpleNamespace(sparkContext=sc)))


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([("a", "TX", 1.0, 2.0, "measured"), ("b", "tx", 3.0, 4.0, "unavailable"), ("c", "NY", 5.0, 6.0, "proxy")], "id string, state string, lng double, lat double, tier string")
    files.write_shards(df, f"{tmp_path}/s", "state")
    assert sorted(p.name for p in (tmp_path / "s").iterdir() if p.is_dir()) == ["state=ny", "state=tx"]
    assert spark.read.parquet(f"{tmp_path}/s").where("state = 'tx'").count() == 2
    files.write_features(df, f"{tmp_path}/f", ["state"])
    assert spark.read.json(f"{tmp_path}/f").select("geometry.coordinates").where("id = 'c'").first()[0] == [5.0, 6.0]
    files.write_scores(df, f"{tmp_path}/w", "id")
    assert spark.read.json(f"{tmp_path}/w").where("id = 'a'").first()["value"]["lat"] == 2.0
    assert sorted(r.id for r in files.component_dump(df, "id", ["lng"]).collect()) == ["a", "c"]
    assert files.gap_report(df.where("id = 'a'"), df.where("id = 'b'")).groupBy("section").count().count() == 2
    assert files.register_lines(df, "Places", ["id", "state"]).where("section = 0").first()["line"] == "# Places: 3 rows"
    (tmp_path / "x.csv").write_text('h,v\n"a,1\n')
    assert tuple(files.plain_csv(spark, str(tmp_path / "x.csv"), "h string, v int").first()) == ('"a', 1)
    paths = spark.createDataFrame([("factbook/north/aa.json",), ("readme",)], "path string")
    assert [(r.folder, r.code) for r in files.tree_codes(paths, r"factbook/(\w+)/(\w+)\.json").collect()] == [("north", "aa")]


def test_null_first_cells_stay(spark):
    csv = spark.sql("SELECT base64(encode('h,v\na,1\n Total ,2\n,3\n', 'UTF-8')) AS c")
    assert [tuple(r) for r in files.embedded_csv(csv, "c", ["h", "v"], ("Total",)).collect()] == [("a", "1"), ("", "3")]


def test_near_names_across_cells(spark):
    left = spark.createDataFrame([(1, "A, x", 0.49, 0.49), (2, "a", 10.0, 10.0), (3, "b", 0.5, 0.5), (4, "A", -0.1, 179.9)], "id int, name string, lat double, lng double")
    right = spark.createDataFrame([("a", 0.51, 0.51), ("a", 10.0, 10.5), ("B", 1.1, 0.5)], "name string, lat double, lng double")
    assert sorted(r.id for r in resolve.same_name_nearby(left, right, text.base_name).collect()) == [2, 3, 4]


def test_near_names_are_not_broadcast(spark, tmp_path):
    """Copies of a place are filed once; a small file of places, nine rows each, never goes to the driver."""
    spark.range(5000).selectExpr("int(id) AS id", "'a, x' AS name", "id % 40 / 4.0D AS lat", "0.1D AS lng").write.parquet(f"{tmp_path}/left")
    spark.range(5000).selectExpr("'A' AS name", "id % 10 / 4.0D AS lat", "0.1D AS lng").write.parquet(f"{tmp_path}/right")
    left, right = (spark.read.parquet(f"{tmp_path}/{side}") for side in ("left", "right"))
    found = resolve.same_name_nearby(left, right, text.base_name, 0.25)
    assert sorted(r.id for r in found.collect()) == [i for i in range(5000) if i % 40 >= 10]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastExchange" not in plan
    assert plan.index("Generate explode") < plan.index("HashAggregate")  # the copies go before the cells come


def test_checks(spark):
    df = spark.createDataFrame([(1,), (1,)], "id int")
    with pytest.raises(ValueError):
        resolve.assert_unique(df, ["id"])
    with pytest.raises(ValueError):
        resolve.assert_count(df, 3)
    with pytest.raises(ValueError):
        resolve.assert_all_match(df, spark.createDataFrame([(2,)], "id int"), ["id"])


def test_checks_do_not_repeat_the_work_before_them(spark):
    """What is checked is read from where it was written, by the check and by what follows it."""
    seen = spark.sparkContext.accumulator(0)

    def note(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    df = spark.range(40).withColumn("k", F.col("id") % 40).mapInArrow(note, "id long, k long")
    checked = resolve.assert_all_match(resolve.assert_count(resolve.assert_unique(df, ["k"]), 40), spark.range(40).toDF("k"), ["k"])
    assert checked.count() == 40 and seen.value == 40


def test_greedy(spark):
    rows = [("v", 1, 0.0, 0.0, None), ("v", 2, 5.0, 0.0, None), ("v", 3, 10.0, 0.0, None), ("v", 4, 30.0, 0.0, 15.0), ("v", 5, 90.0, 0.0, None)]
    df = spark.createDataFrame(rows, "view string, ord int, px double, py double, spacing double")
    assert sorted(r.ord for r in placement.greedy_labels(df, "view", "ord", 10.0, 9).collect()) == [1, 3, 4, 5]
    assert sorted(r.ord for r in placement.greedy_labels(df, "view", "ord", 10.0, 2).collect()) == [1, 3]


def test_segments(spark):
    df = spark.sql("SELECT 1 AS id, array(array(named_struct('lng', 0D, 'lat', 0D), named_struct('lng', 3D, 'lat', 0D), named_struct('lng', 4D, 'lat', 0D))) AS rings")
    got = rings.running_share(df, "id", "rings", lambda a, b: F.abs(a["lng"] - b["lng"])).orderBy("at").collect()
    assert [(r.from_share, r.to_share) for r in got] == [(0.0, 0.75), (0.75, 1.0)]
    assert rings.distinct_edges(rings.segments(df, "id", "rings")).count() == 2


def test_entities(spark):
    r = "struct<ref:struct<type:string,id:string>,displayName:string,extent:string,since:string>"
    row = ("a", "A", "territory", None, None, [(("geo-entity", "b"), "B", None, "1990-01"), (None, "C", None, None)], [])
    e = spark.createDataFrame([row, ("b", "B", "territory", None, [], [], None)], f"id string, name string, type string, parent {r}, administeredBy array<{r}>, claimedBy array<{r}>, claims array<{r}>")
    edge = relations.edges(e)
    assert edge.count() == 2
    assert [tuple(x) for x in relations.effective_claims(edge, e).collect()] == [("b", "A", False)]
    assert sorted(x.id for x in relations.disputed(e, relations.effective_claims(edge, e)).collect()) == ["a", "b"]
    assert sorted(map(tuple, relations.related(edge, e).collect())) == [("a", "b"), ("b", "a")]
    assert relations.touching(e, "geo-entity", "b").count() == 1


def test_sources(spark, tmp_path):
    (tmp_path / "f.json").write_text('{"features":[{"geometry":{"type":"Point","coordinates":[1,2]},"properties":{"name":"x"}}]}')
    got = files.feature_collection(spark, str(tmp_path / "f.json"), "name string", "array<double>").first()
    assert (got.id, got.coordinates, got.name) == ("feature-0", [1.0, 2.0], "x")
    csv = spark.sql("SELECT base64(encode('h,v\na,1\nTotal,2\n', 'UTF-8')) AS c")
    assert [tuple(r) for r in files.embedded_csv(csv, "c", ["h", "v"], ("Total",)).collect()] == [("a", "1")]
    bad = spark.createDataFrame([("nonsense",), ('{"a":true,"z":false}',)], "json string")
    assert [r.preset for r in files.presets(bad, known=["a"]).collect()] == [{}, {"a": True}]
    doc = tmp_path / "d.md"
    doc.write_text("# t\n\n## first\n")
    files.replace_marked(str(doc), "<b>", "<e>", "one")
    files.replace_marked(str(doc), "<b>", "<e>", "two")
    assert doc.read_text() == "# t\n\n<b>\ntwo\n<e>\n\n## first\n"


def test_flick_stream(spark, tmp_path):
    rows = [("p", 0.0, "down", 0.0), ("p", 10.0, "move", 20.0), ("p", 11.0, "up", 20.0), ("q", 0.0, "up", 1.0)]
    spark.createDataFrame(rows, "pointer string, t double, kind string, x double").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("pointer string, t double, kind string, x double").parquet(str(tmp_path / "in"))
    q = telemetry.flick_speeds(stream).writeStream.format("memory").queryName("flicks").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [(r.pointer, round(r.speed, 6)) for r in spark.table("flicks").collect()] == [("p", 1.8)]


def streamed(spark, tmp_path, name, make, rows, schema):
    """What a stream gives for the rows, dealt to two files in order of time."""
    for i, part in enumerate((rows[: len(rows) // 2], rows[len(rows) // 2 :])):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / name / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / name / "in"))
        q = make(stream).writeStream.format("parquet").option("path", str(tmp_path / name / "out")).option("checkpointLocation", str(tmp_path / name / "cp")).trigger(availableNow=True).start()
        q.awaitTermination(120)
    return sorted(map(tuple, spark.read.parquet(str(tmp_path / name / "out")).collect()))


def test_keyed_streams_keep_their_state(spark, tmp_path):
    levels = [("a", 1.0, "x"), ("a", 2.0, "x"), ("b", 1.0, "x"), ("a", 3.0, "x"), ("a", 4.0, "y"), ("b", 2.0, "x")]
    assert streamed(spark, tmp_path, "changes", telemetry.changes_stream, levels, "key string, t double, value string") == [("a", 1.0, "x"), ("a", 4.0, "y"), ("b", 1.0, "x")]
    keys = [("s", 1.0, "down", "a"), ("s", 2.0, "down", "b"), ("s", 3.0, "down", "a"), ("s", 4.0, "up", "a"), ("s", 5.0, "blur", None), ("s", 6.0, "up", "b")]
    assert streamed(spark, tmp_path, "held", telemetry.held_keys_stream, keys, "session string, t double, kind string, key string") == [("s", 1.0, "a"), ("s", 2.0, "a,b"), ("s", 4.0, "b"), ("s", 5.0, "")]
    moves = [("p", 0.0, "up", 9.0, 9.0), ("p", 1.0, "down", 0.0, 0.0), ("p", 2.0, "up", 3.0, 4.0), ("p", 3.0, "up", 3.0, 3.0)]
    assert streamed(spark, tmp_path, "clicks", lambda e: telemetry.clicks_stream(e, 5.0), moves, "pointer string, t double, kind string, x double, y double") == [("p", 2.0, False), ("p", 3.0, True)]
    log = telemetry.command_log(spark.createDataFrame([("s", 1, "go"), ("s", 2, "go"), ("t", 1, "go")], "session string, t int, command string"), "session", ["t"])
    assert sorted((r.session, r.seq) for r in log.collect()) == [("s", 1), ("s", 2), ("t", 1)]


def test_held_and_clicks(spark):
    keys = spark.createDataFrame([("s", 1, "down", "a"), ("s", 2, "down", "b"), ("s", 3, "up", "a"), ("t", 1, "down", "a"), ("t", 2, "blur", None)], "session string, t int, kind string, key string")
    assert [tuple(r) for r in telemetry.held_keys(keys, "session", ["t"]).collect()] == [("s", "b")]
    moves = spark.createDataFrame([("p", 1, "down", 0.0, 0.0), ("p", 2, "up", 1.0, 0.0), ("p", 3, "down", 0.0, 0.0), ("p", 4, "up", 9.0, 0.0)], "pointer string, t int, kind string, x double, y double")
    assert [r.click for r in telemetry.click_or_drag(moves, "pointer", 5.0).orderBy("t").collect()] == [True, False]
