"""Scans over keys that fill many ranges, the sphere index and shared arcs, against plain Python."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import nearest, segments
from tessera.sources import documents, shared_arcs, topology
from tessera.streaming import telemetry


@pytest.fixture(scope="module")
def events(spark):
    """A hot key, some small ones and the null key, with pauses and bursts; values with nulls."""
    r = random.Random(3)
    rows, t = [], 0.0
    for i in range(3000):
        t += r.choice([0.0, 1.0, 5.0, 20.0, 400.0]) if i % 7 else 0.0
        rows.append((r.choice(["hot"] * 12 + ["a", "b", "c", None]), t, i, r.choice([None, 1, 2, 3]), r.choice(["down", "up", "move"])))
    return spark.createDataFrame(rows, "k string, t double, id long, v int, kind string").repartition(5)


def by_key(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r.t, r.id)):
        out.setdefault(r.k, []).append(r)
    return out


def hot_is_spread(df, parts):
    sizes = segments.dealt(df, "k", ["t", "id"], parts).groupBy("__part").count().collect()
    assert max(r["count"] for r in sizes) < 4 * 3000 / parts


@pytest.mark.parametrize("parts", [1, 3, 40])
def test_scans(events, parts):
    hot_is_spread(events, 20)
    sums, changes, downs = {}, set(), {}
    for rows in by_key(events.collect()).values():
        total, last, down = None, "none", None
        for r in rows:
            total = r.v if total is None else total + (r.v or 0)
            sums[r.id], downs[r.id] = total, down
            if r.v != last:
                changes.add(r.id)
            last = r.v
            down = r.id if r.kind == "down" else down
    assert {r.id: r.running for r in segments.running_sum(events, "k", ["t", "id"], F.col("v"), parts).collect()} == sums
    assert {r.id for r in segments.changes_only(events, "k", ["t", "id"], F.col("v"), parts).collect()} == changes
    assert {r.id: r.d for r in segments.last_before(events, "k", ["t", "id"], F.when(F.col("kind") == "down", F.col("id")), "d", parts).collect()} == downs
    none = events.where("id < 0")
    assert segments.running_sum(none, "k", ["t", "id"], F.col("v"), parts).count() == segments.changes_only(none, "k", ["t"], F.col("v"), parts).count() == 0


def chain(rows, width):
    out, last, n = [], None, 0
    for r in rows:
        n += 1
        if last is None or r.t - last >= width:
            out.append((r.id, last, None if last is None else n))
            last, n = r.t, 0
    return out


@pytest.mark.parametrize("parts, width", [(1, 150.0), (40, 150.0), (40, 3.0), (7, 20_000.0), (64, 1e9)])
def test_spaced_runs(events, parts, width):
    expected = sorted(x for rows in by_key(events.collect()).values() for x in chain(rows, width))
    assert sorted((r.id, r.since, r.rows_since) for r in segments.spaced_runs(events, "k", "t", width, ["id"], parts).collect()) == expected
    assert segments.spaced_runs(events.where("id < 0"), "k", "t", width, ["id"], parts).count() == 0


def test_closing_windows(events):
    got = telemetry.closing_windows(events, "k", "t", 500.0).where("k = 'hot'").collect()
    rows = by_key(events.collect())["hot"]
    assert sorted((r.closed, r.n) for r in got) == sorted((next(x.t for x in rows if x.id == i), n) for i, last, n in chain(rows, 500.0) if last is not None)
    assert all(r.rate == math.floor(r.n * 1000 / (r.closed - r.opened) + 0.5) and r.closed - r.opened >= 500 for r in got)


def test_numbers(events):
    got = segments.numbered(events, ["t", "id"], "n", 9).collect()
    assert [r.id for r in sorted(got, key=lambda r: r.n)] == [r.id for r in sorted(got, key=lambda r: (r.t, r.id))] and sorted(r.n for r in got) == list(range(3000))


def brute_nearest(origins, places):
    """As the rule states it: bearing and great-circle distance of every pair."""
    out = {}
    for o, lat, lng, target in origins:
        best = None
        for i, b, c, ord_ in places:
            if b is None or (b, c) == (lat, lng):
                continue
            p, q, d = math.radians(lat), math.radians(b), math.radians(c - lng)
            off = (math.atan2(math.sin(d) * math.cos(q), math.cos(p) * math.sin(q) - math.sin(p) * math.cos(q) * math.cos(d)) - target) % (2 * math.pi)
            if min(off, 2 * math.pi - off) >= math.pi / 2:
                continue
            h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(d / 2) ** 2
            key = (round(2 * math.atan2(math.sqrt(h), math.sqrt(max(0, 1 - h))), 9), ord_, i)
            best = min(best or key, key)
        if best:
            out[o] = best
    return out


def test_nearest_places(spark):
    r = random.Random(9)
    spread = [(i, r.uniform(-89, 89), r.uniform(-180, 180), i % 50) for i in range(300)]
    crowd = [(1000 + i, 40 + r.gauss(0, 1e-3), 20 + r.gauss(0, 1e-3), i) for i in range(300)]
    spot = [(2000 + i, 40.0, 20.0, 500 - i) for i in range(200)]
    ends = [(3000, 90.0, 0.0, 1), (3001, -90.0, 0.0, 1), (3002, 0.0, 180.0, 1), (3003, 0.0, -180.0, 1), (3004, None, 1.0, 1)]
    places = spread + crowd + spot + ends
    origins = [(i, a, b, (i % 8) * math.pi / 4) for i, a, b, _ in places if a is not None] + [(9000 + k, 40.0, 20.0, k * math.pi / 2) for k in range(4)]
    got = nearest.nearest_places(spark.createDataFrame(origins, "id long, lat double, lng double, target double"), spark.createDataFrame(places, "id long, lat double, lng double, ord long")).collect()
    expected = brute_nearest(origins, places)
    assert len(got) == len(expected)
    for g in got:
        assert abs(g.distance - expected[g.origin][0]) < 2e-9, g


def test_nearest_without_answer(spark):
    """On the equator nothing lies north; boxes rule all of it out."""
    line = spark.range(500).select("id", F.lit(0.0).alias("lat"), (F.col("id") / 10).alias("lng"), "id", F.col("id").alias("ord"))
    line = line.toDF("id", "lat", "lng", "x", "ord").drop("x")
    assert nearest.nearest_places(line.withColumn("target", F.lit(0.0)), line).count() == 0
    east = nearest.nearest_places(line.withColumn("target", F.lit(math.pi / 2)), line).collect()
    assert {r.origin: r.id for r in east} == {i: i + 1 for i in range(499)}
    assert nearest.nearest_places(line.where("id < 0").withColumn("target", F.lit(0.0)), line).count() == 0
    assert nearest.nearest_places(line.withColumn("target", F.lit(0.0)), line.where("id < 0")).count() == 0


def ring(*points):
    return [(float(x), float(y)) for x, y in points] + [(float(points[0][0]), float(points[0][1]))]


FEATURES = [
    ("left", [[ring((0, 0), (2, 0), (2, 1), (2, 2), (0, 2))]]),
    ("right", [[ring((2, 0), (4, 0), (4, 2), (2, 2), (2, 1))]]),
    ("around", [[ring((10, 0), (20, 0), (20, 10), (10, 10)), ring((12, 2), (12, 4), (14, 4), (14, 2))], [ring((30, 30), (31, 30), (31, 31))]]),
    ("enclave", [[ring((14, 4), (12, 4), (12, 2), (14, 2))]]),
    ("twice", [[ring((30, 30), (30, 30), (31, 30), (31, 31))], [ring((50, 0), (52, 0), (51, 1), (52, 2), (50, 2), (51, 1))]]),
    ("none", None),
    ("empty", [[[]]]),
    ("point", [[[(7.0, 7.0)]]]),
]


def turned(points):
    """The ring's vertices from the least on, closed or not, without repeats."""
    p = [x for x, y in zip(points, points[1:] + [None], strict=True) if x != y]
    p = p[:-1] if len(p) > 1 and p[0] == p[-1] else p
    return min(tuple(p[i:] + p[:i]) for i in range(len(p)))


@pytest.fixture(scope="module")
def features(spark):
    return spark.createDataFrame([(i, p, f"the \"{i}\"") for i, p in FEATURES], "id string, polygons array<array<array<struct<lng:double,lat:double>>>>, name string")


def test_shared_arcs(features):
    arcs, refs = shared_arcs.shared_arcs(features)
    lines = {r.arc: r for r in arcs.collect()}
    assert sorted(lines) == list(range(len(lines)))
    shared = {tuple(tuple(p) for p in r.points) for r in lines.values() if r.users > 1}
    assert ((2.0, 0.0), (2.0, 1.0), (2.0, 2.0)) in shared and len(shared) == 3  # the border, the enclave's and the ring that two features have
    sides = [frozenset(x) for r in lines.values() for x in zip([tuple(p) for p in r.points], [tuple(p) for p in r.points][1:], strict=False)]
    assert len(sides) == len(set(sides))  # each side once
    assert sorted({r.feature for r in refs.collect()}) == sorted(i for i, p in FEATURES if i not in ("none", "empty"))


def test_topology_file(spark, features, tmp_path):
    path = str(tmp_path / "t.json")
    shared_arcs.write_topology(features, path, "lands", properties=["name"], quantile=None, steps=52 * 31 + 1)
    assert json.load(open(path))["type"] == "Topology" and [p.name for p in tmp_path.iterdir()] == ["t.json"]
    back = {r.id: r for r in topology.read_features(spark, path, "lands", "name string").collect()}
    assert set(back) == {i for i, _ in FEATURES} and back["left"].name == 'the "left"' and back["none"].polygons is None
    for i, polygons in FEATURES:
        if i in ("none", "empty", "point"):
            continue
        got = [[turned([(round(p.lng, 6), round(p.lat, 6)) for p in r]) for r in polygon] for polygon in back[i].polygons]
        assert got == [[turned(r) for r in polygon] for polygon in polygons], i


def test_simplified_topology_keeps_borders_together(spark, tmp_path):
    """Neighbours with a ragged border lose the same points."""
    border = [(0.0 if y % 2 else 0.01, float(y)) for y in range(41)]
    left, right = [[(-30.0, 40.0), (-30.0, 0.0), *border, (-30.0, 40.0)]], [[*border[::-1], (30.0, 0.0), (30.0, 40.0), border[-1]]]
    df = spark.createDataFrame([("l", [left]), ("r", [right])], "id string, polygons array<array<array<struct<lng:double,lat:double>>>>")
    shared_arcs.write_topology(df, str(tmp_path / "t.json"), "x", quantile=0.5)
    rows = {r.id: {(round(p.lng, 9), round(p.lat, 9)) for p in r.polygons[0][0]} for r in topology.read_features(spark, str(tmp_path / "t.json"), "x", "y string").collect()}
    common = {p for p in rows["l"] if abs(p[0]) < 1}
    assert common == {p for p in rows["r"] if abs(p[0]) < 1} and 10 < len(common) < 35


def test_documents(spark, tmp_path):
    points = spark.range(300).select(F.col("id"), (F.col("id") % 7 + 0.5).alias("lng"), F.lit(1.0).alias("lat"), F.concat(F.lit("a|\"b\"\n"), F.col("id").cast("string")).alias("name"), (1000 - F.col("id")).alias("ord")).repartition(9)
    documents.write_feature_collection(points, str(tmp_path / "f.json"), "ord", ["name"])
    got = json.load(open(tmp_path / "f.json"))
    assert got["type"] == "FeatureCollection" and [f["id"] for f in got["features"]] == list(range(299, -1, -1)) and got["features"][0]["properties"]["name"] == 'a|"b"\n299'
    documents.write_feature_collection(points.where("id < 0"), str(tmp_path / "f.json"), "ord", ["name"])
    assert json.load(open(tmp_path / "f.json"))["features"] == []
    documents.write_register(points, str(tmp_path / "r.md"), "Places", "id", ["id", "name"])
    lines = (tmp_path / "r.md").read_text().split("\n")
    assert lines[0] == "# Places: 300 rows" and len(lines) == 305 and lines[4] == '| 0 | a\\|"b" 0 |'


def test_failed_document_leaves_nothing(spark, tmp_path):
    (tmp_path / "f.json").write_text("old")
    bad = spark.range(100).select(F.lit(0).alias("section"), F.col("id").alias("ordinal"), F.when(F.col("id") == 77, F.raise_error(F.lit("broken")).cast("string")).otherwise("x").alias("line"))
    with pytest.raises(Exception, match="broken"):
        documents.write_document(bad, str(tmp_path / "f.json"), ["["], "]")
    assert [p.name for p in tmp_path.iterdir()] == ["f.json"] and (tmp_path / "f.json").read_text() == "old"
