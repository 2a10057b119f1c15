"""Triangles, shapefiles and API pages."""

import json
import math
import random
import struct
import threading
from collections import Counter
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import triangles
from tessera.sources import page_source, pages, shapefiles


def star(r, n, x=0.0, y=0.0, least=2.0, most=10.0):
    return [(x + (d := r.uniform(least, most)) * math.cos(a), y + d * math.sin(a)) for a in (2 * math.pi * i / n for i in range(n))]


def area(ring):
    return abs(triangles._ring_area(ring))


def covered(found):
    return sum(triangles._twice_area(*t) / 2 for t in found)


@pytest.mark.parametrize("seed", range(12))
def test_ears(seed):
    """Ragged rings with holes beside and above each other, given either way round."""
    r = random.Random(seed)
    outer = star(r, r.randint(5, 60), least=6)
    holes = [star(r, r.randint(3, 9), x, y, 0.2, 0.9) for x in (-2.0, 0.0, 2.0) for y in (-2.0, 0.0, 2.0) if r.random() < 0.7]
    rings = [outer + outer[:1], *(h[:: r.choice([1, -1])] for h in holes)]
    found = triangles.ears(rings)
    assert all(triangles._twice_area(*t) > 0 for t in found)
    assert covered(found) == pytest.approx(area(outer) - sum(map(area, holes)), rel=1e-9)
    for t in found:
        middle = tuple(sum(p[k] for p in t) / 3 for k in (0, 1))
        assert not any(inside(h, middle) for h in holes) and inside(outer, middle)


def inside(ring, p):
    odd = False
    for a, b in zip(ring, ring[1:] + ring[:1], strict=True):
        if (a[1] > p[1]) != (b[1] > p[1]) and p[0] < a[0] + (p[1] - a[1]) / (b[1] - a[1]) * (b[0] - a[0]):
            odd = not odd
    return odd


def test_grid_of_holes():
    """Holes on common lines with common corners' heights, as in rasters."""
    outer = [(0.0, 0.0), (20.0, 0.0), (20.0, 20.0), (0.0, 20.0)]
    holes = [[(x, y), (x + 1, y), (x + 1, y + 1), (x, y + 1)] for x in (2.0, 6.0, 10.0, 14.0) for y in (2.0, 6.0, 10.0, 14.0)]
    assert covered(triangles.ears([outer, *holes])) == pytest.approx(400 - 16)


def test_degenerate():
    assert triangles.ears([]) == [] and triangles.ears([[(0.0, 0.0), (1.0, 1.0), (0.0, 0.0)]]) == [] and triangles.ears([[(0.0, 0.0), (1.0, 1.0), (2.0, 2.0), (0.0, 0.0)]]) == []
    assert covered(triangles.ears([[(0.0, 0.0), (1.0, 0.0), (1.0, 0.0), (2.0, 0.0), (2.0, 1.0), (0.0, 0.0)]])) == 1.0


def test_wide_triangles_are_halved():
    wide, small = ((0.0, 0.0), (60.0, 0.0), (30.0, 20.0)), ((0.0, 0.0), (1.0, 0.0), (0.5, 1.0))
    assert list(triangles.refined(small)) == [small]
    parts = list(triangles.refined(wide))
    assert len(parts) > 4 and all(triangles.sag(t) <= triangles.MOST_SAG for t in parts) and covered(parts) == pytest.approx(covered([wide]))
    assert len(list(triangles.refined(wide, most_depth=2))) == 4


def test_triangulated(spark):
    ring = [(170.0, 0.0), (-170.0, 0.0), (-170.0, 10.0), (170.0, 10.0), (170.0, 0.0)]
    hole = [(-179.0, 2.0), (-178.0, 2.0), (-178.0, 3.0), (-179.0, 3.0), (-179.0, 2.0)]
    df = spark.createDataFrame([(1, [[ring, hole]]), (2, None), (None, [[ring[:3]], [[]], []]), (4, [])], "id long, polygons array<array<array<struct<lng:double,lat:double>>>>")
    got = triangles.triangulated(df).collect()
    whole = sum(triangles._twice_area(r.a, r.b, r.c) / 2 for r in got if r.id == 1)
    assert whole == pytest.approx(200 - 1) and {r.id for r in got} == {1, None}
    assert sum(triangles._twice_area(r.a, r.b, r.c) / 2 for r in got if r.id is None) == pytest.approx(100)


def test_polygons_are_dealt_to_tasks(spark):
    """Polygons of one file are cut by many tasks, each one's triangles numbered from 0 also where more are found than are halved together."""
    r = random.Random(3)
    rings = [[star(r, n, least=6)] for n in (3 * triangles.TOGETHER, 5, 2 * triangles.TOGETHER, *[4] * 40)]
    df = spark.createDataFrame([(i, [ring]) for i, ring in enumerate(rings)], "id long, polygons array<array<array<struct<lng:double,lat:double>>>>").coalesce(1)
    got = triangles.triangulated(df).withColumn("task", F.spark_partition_id()).collect()
    assert len({x.task for x in got}) > 1
    for i, ring in enumerate(rings):
        mine = sorted((x for x in got if x.id == i), key=lambda x: x.at)
        assert [x.at for x in mine] == list(range(len(mine)))
        assert [tuple(map(tuple, (x.a, x.b, x.c))) for x in mine] == [t for ear in triangles.ears(ring) for t in triangles.refined(ear)]


def test_many_are_halved_as_each():
    several = [((0.0, 0.0), (60.0, 0.0), (30.0, 20.0)), ((0.0, 0.0), (1.0, 0.0), (0.5, 1.0)), ((5.0, 70.0), (50.0, 80.0), (0.0, 89.0))]
    parts, of = triangles.halved(np.array(several))
    assert [[tuple(map(tuple, t)) for t in parts[of == i].tolist()] for i in range(3)] == [list(triangles.refined(t)) for t in several]
    assert (triangles._sags(parts) <= triangles.MOST_SAG).all()


SHAPES = [
    (5, [[(0, 0), (0, 9), (9, 9), (9, 0), (0, 0)], [(1, 1), (2, 1), (2, 2), (1, 1)], [(20, 0), (20, 5), (25, 5), (20, 0)], [(21, 3), (22, 4), (21, 4), (21, 3)]], "lake é", "12.5", "T"),
    (0, [], "", "", "?"),
    (1, [[(3.5, -4.0)]], "point", "-1", "f"),
    (3, [[(0, 0), (1, 1)], [(5, 5), (6, 6), (7, 5)]], "line", "x", "N"),
]


def write_shapes(path, shapes, damaged=()):
    body, index, table = b"", b"", b""
    for i, (kind, parts, name, number, flag) in enumerate(shapes):
        flat = [c for p in parts for xy in p for c in xy]
        starts = [sum(len(p) for p in parts[:k]) for k in range(len(parts))]
        content = struct.pack("<i", kind if i not in damaged else 77)
        if kind == 1:
            content += struct.pack("<2d", *flat)
        elif kind:
            content += struct.pack("<4d2i", 0, 0, 0, 0, len(parts), len(flat) // 2) + struct.pack(f"<{len(parts)}i", *starts) + struct.pack(f"<{len(flat)}d", *flat)
        index += struct.pack(">2i", (100 + len(body)) // 2, len(content) // 2)
        body += struct.pack(">2i", i + 1, len(content) // 2) + content
        table += (b"*" if name == "line" else b" ") + name.encode().ljust(10)[:10] + number.encode().rjust(8)[:8] + flag.encode()[:1]
    columns = b"".join(n.ljust(11, b"\0") + k + b"\0" * 4 + bytes([w]) + b"\0" * 15 for n, k, w in ((b"NAME", b"C", 10), (b"TYPE", b"N", 8), (b"FLAG", b"L", 1)))
    (path / "s.shp").write_bytes(b"\0" * 100 + body)
    (path / "s.shx").write_bytes(b"\0" * 100 + index)
    (path / "s.dbf").write_bytes(struct.pack("<4BIHH20x", 3, 1, 1, 1, len(shapes), 32 + len(columns) + 1, 20) + columns + b"\r" + table)
    return str(path / "s.shp")


def test_shapefile(spark, tmp_path):
    rows = shapefiles.read_shapefile(spark, write_shapes(tmp_path, SHAPES), records_per_task=2).orderBy("record").collect()
    assert [(r.type, r.NAME, r.TYPE_, r.FLAG, r.deleted, r.error) for r in rows] == [("Polygon", "lake é", 12.5, True, False, None), (None, None, None, None, False, None), ("Point", "point", -1.0, False, False, None), ("LineString", "line", None, False, True, None)]
    assert [[len(ring) for ring in p] for p in rows[0].polygons] == [[5, 4], [4, 4]] and rows[1].polygons is None
    assert tuple(rows[2].polygons[0][0][0]) == (3.5, -4.0) and [len(p[0]) for p in rows[3].polygons] == [2, 3]


def test_large_shapefile(spark, tmp_path):
    many = [(1, [[(float(i), 1.0)]], f"n{i}", str(i), "T") for i in range(5000)]
    df = shapefiles.read_shapefile(spark, write_shapes(tmp_path, many, damaged={4321}), records_per_task=300)
    assert df.rdd.getNumPartitions() == 17 and df.agg(F.sum("TYPE_")).first()[0] == 4999 * 2500
    assert [(r.record, "77" in r.error) for r in df.where("error is not null").collect()] == [(4321, True)]
    assert df.where("polygons[0][0][0].lng <> TYPE_").count() == 0
    (tmp_path / "none").mkdir()
    assert shapefiles.read_shapefile(spark, write_shapes(tmp_path / "none", [])).count() == 0


@pytest.fixture
def server():
    asked = Counter()

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            asked[self.path] += 1
            if "BAD" in self.path or ("ONCE" in self.path and asked[self.path] == 1):
                self.send_error(503)
                return
            self.send_response(200)
            self.end_headers()
            self.wfile.write(json.dumps([{}, [{"countryiso3code": self.path.split("/")[2], "date": "2020", "value": 1.5}]]).encode())

        def log_message(self, *a):
            pass

    s = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}", asked
    s.shutdown()


def test_page_source(spark, server):
    base, asked = server
    df = page_source.read_pages(spark, base=base, codes=["AAA", "ONCE", "BAD", "DDD"], indicators=["G", "P"], first=2000, last=2024, pages_per_task=3)
    rows = sorted(df.collect(), key=lambda r: r.ord)
    assert [r.body is None for r in rows] == [False] * 4 + [True] * 2 + [False] * 2 and "503" in rows[4].error and max(asked.values()) == 2
    assert df.rdd.getNumPartitions() == 3 and [r.code for r in pages.indicator_rows(spark.createDataFrame(rows, df.schema)).orderBy("ord").collect()] == ["AAA", "AAA", "ONCE", "ONCE", "DDD", "DDD"]
    assert page_source.read_pages(spark, urls=[]).count() == 0


def test_lost_task_asks_for_its_own_pages(server):
    base, asked = server
    source = page_source.ApiPages({"urls": json.dumps([f"{base}/x/{i}" for i in range(10)]), "pages_per_task": "4"})
    reader = source.reader(None)
    parts = reader.partitions()
    assert [len(p.urls) for p in parts] == [4, 4, 2]
    for p in [*parts, parts[1]]:
        list(reader.read(p))
    assert sorted(asked.values()) == [1] * 6 + [2] * 4


def test_page_stream_goes_on_after_a_restart(spark, server, tmp_path):
    base, asked = server
    out = str(tmp_path / "out")

    def run(n, fails=False):
        def put(rows, number):
            rows.write.mode("overwrite").parquet(f"{out}/trigger={number}")
            if fails:
                raise RuntimeError("lost")

        stream = page_source.stream_pages(spark, urls=[f"{base}/x/{i}" for i in range(n)], pages_per_task=2)
        q = stream.writeStream.foreachBatch(put).option("checkpointLocation", str(tmp_path / "cp")).start()
        try:
            if fails:
                with pytest.raises(Exception, match="lost"):
                    q.awaitTermination(60)
            else:
                q.processAllAvailable()
        finally:
            q.stop()

    for n, fails in ((10, False), (23, True), (23, False), (35, False)):
        run(n, fails)
    rows = spark.read.parquet(out).orderBy("ord").collect()
    assert [r.ord for r in rows] == list(range(35)) and all(r.body for r in rows)
    assert sorted(int(k.rsplit("/", 1)[1]) for k, n in asked.items() if n > 1) == list(range(10, 23))  # the trigger that was lost
