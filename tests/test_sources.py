"""Fetching from a local server, and topologies."""

import json
import threading
from collections import Counter
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from tessera.sources import pages, topology


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
            self.wfile.write(json.dumps([{"page": 1}, [{"countryiso3code": self.path.split("/")[2], "date": "2020", "value": 1.5}, {"countryiso3code": "X", "date": "soon", "value": None}]]).encode())

        def log_message(self, *a):
            pass

    s = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}", asked
    s.shutdown()


def test_pages_are_fetched_in_order_with_retries(spark, server):
    base, asked = server
    codes = spark.createDataFrame([(i, c) for i, c in enumerate(["AAA", "ONCE", "BAD", "DDD"])], "ord long, code string")
    wanted = codes.select("ord", pages.indicator_url(base, F.col("code"), F.lit("GDP"), 2000, 2024).alias("url"))
    landed = spark.createDataFrame(pages.fetch(wanted).collect(), "ord long, url string, body binary, error string")
    rows = landed.orderBy("ord").collect()
    assert [r["body"] is None for r in rows] == [False, False, True, False] and "503" in rows[2]["error"]
    assert max(asked.values()) == 2 and sum(asked.values()) == 6
    assert [tuple(r) for r in pages.indicator_rows(landed).where("value is not null").orderBy("ord").collect()] == [(0, "AAA", 2020, 1.5), (1, "ONCE", 2020, 1.5), (3, "DDD", 2020, 1.5)]
    assert [r["ord"] for r in pages.missing(wanted, landed.where("body is not null")).collect()] == [2]


TOPOLOGY = {
    "type": "Topology", "transform": {"scale": [0.5, 2], "translate": [10, 20]}, "arcs": [[[0, 0], [2, 0], [0, 1]], [[2, 1], [-2, 0], [0, -1]], [[2, 1], [2, 0], [0, -1], [-2, 0]]],
    "objects": {"lands": {"type": "GeometryCollection", "geometries": [{"type": "Polygon", "id": "004", "arcs": [[0, 1]], "properties": {"name": "one"}}, {"type": "MultiPolygon", "arcs": [[[2, -1, -2]], [[0, 1]]], "properties": {"name": "two"}}, {"type": None, "properties": {"name": "none"}}]}},
}


def test_topology(spark, tmp_path):
    (tmp_path / "t.json").write_text(json.dumps(TOPOLOGY))
    rows = topology.read_features(spark, str(tmp_path / "t.json"), "lands", "name string").orderBy("ordinal").collect()
    assert [(r["id"], r["name"], r["type"]) for r in rows] == [("004", "one", "Polygon"), ("feature-1", "two", "MultiPolygon"), ("feature-2", "none", None)]
    square = [(10.0, 20.0), (11.0, 20.0), (11.0, 22.0), (10.0, 22.0), (10.0, 20.0)]
    assert [[[tuple(p) for p in ring] for ring in polygon] for polygon in rows[0]["polygons"]] == [[square]]
    assert [[tuple(p) for p in ring] for ring in rows[1]["polygons"][1]] == [square] and rows[2]["polygons"] is None
    first = [tuple(p) for p in rows[1]["polygons"][0][0]]
    assert first[:4] == [(11.0, 22.0), (12.0, 22.0), (12.0, 20.0), (11.0, 20.0)]


def test_simplified(spark):
    line = [(float(i), 0.001 * (i % 2)) for i in range(20)] + [(20.0, 10.0), (21.0, 0.0)]
    arcs = spark.createDataFrame([(0, line), (1, [(0.0, 0.0), (5.0, 5.0)])], "arc int, points array<struct<lng:double,lat:double>>")
    got = {r["arc"]: [tuple(p) for p in r["points"]] for r in topology.simplified(arcs, 0.35).collect()}
    assert len(got[1]) == 2 and 13 <= len(got[0]) <= 16
    assert got[0][0] == (0.0, 0.0) and any(abs(x - 20) < 1e-3 and abs(y - 10) < 1e-3 for x, y in got[0]) and abs(got[0][-1][0] - 21) < 1e-3
