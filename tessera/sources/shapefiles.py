"""Shapefiles with their tables, read by several tasks.

The index file (.shx) tells where each record begins, so records are dealt to tasks as runs and each task reads only its bytes of the shapes (.shp) and of the
table (.dbf). Points, lines, polygons and their kinds with heights or measures (which are left out) are read; a null shape is a row without parts. A polygon's outer
rings run clockwise and each hole belongs to the outer ring before it that holds its first vertex. The table's texts are read as Latin-1 or UTF-8, numbers as
doubles, logical values as booleans, the rest as text; an empty cell is null; rows that the table marks as deleted keep their shapes and have
``deleted`` set.

The files must lie where tasks can open them. A file without records gives no rows; a damaged record gives a row with ``error``.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_HEADER = 100
_POINTS, _LINES, _AREAS, _MULTI = {1, 11, 21}, {3, 13, 23}, {5, 15, 25}, {8, 18, 28}
_TYPES = {"N": "double", "F": "double", "L": "boolean"}


def _fields(dbf: str) -> tuple[int, int, int, list[tuple[str, str, int]]]:
    """Rows, header bytes, row bytes, and each column's name, kind and width."""
    with open(dbf, "rb") as f:
        rows, header, width = struct.unpack("<IHH", f.read(32)[4:12])
        body = f.read(max(0, header - 32))
    columns = []
    for at in range(0, len(body) - 31, 32):
        if body[at] == 0x0D:
            break
        columns.append((body[at : at + 11].split(b"\0")[0].decode("latin-1"), chr(body[at + 11]), body[at + 16]))
    return rows, header, width, columns


def _cell(raw: bytes, kind: str, encoding: str) -> object:
    text = raw.decode(encoding, "replace").strip("\0 ")
    if kind in "NF":
        try:
            return float(text)
        except ValueError:
            return None
    if kind == "L":
        return {"t": True, "y": True, "f": False, "n": False}.get(text.lower())
    return text or None


def _shape(body: bytes) -> tuple[str | None, list[list[tuple[float, float]]]]:
    """The kind and the parts (lists of places) of a record's content."""
    (kind,) = struct.unpack_from("<i", body)
    if kind == 0:
        return None, []
    if kind in _POINTS:
        return "Point", [[struct.unpack_from("<2d", body, 4)]]
    if kind in _MULTI:
        (n,) = struct.unpack_from("<i", body, 36)
        return "MultiPoint", [[struct.unpack_from("<2d", body, 40 + 16 * i)] for i in range(n)]
    if kind not in _LINES | _AREAS:
        raise ValueError(f"shape type {kind}")
    parts, n = struct.unpack_from("<2i", body, 36)
    starts = [*struct.unpack_from(f"<{parts}i", body, 44), n]
    flat = struct.unpack_from(f"<{2 * n}d", body, 44 + 4 * parts)
    places = list(zip(flat[::2], flat[1::2], strict=True))
    return "Polygon" if kind in _AREAS else "LineString", [places[a:b] for a, b in zip(starts, starts[1:], strict=False)]


def _turns_right(ring: list[tuple[float, float]]) -> bool:
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:], strict=False)) <= 0


def _holds(ring: list[tuple[float, float]], p: tuple[float, float]) -> bool:
    crossed = False
    for a, b in zip(ring, ring[1:], strict=False):
        if (a[1] > p[1]) != (b[1] > p[1]) and p[0] < a[0] + (p[1] - a[1]) / (b[1] - a[1]) * (b[0] - a[0]):
            crossed = not crossed
    return crossed


def _polygons(rings: list[list[tuple[float, float]]]) -> list[list[list[tuple[float, float]]]]:
    out = [[r] for r in rings if _turns_right(r)]
    for hole in (r for r in rings if not _turns_right(r)):
        owner = next((p for p in out if hole and _holds(p[0], hole[0])), None)
        if owner:
            owner.append(hole)
        else:
            out.append([hole])
    return out


_PLACES = pa.list_(pa.list_(pa.list_(pa.struct([("lng", pa.float64()), ("lat", pa.float64())]))))


def read_shapefile(spark: SparkSession, path: str, records_per_task: int = 10_000, encoding: str = "utf-8") -> DataFrame:
    """(record, type, polygons, deleted, error, the table's columns). Lines and points are polygons' first rings: a part each."""
    base = path.removesuffix(".shp")
    rows, header, width, columns = _fields(f"{base}.dbf")
    with open(f"{base}.shx", "rb") as f:
        count = (f.seek(0, 2) - _HEADER) // 8
    taken = {"record", "type", "polygons", "deleted", "error"}
    names = [f"{n}_" if n.lower() in taken else n for n, _, _ in columns]
    fields = [("record", "long", pa.int64()), ("type", "string", pa.string()), ("polygons", "array<array<array<struct<lng:double,lat:double>>>>", _PLACES), ("deleted", "boolean", pa.bool_()), ("error", "string", pa.string())]
    fields += [(n, _TYPES.get(k, "string"), {"double": pa.float64(), "boolean": pa.bool_()}.get(_TYPES.get(k, ""), pa.string())) for n, (_, k, _) in zip(names, columns, strict=True)]

    def some(first: int) -> dict[str, list]:
        n = min(records_per_task, count - first)
        with open(f"{base}.shx", "rb") as index:
            index.seek(_HEADER + 8 * first)
            places = struct.unpack(f">{2 * n}i", index.read(8 * n))
        with open(f"{base}.dbf", "rb") as table:
            table.seek(header + width * first)
            cells = table.read(width * max(0, min(n, rows - first)))
        out: dict[str, list] = {name: [] for name, _, _ in fields}
        with open(f"{base}.shp", "rb") as shapes:
            for i in range(n):
                kind, polygons, error = None, None, None
                try:
                    shapes.seek(2 * places[2 * i] + 8)
                    kind, parts = _shape(shapes.read(2 * places[2 * i + 1]))
                    polygons = None if kind is None else _polygons(parts) if kind == "Polygon" else [[p] for p in parts]
                except (struct.error, ValueError) as e:
                    error = f"{type(e).__name__}: {e}"
                row = cells[width * i : width * (i + 1)]
                values, at = [], 1
                for _, k, w in columns:
                    values.append(_cell(row[at : at + w], k, encoding))
                    at += w
                named = None if polygons is None else [[[{"lng": x, "lat": y} for x, y in ring] for ring in p] for p in polygons]
                for (name, _, _), value in zip(fields, [first + i, kind, named, row[:1] == b"*", error, *values], strict=True):
                    out[name].append(value)
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in batch.column(0).to_pylist():
                made = some(first)
                yield pa.RecordBatch.from_arrays([pa.array(made[n], t) for n, _, t in fields], [n for n, _, _ in fields])

    tasks = max(1, -(-count // records_per_task))
    starts = spark.range(0, count, records_per_task, tasks) if count else spark.range(0)
    return starts.select(F.col("id")).mapInArrow(run, ", ".join(f"`{n}` {t}" for n, t, _ in fields))
