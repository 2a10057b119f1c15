"""Chained lookups, hot groups, types by folder, and workbooks written here by hand."""

import zipfile

import pytest
from pyspark.sql import functions as F

from tessera.operators import lookups, ranking, relations, segments
from tessera.sources import workbooks

MAIN = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
REL = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def workbook(path, rows, shared=("Country", "Chad", "two ")):
    with zipfile.ZipFile(path, "w") as book:
        book.writestr("xl/workbook.xml", f'<workbook {MAIN} {REL}><sheets><sheet name="Notes" sheetId="1" r:id="rId1"/><sheet name="Current US$" sheetId="2" r:id="rId2"/></sheets></workbook>')
        book.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/><Relationship Id="rId2" Target="/xl/worksheets/sheet2.xml"/></Relationships>')
        book.writestr("xl/sharedStrings.xml", f"<sst {MAIN}>" + "".join(f"<si><t>{s}</t></si>" for s in shared) + "<si><r><t>rich </t></r><r><t>text</t></r><rPh><t>aid</t></rPh></si></sst>")
        book.writestr("xl/worksheets/sheet1.xml", f"<worksheet {MAIN}><sheetData/></worksheet>")
        book.writestr("xl/worksheets/sheet2.xml", f"<worksheet {MAIN}><sheetData>{rows}</sheetData></worksheet>")


ROWS = """<row r="1"><c r="A1" t="inlineStr"><is><t>a title</t></is></c></row>
<row r="3"><c r="A3" t="s"><v>0</v></c><c r="B3"><v>2023</v></c><c r="C3"><v>2024</v></c><c r="E3"><v>2024</v></c></row>
<row r="4"><c r="A4" t="s"><v>1</v></c><c r="B4"><v>1.5E2</v></c><c r="C4" t="str"><v>...</v></c><c r="D4"><v>9</v></c><c r="E4"><v>7</v></c></row>
<row r="5"><c r="A5" t="s"><v>3</v></c><c r="B5" t="e"><v>#N/A</v></c><c r="C5"><v>3</v></c></row>
<row r="6"><c r="D6"><v>1</v></c></row>
<row><c t="inlineStr"><is><r><t>No</t></r><r><t>where</t></r></is></c><c><v>4</v></c></row>"""


def test_sheets(spark, tmp_path):
    workbook(tmp_path / "a.xlsx", ROWS)
    (tmp_path / "b.xlsx").write_bytes(b"no archive")
    rows = {r["row"]: r for r in workbooks.sheet_rows(spark, str(tmp_path / "*.xlsx"), "Current US$", 3).collect()}
    assert sorted(k for k in rows if k) == [4, 5, 7]
    assert rows[4]["cells"] == {"Country": "Chad", "2023": "1.5E2", "2024": "..."}
    assert rows[5]["cells"] == {"Country": "rich text", "2024": "3"}
    assert rows[7]["cells"] == {"Country": "Nowhere", "2023": "4"}
    assert "BadZipFile" in rows[None]["error"] and rows[None]["path"].endswith("b.xlsx")
    latest = workbooks.latest_year(workbooks.sheet_rows(spark, str(tmp_path / "*.xlsx"), "Current US$", 3), "Country", 2000, 2025)
    assert sorted(map(tuple, latest.collect())) == [("Chad", 2023, 150.0), ("Nowhere", 2023, 4.0), ("rich text", 2024, 3.0)]


def test_sheets_that_lack_something(spark, tmp_path):
    workbook(tmp_path / "a.xlsx", ROWS)
    no_sheet = workbooks.sheet_rows(spark, str(tmp_path / "a.xlsx"), "Other", 3).collect()
    assert [r["row"] for r in no_sheet] == [None] and "no sheet" in no_sheet[0]["error"]
    assert workbooks.sheet_rows(spark, str(tmp_path / "a.xlsx"), "Notes", 3).count() == 0
    workbook(tmp_path / "c.xlsx", ROWS[:-40])
    broken = workbooks.sheet_rows(spark, str(tmp_path / "c.xlsx"), "Current US$", 3).collect()
    assert [r["row"] for r in broken] == [4, 5, None] and "ParseError" in broken[-1]["error"]


def test_long_sheet(spark, tmp_path):
    workbook(tmp_path / "long.xlsx", ROWS.split("<row r=\"4\"")[0] + "".join(f'<row r="{i}"><c r="A{i}" t="s"><v>1</v></c><c r="B{i}"><v>{i}</v></c></row>' for i in range(4, 40_004)))
    rows = workbooks.sheet_rows(spark, str(tmp_path / "long.xlsx"), "Current US$", 3)
    assert tuple(rows.agg(F.count("*"), F.sum(workbooks.cell("2023").cast("long")), F.countDistinct("row")).first()) == (40_000, sum(range(4, 40_004)), 40_000)


def test_chained_codes(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, None), (4, "z"), (1, "a")], "id int, code string")
    one = spark.createDataFrame([("a", "A"), ("a", "A"), ("b", "B"), (None, "never")], "x string, gec string")
    two = spark.createDataFrame([("A", "path"), (None, "never")], "y string, path string")
    got = lookups.chained(rows, "code", [(one, "x", "gec"), (two, "y", "path")])
    assert sorted((r["id"], r["gec"], r["path"], r["missed"]) for r in got.collect()) == [(1, "A", "path", None), (1, "A", "path", None), (2, "B", None, 2), (3, None, None, 1), (4, None, None, 1)]
    assert lookups.chained(rows.limit(0), "code", [(one, "x", "gec")]).count() == 0


@pytest.mark.parametrize("parts", [1, 7, 64])
def test_places_in_one_hot_key(spark, parts):
    rows = spark.range(3000).select(F.when(F.col("id") % 3 == 0, F.col("id") % 11).alias("k"), (F.col("id") * 7919 % 3001).alias("o"))
    rows = rows.withColumn("k", F.when(F.col("o") % 4 == 0, F.col("k")))  # most have no key, which is a key too
    got = segments.places(rows, "k", ["o"], parts).collect()
    want = {}
    for r in sorted(rows.collect(), key=lambda r: r["o"]):
        want.setdefault(r["k"], []).append(r["o"])
    assert len(got) == 3000
    assert {(r["k"], r["o"]): (r["position"], r["first_row"]["o"]) for r in got} == {(k, o): (i, os[0]) for k, os in want.items() for i, o in enumerate(os, 1)}


def test_grouped_rows_read_as_the_lists_do(spark):
    rows = spark.createDataFrame([("b", 1, "x"), ("a", 2, "y"), ("b", 3, "z"), (None, 0, "n")], "g string, ord int, item string")
    lists = [(r["g"], r["items"]) for r in ranking.grouped_lists(rows, "g", "ord", "item").orderBy("first_ord").collect()]
    out = {}
    for r in ranking.grouped_rows(rows, "g", "ord").orderBy("first_ord", "position").collect():
        out.setdefault(r["g"], []).append(r["item"])
    assert list(out.items()) == lists == [(None, ["n"]), ("b", ["x", "z"]), ("a", ["y"])]


def test_rows_of_faces_in_one_buffer(spark):
    offsets = spark.createDataFrame([(1, "g", 0, 2), (2, "g", 2, 0), (3, "g", 2, 3)], "id int, g string, faces_start long, faces int")
    faces = spark.createDataFrame([("g", i) for i in range(5)] + [("h", 0)], "g string, face long")
    got = sorted((r["g"], r["face"], r["id"]) for r in lookups.row_of_face(faces, offsets, "g").collect())
    assert got == [("g", 0, 1), ("g", 1, 1), ("g", 2, 3), ("g", 3, 3), ("g", 4, 3), ("h", 0, None)]


def test_types_are_read_alone(spark, tmp_path):
    rows = spark.createDataFrame([("1", "sea"), ("2", "land"), ("3", "sea"), ("4", None)], "id string, type string")
    folders = lookups.by_type(rows, str(tmp_path / "t"))
    assert sorted(r["id"] for r in lookups.of_type(folders, "sea").collect()) == ["1", "3"]
    assert folders.count() == 4
    plan = lookups.of_type(folders, "sea")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(type" in plan


def test_claim_neighbours_are_of_its_own_side(spark):
    edge = spark.createDataFrame([("a", "claimant", "geo-entity", "b"), ("a", "claims", "geo-entity", "b"), ("a", "claims", "country", "7"), ("a", "parent", "geo-entity", "p"), ("b", "claims", "geo-entity", None)], "id string, role string, ref_type string, ref_id string")
    assert [tuple(r) for r in relations.claim_neighbours(edge).collect()] == [("a", "b", ["claimant", "claims"])]
