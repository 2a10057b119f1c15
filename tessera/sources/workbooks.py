"""Sheets of Excel workbooks (.xlsx) as rows, one task per file; a sheet's rows are read as a stream, never as a whole."""

from __future__ import annotations

import re
import zipfile
from collections.abc import Iterator
from io import BytesIO
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The namespaces of the format.
MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
REF = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"

ROWS = "path string, row int, cells map<string,string>, error string"
_SCHEMA = pa.schema([("path", pa.string()), ("row", pa.int32()), ("cells", pa.map_(pa.string(), pa.string())), ("error", pa.string())])
BATCH = 1000


def _text(node: ElementTree.Element) -> str:
    """The runs of a string, without its reading aids."""
    return "".join(t.text or "" for part in (node, *node.findall(f"{MAIN}r")) for t in part.findall(f"{MAIN}t"))


def _ended(book: zipfile.ZipFile, name: str, tag: str) -> Iterator[ElementTree.Element]:
    """Each element of that tag, freed once it was used."""
    with book.open(name) as file:
        parents: list[ElementTree.Element] = []
        for event, node in ElementTree.iterparse(file, ("start", "end")):
            if event == "start":
                parents.append(node)
                continue
            parents.pop()
            if node.tag == MAIN + tag:
                yield node
                node.clear()
                if parents:
                    parents[-1].remove(node)


def _column(place: str) -> int:
    """A1 is 0, Z9 is 25, AA1 is 26."""
    number = 0
    for letter in re.match("[A-Z]*", place)[0]:
        number = 26 * number + ord(letter) - 64
    return number - 1


def _sheet_file(book: zipfile.ZipFile, sheet: str) -> str:
    sheets = {s.get("name"): s.get(REF) for s in ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{MAIN}sheet")}
    if sheet not in sheets:
        raise KeyError(f"no sheet {sheet}")
    targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
    target = targets[sheets[sheet]]
    return target[1:] if target.startswith("/") else f"xl/{target}"


def _rows(content: bytes, sheet: str) -> Iterator[tuple[int, dict[int, str]]]:
    """(row number from 1, column -> text) of a sheet; empty cells and errors are left out."""
    with zipfile.ZipFile(BytesIO(content)) as book:
        name = _sheet_file(book, sheet)
        shared = [_text(s) for s in _ended(book, "xl/sharedStrings.xml", "si")] if "xl/sharedStrings.xml" in book.namelist() else []
        last = 0
        for row in _ended(book, name, "row"):
            last, at, cells = int(row.get("r") or last + 1), -1, {}
            for cell in row.findall(f"{MAIN}c"):
                at = _column(cell.get("r")) if cell.get("r") else at + 1
                kind, value = cell.get("t"), cell.findtext(f"{MAIN}v")
                if kind == "inlineStr":
                    inline = cell.find(f"{MAIN}is")
                    value = None if inline is None else _text(inline)
                elif kind == "s" and value is not None:
                    value = shared[int(value)]
                if value not in (None, "") and kind != "e":
                    cells[at] = value
            yield last, cells


def sheet_rows(spark: SparkSession, path: str, sheet: str, header: int) -> DataFrame:
    """(path, row, cells, error): the rows below a sheet's header row (numbered from 1), each cell under the name in the header.

    Defined results: of equal names the first column counts, columns without a name are left out, empty cells and errors are not in the
    map, rows without a cell are left out; numbers and dates stay as the file writes them. A file that is no workbook, lacks the sheet or breaks off
    gives one row with ``error`` after the rows read so far.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                out, names = [], {}
                try:
                    for number, cells in _rows(content.as_py(), sheet):
                        if number == header:
                            for at in sorted(cells, reverse=True):
                                names[cells[at]] = at
                        elif number > header:
                            found = [(name, cells[at]) for name, at in names.items() if at in cells]
                            if found:
                                out.append({"path": file, "row": number, "cells": found})
                        if len(out) == BATCH:
                            yield pa.RecordBatch.from_pylist(out, _SCHEMA)
                            out = []
                except (zipfile.BadZipFile, ElementTree.ParseError, KeyError, IndexError, ValueError, EOFError, OSError) as e:
                    out.append({"path": file, "error": f"{type(e).__name__}: {e}"})
                yield pa.RecordBatch.from_pylist(out, _SCHEMA)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, ROWS)


def cell(name: str) -> Column:
    """A named cell of ``sheet_rows`` as text, null where empty."""
    return F.try_element_at("cells", F.lit(name))


def latest_year(rows: DataFrame, key: str, first: int, last: int) -> DataFrame:
    """(key, year, value) of the newest year column of the sheet between first and last that holds a number; keys without any are left out."""
    years = rows.where("error is null").select(cell(key).alias(key), F.explode("cells").alias("name", "text"))
    numbers = years.select(key, F.expr("try_cast(name as int)").alias("year"), F.expr("try_cast(text as double)").alias("value"))
    kept = numbers.where(F.col("year").between(first, last) & F.col("value").isNotNull() & F.col(key).isNotNull())
    return kept.groupBy(key).agg(F.max("year").alias("year"), F.max_by("value", F.struct("year", "value")).alias("value"))
