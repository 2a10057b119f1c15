"""One text document out of many tasks' lines, all or nothing.

Tasks write their lines as parts beside the target; when all have ended, the parts are joined in order, with a head for each section, commas between a
section's lines and a tail, under a name of their own, which then takes the target's place. A failed job leaves the target as it was and no parts.
The folder must be one that tasks and driver share; other stores take ``DataFrame.write.text``.
"""

from __future__ import annotations

import contextlib
import json
import os
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import Row, StructType

FORMAT = "joined_document"


@dataclass
class _Part(WriterCommitMessage):
    """A task's file; how many lines it has of each section, in the order of its lines."""

    task: int
    file: str
    lines: list[tuple[int, int]]


class _Writer(DataSourceWriter):
    def __init__(self, path: str, heads: list[str], tail: str, between: str):
        self.path, self.heads, self.tail, self.between = path, heads, tail, between
        self.parts = f"{path}.parts-{uuid.uuid4().hex}"

    def write(self, rows: Iterator[Row]) -> WriterCommitMessage:
        """Lines of one task; a section's lines follow each other, and each ends with the separator."""
        from pyspark import TaskContext

        os.makedirs(self.parts, exist_ok=True)
        context = TaskContext.get()
        name = f"{self.parts}/{context.partitionId():06d}-{context.taskAttemptId()}"
        counts: list[tuple[int, int]] = []
        with open(name, "w", encoding="utf-8") as out:
            for row in rows:
                if counts and counts[-1][0] == row["section"]:
                    counts[-1] = (row["section"], counts[-1][1] + 1)
                else:
                    counts.append((row["section"], 1))
                out.write(row["line"].replace("\n", " ") + "\n")
        return _Part(context.partitionId(), name, counts)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        made = f"{self.parts}.joined"
        section, first = -1, True
        with open(made, "w", encoding="utf-8") as out:
            for part in sorted((m for m in messages if m), key=lambda m: m.task):
                with open(part.file, encoding="utf-8", newline="\n") as lines:
                    for own, n in part.lines:
                        while section < own:
                            section, first = section + 1, True
                            out.write(self.heads[section])
                        for _ in range(n):
                            out.write(("" if first else self.between) + next(lines)[:-1])
                            first = False
            for head in self.heads[section + 1 :]:
                out.write(head)
            out.write(self.tail)
        os.replace(made, self.path)
        shutil.rmtree(self.parts, ignore_errors=True)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        shutil.rmtree(self.parts, ignore_errors=True)
        with contextlib.suppress(OSError):
            os.remove(f"{self.parts}.joined")


class JoinedDocument(DataSource):
    """Options: path, heads (a JSON list, one per section), tail, between."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "section int, line string"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options["path"], json.loads(self.options["heads"]), self.options["tail"], self.options["between"])


def write_document(lines: DataFrame, path: str, heads: list[str], tail: str = "", between: str = ",\n") -> None:
    """lines(section, ordinal, line): sections from 0, each with its head; lines in the order of their ordinals."""
    lines.sparkSession.dataSource.register(JoinedDocument)
    ordered = lines.repartitionByRange("section", "ordinal").sortWithinPartitions("section", "ordinal").select(F.col("section").cast("int").alias("section"), "line")
    ordered.write.format(FORMAT).mode("append").options(path=path, heads=json.dumps(heads), tail=tail, between=between).save()


def write_feature_collection(points: DataFrame, path: str, order: str, properties: list[str], id_col: str = "id") -> None:
    """One GeoJSON document of the points (lng, lat), in the order of a column."""
    feature = F.to_json(F.struct(F.lit("Feature").alias("type"), F.col(id_col).alias("id"), F.struct(F.lit("Point").alias("type"), F.array("lng", "lat").alias("coordinates")).alias("geometry"), F.struct(*properties).alias("properties")), {"ignoreNullFields": "false"})
    write_document(points.select(F.lit(0).alias("section"), F.col(order).alias("ordinal"), feature.alias("line")), path, ['{"type":"FeatureCollection","features":['], "]}")


def write_register(rows: DataFrame, path: str, title: str, order: str, columns: list[str]) -> None:
    """One Markdown table of the rows, in the order of a column, under a title with their number."""
    head = "| " + " | ".join(columns) + " |\n|" + " --- |" * len(columns) + "\n"
    cells = F.concat(F.lit("| "), F.concat_ws(" | ", *(F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("|"), F.lit("\\|")) for c in columns)), F.lit(" |"))
    write_document(rows.select(F.lit(0).alias("section"), F.col(order).alias("ordinal"), cells.alias("line")), path, [f"# {title}: {rows.count()} rows\n\n{head}"], "\n", "\n")
