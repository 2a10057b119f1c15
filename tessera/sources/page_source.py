"""Pages of an HTTP API as a data source, read in one go or as a stream.

A partition is a run of pages, so a task that is lost asks again for its own pages only. A page gets ``attempts`` tries; one that fails in all of them is a
row with the error and no body. The stream's offset is a place in the list, so a query that is started again with a longer list asks
for the new pages, and for those of a trigger that did not end. Pages come in the order of the list (``ord``).

Options: ``urls`` (a JSON list) or ``base`` with ``codes``, ``indicators`` (JSON lists), ``first`` and ``last`` (years); ``pages_per_task`` (8),
``attempts`` (2). An empty list gives no rows.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from .pages import ATTEMPTS, get

FORMAT = "api_pages"


@dataclass
class Pages(InputPartition):
    """Pages from ``first`` on."""

    first: int
    urls: list[str]


@dataclass
class _Source:
    urls: list[str]
    per_task: int
    attempts: int

    def between(self, start: int, end: int) -> list[Pages]:
        return [Pages(at, self.urls[at : min(at + self.per_task, end)]) for at in range(start, end, self.per_task)]

    def rows(self, pages: Pages) -> Iterator[tuple]:
        for ordinal, url in enumerate(pages.urls, pages.first):
            body = error = None
            for _ in range(self.attempts):
                try:
                    body, error = get(url), None
                    break
                except OSError as e:
                    error = f"{type(e).__name__}: {e}"
            yield ordinal, url, body, error


class _Reader(DataSourceReader):
    def __init__(self, source: _Source):
        self.source = source

    def partitions(self) -> list[Pages]:
        return self.source.between(0, len(self.source.urls))

    def read(self, partition: Pages | None) -> Iterator[tuple]:
        return self.source.rows(partition) if partition else iter(())  # Spark asks once where there is no partition


class _StreamReader(DataSourceStreamReader):
    def __init__(self, source: _Source):
        self.source = source

    def initialOffset(self) -> dict:
        return {"pages": 0}

    def latestOffset(self) -> dict:
        return {"pages": len(self.source.urls)}

    def partitions(self, start: dict, end: dict) -> list[Pages]:
        return self.source.between(start["pages"], end["pages"])

    def read(self, partition: Pages) -> Iterator[tuple]:
        return self.source.rows(partition)

    def commit(self, end: dict) -> None:
        pass


class ApiPages(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "ord long, url string, body binary, error string"

    def _source(self) -> _Source:
        o = self.options
        urls = json.loads(o["urls"]) if "urls" in o else [f"{o['base']}/country/{c}/indicator/{i}?format=json&per_page=100&date={o['first']}:{o['last']}" for c in json.loads(o["codes"]) for i in json.loads(o["indicators"])]
        return _Source(urls, int(o.get("pages_per_task", 8)), int(o.get("attempts", ATTEMPTS)))

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self._source())

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _StreamReader(self._source())


def read_pages(spark: SparkSession, **options: object) -> DataFrame:
    spark.dataSource.register(ApiPages)
    return spark.read.format(FORMAT).options(**{k: json.dumps(v) if isinstance(v, list) else v for k, v in options.items()}).load()


def stream_pages(spark: SparkSession, **options: object) -> DataFrame:
    spark.dataSource.register(ApiPages)
    return spark.readStream.format(FORMAT).options(**{k: json.dumps(v) if isinstance(v, list) else v for k, v in options.items()}).load()
