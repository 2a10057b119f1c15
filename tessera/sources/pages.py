"""Pages of an HTTP API: bounded parallel fetching with retries, in the caller's order, of what has not been landed yet."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from urllib.request import urlopen

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fetches at a time, and attempts for each page.
WORKERS, ATTEMPTS = 8, 2


def get(url: str) -> bytes:
    with urlopen(url, timeout=60) as answer:
        return answer.read()


def indicator_url(base: str, code: Column, indicator: Column, first: int, last: int) -> Column:
    """The address of one page with all years from ``first`` to ``last``."""
    return F.concat(F.lit(base), F.lit("/country/"), code, F.lit("/indicator/"), indicator, F.lit(f"?format=json&per_page=100&date={first}:{last}"))


def missing(wanted: DataFrame, landed: DataFrame) -> DataFrame:
    """Pages that are not among the landed ones."""
    return wanted.join(landed.select("url"), "url", "left_anti")


def fetch(wanted: DataFrame, fetcher: Callable[[str], bytes] = get, workers: int = WORKERS, attempts: int = ATTEMPTS) -> DataFrame:
    """wanted(ord, url) -> (ord, url, body, error): one row per page, with the error of the last attempt where all failed.

    At most ``workers`` tasks fetch, each one page at a time; ``ord`` keeps the caller's order. A page that fails does not
    fail the others.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ordinal, url in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                body = error = None
                for _ in range(attempts):
                    try:
                        body, error = fetcher(url), None
                        break
                    except OSError as e:
                        error = f"{type(e).__name__}: {e}"
                yield pa.RecordBatch.from_arrays([pa.array([ordinal], pa.int64()), pa.array([url]), pa.array([body], pa.binary()), pa.array([error], pa.string())], ["ord", "url", "body", "error"])

    return wanted.select(F.col("ord").cast("long"), "url").repartition(workers, "ord").mapInArrow(run, "ord long, url string, body binary, error string")


def indicator_rows(pages: DataFrame) -> DataFrame:
    """(ord, code, year, value) of landed pages: a page is an array of a header and its observations; other bodies give no rows."""
    cells = F.from_json(F.get_json_object(F.col("body").cast("string"), "$[1]"), "array<struct<countryiso3code:string,date:string,value:double>>")
    return pages.where("body is not null").select("ord", F.explode(cells).alias("o")).select("ord", F.col("o.countryiso3code").alias("code"), F.col("o.date").try_cast("int").alias("year"), F.col("o.value").alias("value"))
