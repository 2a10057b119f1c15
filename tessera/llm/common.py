"""Small helpers that the operators share."""

from __future__ import annotations

import ctypes
import gc
import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that Python holds at once while it maps over a partition.
SLICE_ROWS = 256

#: After lower-casing A-Z: every ASCII byte that is neither a digit nor a lower-case letter ends a word.
_ENDS_WORD = bytes(0x20 if i < 0x30 or 0x3A <= i < 0x61 or 0x7B <= i < 0x80 else i for i in range(256))


def ascii_lower_words(text: str | None) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of a text with A-Z lower-cased, as UTF-8.

    Every byte of a non-ASCII character is 0x80 or more, so working on bytes is exact. Null has no words.
    """
    return (text or "").encode().lower().translate(_ENDS_WORD).split()


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """The same rows in small batches, so that long texts do not pile up as Python objects."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def give_back() -> None:
    """Freed memory goes back to the system at the end of a task: a Python worker is used again by later, unlike tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # not every C library has it
    if trim:
        trim(0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_key(text: Column) -> list[Column]:
    """120 bits of a text's SHA-256 as two numbers; null counts as empty. Never null, so that joins need no filter for it."""
    digest = F.sha2(F.coalesce(text.cast("string"), F.lit("")), 256)
    return [F.coalesce(F.conv(F.substring(digest, at, 15), 16, 10).cast("long"), F.lit(0)) for at in (1, 16)]


def checkpointed(df: DataFrame) -> DataFrame:
    """``df.checkpoint()`` in the folder that the cluster names in spark.checkpoint.dir.

    Where the session names none, a local session (tests) gets a folder of this machine; a cluster is refused, since its executors
    could not read such a folder.
    """
    sc = df.sparkSession.sparkContext
    if not sc.getConf().get("spark.checkpoint.dir") and sc._jsc.sc().getCheckpointDir().isEmpty():
        if not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="tessera-checkpoint-"))
    return df.checkpoint()


def fresh_name(df: DataFrame, name: str) -> str:
    """``name``, or with underscores before it where the table has such a column already (case aside)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def map_columns(df: DataFrame, inputs: list[str], fields: list[tuple[str, str, pa.DataType]], start: Callable[[], Callable[..., list]], rows: int = SLICE_ROWS, drop: tuple[str, ...] = ()) -> DataFrame:
    """Append columns computed in Python from ``inputs``, a slice of rows at a time, without a shuffle.

    start: called once per partition; returns a function of one list per input that returns one list per field.
    fields: name, DDL type and Arrow type of each new column. drop: columns that need not come back.
    """
    columns = [c for c in df.columns if c not in drop]
    ddl = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name not in drop] + [f"`{name}` {kind}" for name, kind, _ in fields])
    more = [c for c in dict.fromkeys(inputs) if c not in columns]  # a column that comes back is sent once
    named = df.select(*(F.col(f"`{c}`") for c in [*columns, *more]))
    places = [[*columns, *more].index(c) for c in inputs]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = start()
        for batch in slices(batches, rows):
            made = work(*(batch.column(i).to_pylist() for i in places))
            made = [x if isinstance(x, pa.Array) else pa.array(x, kind) for x, (_, _, kind) in zip(made, fields, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(columns)], *made], [*columns, *(f[0] for f in fields)])
        del work
        give_back()

    return named.mapInArrow(run, ddl)
