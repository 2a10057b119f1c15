"""Rows that come in pieces, and stop coming when a newer generation of their key begins.

A table to be shown piece by piece is written as files of at most ``CHUNK`` rows and read as a stream of one file a trigger, so that no trigger does more.
Every row carries its key and a generation; a row of an older generation than the key's newest so far is dropped (the rest of a cancelled load). The sink
writes each trigger's rows under the trigger's number and replaces what an interrupted run left there, so a restart neither repeats nor loses a row;
``current`` leaves what an older generation wrote before it was cancelled.

Null keys are one key; null generations are older than all others.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

CHUNK = 400


def write_chunks(rows: DataFrame, path: str, order: list[str], chunk: int = CHUNK) -> None:
    """Files of at most ``chunk`` rows, in the order of the columns; more rows may be appended later."""
    rows.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("append").option("maxRecordsPerFile", chunk).parquet(path)


def chunk_stream(spark: SparkSession, path: str, schema: str, files: int = 1) -> DataFrame:
    """A stream of ``files`` chunks a trigger, the oldest first."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def current(rows: DataFrame, key: str, generation: str = "generation") -> DataFrame:
    """The rows of each key's newest generation. One row a key and task is shuffled, then joined back; AQE splits hot keys."""
    newest = rows.groupBy(F.col(key).alias("__key")).agg(F.max(generation).alias("__newest"))
    return rows.join(newest, F.col(key).eqNullSafe(F.col("__key")) & F.col(generation).eqNullSafe(F.col("__newest"))).drop("__key", "__newest")


def not_cancelled(stream: DataFrame, key: str, generation: str = "generation") -> DataFrame:
    """The stream's rows that are not older than the newest generation of their key that has arrived, in this trigger or before."""
    names = stream.columns

    def run(_: tuple, frames: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        newest = held.get[0] if held.exists else None
        batch = pd.concat(list(frames))
        latest = batch[generation].max()
        if pd.notna(latest):
            newest = int(latest) if newest is None else max(newest, int(latest))
        held.update((newest,))
        yield batch if newest is None else batch[batch[generation] == newest]

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stream.schema.fields)
    return stream.groupBy(key).applyInPandasWithState(run, ddl, "newest long", "append", GroupStateTimeout.NoTimeout).select(*names)


def start_sink(stream: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Writes each trigger's rows to its own folder; a trigger that runs again replaces its rows."""

    def put(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/trigger={number}")

    writer = stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def shown(spark: SparkSession, path: str, schema: str, key: str, generation: str = "generation") -> DataFrame:
    """What the sink holds of each key's newest generation."""
    try:
        rows = spark.read.option("basePath", path).schema(schema).parquet(f"{path}/trigger=*")
    except AnalysisException:
        return spark.createDataFrame([], schema)
    return current(rows.drop("trigger"), key, generation)
